"""Token alignment against the two libraries and a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folio.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "23", "!", "'s", "\xa0", "<|endoftext|>", "中", "the", "‍", "\x1c", "\x01", "\r", "word ", " word", "▁", "<s>", "unbelievable", "тест", "\x00", "😀", " tokenization"]


def _ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def _plain(rows):
    """The contract, step by step, with the libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    char_of = {}
    fresh = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            char_of[chr(b)] = b
        else:
            char_of[chr(256 + fresh)] = b
            fresh += 1

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            a_tokens, b_tokens = [bytes(char_of[c] for c in a_lib.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
            if not b"".join(a_tokens) == b"".join(b_tokens) == (" " + text).encode():
                a, b = [], []
            else:
                a_end, b_end = _ends(a_tokens), _ends(b_tokens)
                x = y = 0
                for cut_at in sorted(set(a_end) & set(b_end)):
                    i, k = a_end.index(cut_at, x) + 1, b_end.index(cut_at, y) + 1
                    groups.append((a[x:i], b[y:k]))
                    x, y = i, k
                j = 0
                for i in range(len(a)):
                    start = a_end[i] - len(a_tokens[i])
                    while b_end[j] <= start:
                        j += 1
                    k = j
                    while k < len(b) and b_end[k] - len(b_tokens[k]) < a_end[i]:
                        links.append((a[i], b[k]))
                        k += 1
        counts.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _got(docs):
    return sorted(map(tuple, alignment.align(docs, BYTE, PIECE).select(*COLUMNS).collect()), key=str)


def test_alignment_is_the_plain_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert _got(docs) == _plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("size", [3000, 2_000_000])
def test_odd_texts(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(1500)]
    got = _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == _plain(rows) and any(g[7] == "" for g in got)


def test_odd_tables(odd, none):
    assert _got(odd) == _plain([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert _got(none) == []
    assert _got(odd.withColumn("text", F.lit(None).cast("string"))) == _plain([(r.doc_id, None) for r in odd.select("doc_id").collect()])


def test_components_are_the_minimal_groups():
    import numpy as np
    import pyarrow as pa

    by = alignment.Aligner(BYTE, PIECE)
    words = pa.array(["tokenization", "a", "internationalisation", "a▁b"])
    found = by.align(words)
    assert found.sound.tolist() == [True, True, True, False] and found.text[3] == b"" and found.n_links[3] == 0
    for i in range(3):
        groups = [tuple(map(len, (g.split(b"|")[0].split(b","), g.split(b"|")[1].split(b",")))) for g in found.text[i].split(b";")]
        assert np.sum(groups, axis=0).tolist() == [found.n_a[i], found.n_b[i]] and len(groups) == found.n_groups[i]
