"""Merge rounds against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor

from folio.llm.piece_bpe import PieceModel, round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "B", " ", "  ", "\n", "é", "1", "23", "!", "'s", "\xa0", "<s>", "<0x0A>", "中", "the", "ing", "tion", "▁", "▁▁▁", "😀", "\x00", "aaaa", "abab", "   ", "====="]


def test_encode_and_decode():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abcdethionrs") for _ in range(rnd.randint(1, 60))) for _ in range(3000)] + ["a" * 3000, "ab" * 999, " " * 300, "=" * 500, ""]
    library, model = SentencePieceProcessor(model_file=MODEL), PieceModel(MODEL, max_cached=700)
    flat, counts = model.encode(pa.array(texts))
    decoded, at = model.decode(flat, counts), 0
    for text, n, want, back in zip(texts, counts, library.encode(texts, num_threads=1), decoded, strict=True):
        assert flat[at : at + n].tolist() == want and back.decode() == library.decode(want)
        at += n


def test_cache_over_many_slices():
    """Words that stand in plainly and oddly spaced texts at once keep their own ids in later calls, whatever the cache holds."""
    library = SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdethionrsé中") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    for max_cached in (0, 50, 100_000):
        model = PieceModel(MODEL, max_cached)
        for _ in range(12):
            texts = [(rnd.choice(["", "", " ", "  "])) + rnd.choice([" ", " ", "  "]).join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(150)]
            flat, counts = model.encode(pa.array(texts))
            ends = counts.cumsum()
            assert [flat[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == library.encode(texts, num_threads=1)
        assert len(model.index) == len(model.starts) <= max_cached


def test_round_trip(spark, odd, none):
    library = SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for r in odd.collect() for ids in [library.encode(r.text or "")])
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(odd, MODEL).collect())
    assert got == want and round_trip(none, MODEL).count() == 0
