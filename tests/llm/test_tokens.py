"""Token files, the separator scan and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from folio.llm import packing, ranked_varint, separator_scan
from folio.llm.encoding import PieceEncoder, slices

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "23", "!", "'s", "\xa0", "<|endoftext|>", "<|", "中", "the", "‍", "ß", "İ", "\x1c", "\x01", "́", "\r", "word ", " word"]


def _fuzz(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_library_ids(path):
    texts = _fuzz(4000)
    encoder = PieceEncoder(path, max_cached=500)
    want = encoder.library(texts)
    at = 0
    for start, run in slices(pa.array(texts), 5000):
        flat, counts = encoder.encode(run)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for k in range(len(run)):
            assert flat[edges[k] : edges[k + 1]].tolist() == want[start + k]
            at += 1
    assert at == len(texts)


def test_varint_round_trip():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rnd.integers(0, 1 << rnd.integers(1, 32), n).astype(np.uint32)
        control, data = ranked_varint.pack_values(values)
        assert (ranked_varint.unpack_values(control, data, n) == values).all() and len(control) == -(-n // 4)


def _ids(texts, path, end, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = _ids([r.text for r in rows], BYTE, 0)
    got = sorted(map(tuple, ranked_varint.digest(spark, odd, BYTE).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [g[1] for g in got] == [r.doc_id for r in rows]
    assert sorted((g[2], g[3]) for g in got) == sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids)
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_small_files(spark, monkeypatch):
    monkeypatch.setattr(ranked_varint, "FILE_VALUES", 50)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('text number ', id) AS text").coalesce(1)
    files, by_rank = ranked_varint.token_files(spark, docs, BYTE)
    rows = sorted(map(tuple, ranked_varint.read_files(files, by_rank).select("start", "doc_id", "n_tokens").collect()))
    assert files.count() >= 2 and [r[1] for r in rows] == list(range(600))
    assert [r[0] for r in rows] == np.cumsum([0] + [r[2] for r in rows])[:-1].tolist()


def test_empty_tables(spark, none):
    assert ranked_varint.digest(spark, none, BYTE).count() == 0
    assert separator_scan.token_counts(spark, none, BYTE, 50256).count() == 0
    assert packing.pack(none, WORD).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000, 1_000_000])
def test_separator_scan(spark, odd, block):
    want = sorted((r.doc_id is not None, r.doc_id or 0, n) for r, n in ((r, len(_ids([r.text], BYTE, 50256, True)[0])) for r in odd.collect()) if block > 5 or n < 100)
    docs = odd if block > 5 else odd.where("text is null or length(text) < 100")
    got = separator_scan.token_counts(spark, docs, BYTE, 50256, file_tokens=40, block_tokens=block).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want


def test_scan_counts_what_follows_the_last_separator(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    np.array([5, 0, 0, 7, 8], "<u2").tofile(path)
    files = spark.createDataFrame([(path, 1, 5)], "path string, file long, n_ids long")
    got = sorted(map(tuple, separator_scan.scan(files, 0, block_tokens=2).select("start", "n_tokens", "ended").collect()))
    assert got == [(0, 2, True), (2, 1, True), (3, 2, False)]


def test_fullest_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(sums) and all(n <= counts[x] for x, n in chosen.items())


def test_packing(spark, odd):
    rows = packing.pack(odd, WORD, 1, 64).collect()
    ids = _ids([r.text for r in odd.collect()], WORD, 1)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert sorted({(r.doc_id, r.doc_tokens) for r in rows}, key=str) == sorted({(r.doc_id, len(i)) for r, i in zip(odd.collect(), _ids([r.text for r in odd.collect()], WORD, 1), strict=True)}, key=str)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    wanted = sorted(zlib.crc32(np.array(i[s : s + 64], "<u4").tobytes()) for i in ids for s in range(0, len(i), 64))
    assert sorted(r.ids_crc32 for r in rows) == wanted


def test_little_padding(spark, small):
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), WORD).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in rows]
    assert sum(2048 - u for u in used if u & (u - 1)) < 0.03 * sum(used)
