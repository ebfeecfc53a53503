"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folio.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves, arity):
    """(root, for each leaf its runs and places from the leaf up)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h(*now[i : i + arity]) for i in range(0, len(now), arity)])
    paths = []
    for p in range(len(leaves)):
        path = []
        for now in levels[:-1]:
            start = p // arity * arity
            path.append((now[start : start + arity], p - start))
            p //= arity
        paths.append(path)
    return levels[-1][0], paths


def _fold(leaf, path):
    for run, at in path:
        leaf = _h(*run[:at], leaf, *run[at + 1 :])
    return leaf


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _expected(rows, arity):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, _leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), r))
    names = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
    made = {name: _tree([x[2] for x in trees[name]], arity) for name in names}
    root, above = _tree([made[name][0] for name in names], arity) if names else ("", [])
    out = []
    for name, up in zip(names, above, strict=True):
        for (_, _, leaf, r), path in zip(trees[name], made[name][1], strict=True):
            whole = path + up
            proof = _h(*[s for run, at in whole for i, s in enumerate(run) if i != at])
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            given = _leaf(r.doc_id, r.source, r.lang, r.n_chars + 1, r.text) if tampered else leaf
            folded = _fold(given, whole)
            out.append((r.doc_id, leaf, made[name][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def _got(docs, arity):
    return sorted(map(tuple, merkle.document_manifest(docs, arity).collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 11 == 0 else f"s{i % 3}", (None, "en", "en", "en", "dé", "", "z")[i % 7], None if i % 5 == 0 else i, None if i % 13 == 0 else "é " * (i % 4)) for i in range(700)]
    data += [(None, "x", "en", 1, "t")] * 3 + [(5, "x", "en", 1, "t")] * 40 + [(5, "y", "en", 1, "t"), (9, None, "one", None, None)]
    return spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").withColumn("root", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("tree", F.lit(2))


@pytest.mark.parametrize("arity", [2, 3, 7])
def test_manifest_is_the_plain_tree(rows, arity):
    want = _expected(rows.collect(), arity)
    assert _got(rows, arity) == want
    assert {w[6] for w in want} == {True, False}


def test_rounds_and_steps_of_one_level(rows, monkeypatch):
    """Open nodes that meet late, proofs that go one level at a time."""
    monkeypatch.setattr(merkle, "SPAN", 3)
    monkeypatch.setattr(merkle, "STEP", 2)
    assert _got(rows.repartition(23), 2) == _expected(rows.collect(), 2)


def test_odd_tables(odd, none):
    docs = odd.withColumns({"lang": F.col("source"), "n_chars": F.lit(None).cast("long")})
    got = _got(docs, 2)
    assert got == _expected(docs.collect(), 2) and all(g[6] for g in got)
    assert _got(none.withColumns({"lang": F.col("source"), "n_chars": F.lit(1).cast("long")}), 2) == []


def test_a_task_completes_what_it_can():
    frontier = merkle.Frontier(2)
    made = [x for i in range(3, 9) for x in frontier.offer(b"t", 9, 0, i, str(i))]
    assert [(level, index) for level, index, _, _ in made] == [(1, 2), (1, 3), (2, 1), (1, 4), (2, 2), (3, 1)]
    assert {(up, parent) for _, up, parent in frontier.open} == {(1, 1), (3, 0), (4, 0)}
