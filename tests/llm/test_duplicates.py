"""Exact and near duplicates and components against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from brute import fingerprint, near_pairs, normal, roots

from folio.llm import exact_dedup, simhash, spread
from folio.llm import rows as rows_of_tables
from folio.llm.components import components, spanning


def _words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def copies(spark):
    rnd = random.Random(8)
    rows, i = [], 0
    for _ in range(40):
        text = _words(rnd, rnd.choice([0, 1, 3, 50, 900, 3000]))
        for _ in range(rnd.choice([1, 1, 2, 5])):
            rows.append((i, text.replace(" ", rnd.choice([" ", "  ", "\n"]))))
            i += 1
        rows.append((i, text + "x"))
        i += 1
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def _exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r)
    out = []
    for key, found in groups.items():
        best = min(found, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        out += [(str(r.doc_id), str(best.doc_id), len(found), hashlib.sha256(key.encode()).hexdigest()) for r in found]
    return sorted(out), len(groups)


@pytest.mark.parametrize("bits", [64, 5])
def test_exact(copies, bits):
    want, n = _exact(copies.collect())
    got = exact_dedup.deduplicate(copies, bits).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n and all(r.doc_id == r.keep_id for r in kept)


def test_exact_odd(odd, none):
    want, n = _exact(odd.collect())
    got = exact_dedup.deduplicate(odd).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want and sum(r.kept for r in got) == n
    assert exact_dedup.deduplicate(none).count() == 0
    stay = exact_dedup.without_copies(odd)
    assert stay.count() == n and stay.columns == odd.columns and exact_dedup.without_copies(none).count() == 0


def test_hot_keys_give_the_same_rows(spark, copies, near, monkeypatch):
    monkeypatch.setattr(spread, "LEAST_HOT", 1)
    want, _ = _exact(copies.collect())
    got = exact_dedup.deduplicate(copies).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    rows = sorted(near.collect(), key=lambda r: r.doc_id)
    root = roots(len(rows), near_pairs([fingerprint(r.text) for r in rows]))
    assert [r.component_id for r in sorted(simhash.near_duplicates(near).collect(), key=lambda r: r.doc_id)] == [rows[k].doc_id for k in root]


def test_without_rows(spark):
    held, key = rows_of_tables.numbered(spark.range(5000).selectExpr("id AS __row", "id % 7 AS k").repartition(9))
    assert key == "__row_"
    left = rows_of_tables.without_rows(held, held.where("k = 3").select(key), key)
    assert sorted(r["__row"] for r in left.collect()) == [i for i in range(5000) if i % 7 != 3]
    assert rows_of_tables.without_rows(held, held.where("k = 9").select(key), key).count() == 5000


def test_cut_points_follow_content():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    ends = exact_dedup.cut_points(a)
    assert ends[-1] == len(a) and ends == sorted(set(ends)) and len(ends) > 10
    shifted = exact_dedup.cut_points(b"some bytes before" + a)
    assert len({e + 17 for e in ends} & set(shifted)) > 0.7 * len(ends)
    assert exact_dedup.cut_points(b"") == [0] and max(np.diff([0, *exact_dedup.cut_points(b"a" * 100_000)])) <= exact_dedup.MOST


@pytest.fixture(scope="module")
def near(spark):
    rnd = random.Random(9)
    rows, i = [(0, ""), (1, None), (2, "Ab c"), (3, "aB  c")], 4
    for _ in range(25):
        w = _words(rnd, rnd.choice([5, 80, 400])).split()
        for _ in range(rnd.choice([1, 3, 30])):
            v = list(w)
            for _ in range(rnd.choice([0, 1, 1, 3])):
                v[rnd.randrange(len(v))] = "changed" + str(rnd.randint(0, 9))
            rows.append((i, " ".join(v)))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("block", [8192, 8])
def test_near(near, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = sorted(near.collect(), key=lambda r: r.doc_id)
    prints = [fingerprint(r.text) for r in rows]
    root = roots(len(rows), near_pairs(prints))
    got = sorted(simhash.near_duplicates(near).collect(), key=lambda r: r.doc_id)
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == [rows[k].doc_id for k in root]


def test_near_odd(odd, none):
    rows = odd.collect()
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows) and sorted(r.fingerprint for r in got) == sorted(f"{fingerprint(r.text):016x}" for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_every_distance_is_found():
    """Fingerprints up to four bits apart share a variant, wherever the bits are."""
    rnd = random.Random(2)
    cuts = simhash.segments(4)
    assert sum(b for _, b in cuts) == 64 and len(cuts) == 3
    for _ in range(2000):
        bits = rnd.sample(range(64), 4)
        assert min(sum(first <= b < first + n for b in bits) for first, n in cuts) <= 1


def test_components(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 420)]
    root = roots(421, pairs)
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got.get(i, i) == root[i] for i in range(421))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    x, y = spanning(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert all(root[a] == b for a, b in zip(x.tolist(), y.tolist(), strict=True))
