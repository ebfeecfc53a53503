"""Near copies by shingle similarity against brute force."""

from __future__ import annotations

import random

import numpy as np
from brute import similar_left
from corpus_pipeline import near_dedup

from folio.llm import jaccard
from folio.llm.rows import numbered
from folio.llm.simhash import without_near_copies


def _left(rows):
    return [r.doc_id for r in similar_left(rows)]


def _edited(rnd, words_, n):
    out = list(words_)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_of_changed_words(spark):
    """Texts of 300 words with 1 to 8 of them replaced: similarities about 0.77 to 0.97."""
    rnd = random.Random(11)
    rows, i = [(0, ""), (1, None), (2, "Ab c"), (3, "aB  c")], 4
    for _ in range(60):
        text = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        for n in (0, 1 + rnd.randrange(8)):
            rows.append((i, _edited(rnd, text, n)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _left(sorted(docs.collect(), key=lambda r: r.doc_id))
    assert 64 < len(want) < 100
    assert sorted(r.doc_id for r in near_dedup(spark, docs, "").collect()) == want


def test_large_group(spark):
    """A group of more near copies than a bucket compares in full."""
    rnd = random.Random(12)
    text = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = [(i, _edited(rnd, text, 1 + i % 2)) for i in range(400)] + [(1000 + i, _edited(rnd, text, 200)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == _left(docs.orderBy("doc_id").collect())


def test_groups_that_pivots_leave_apart(spark, monkeypatch):
    """Buckets over the limits, many components in one bucket, and copies of one set for many pairs: nothing is lost."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "FAN", 3)
    rnd = random.Random(13)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows, i = [], 0
    for _ in range(12):
        middle = _edited(rnd, base, 14).split()  # of similarity about 0.6 to each other
        for n in range(5):
            rows.append((i, _edited(rnd, middle, n)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _left(docs.orderBy("doc_id").collect())
    assert 1 < len(want) < 40
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == want


def test_rows_that_a_bucket_of_many_alike_sends_on(spark, monkeypatch):
    """Each text has four words of one changed, far from the others': all pairs agree in most of their signatures, none is similar. Open buckets send on fewer rows than they have."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(f"new{i}" if j % 75 == 5 * i else word for j, word in enumerate(base))) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts, dealt = [], jaccard._open_pairs

    def counted(at, *more):
        out = dealt(at, *more)
        counts.append((at.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_open_pairs", counted)
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == _left(docs.orderBy("doc_id").collect())
    assert counts and all(out < rows for rows, out in counts)


def test_odd(odd, none):
    stay = without_near_copies(odd)
    assert stay.columns == odd.columns and {r["__row"] for r in stay.collect()} == {3} and without_near_copies(none).count() == 0
    seen = odd.collect()
    assert stay.count() == len(_left(sorted(seen, key=lambda r: (r.doc_id is None, r.doc_id or 0))))


def test_sets_are_signed_by_the_worker_that_makes_them(spark):
    """A task over the texts holds one worker, not one for sets and another for signatures."""
    docs, key = numbered(spark.createDataFrame([(i, " ".join(f"w{i % 3}x{j}" for j in range(20 + i))) for i in range(12)], "doc_id long, text string").repartition(2))
    found = jaccard._chosen_sets(docs, key, docs.where("doc_id % 2 = 0").select(docs[key].alias("row")), 5, "text", signed=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = found.collect()
    assert sorted(len(r.shingles) for r in rows) == [16 + i for i in range(0, 12, 2)]
    assert [bytes(r.sig) for r in rows] == [x.tobytes() for x in jaccard.signatures([np.array(r.shingles, np.int64).view(np.uint64) for r in rows])]
