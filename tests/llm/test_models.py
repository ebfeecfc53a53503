"""The trained operators: their parts against brute force, and accuracy on held-out rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from folio.llm import boosting, labelled, line_crf, toxicity


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    _, inverse, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks[order] = (ends - (counts - 1) / 2)[inverse]
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_isotonic():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=500)
    y = (rnd.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    p = boosting.fit_isotonic(x, y).apply(np.sort(x))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1 and abs(p.mean() - y.mean()) < 0.05


def test_boosting_learns_an_interaction():
    rnd = np.random.default_rng(2)
    x = rnd.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert _auc(boosting.fit(x[:1500], y[:1500]).margin(x[1500:]), y[1500:]) > 0.95


@pytest.mark.parametrize("block", [1, 2, 4, 512])
def test_marginals_against_enumeration(monkeypatch, block):
    monkeypatch.setattr(line_crf, "BLOCK", block)
    rnd = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 5])
    score, trans, start = rnd.normal(size=(9, 2)), rnd.normal(size=(2, 2)), rnd.normal(size=2)
    got, pair, log_z = line_crf.marginals(score, counts, trans, start)
    want, want_pair, want_z, at = np.zeros((9, 2)), np.zeros((2, 2)), 0.0, 0
    for n in counts:
        if not n:
            continue
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.exp([start[p[0]] + sum(score[at + i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        want_z += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for i, s in enumerate(p):
                want[at + i, s] += w
            for a, b in zip(p, p[1:], strict=False):
                want_pair[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(pair, want_pair) and log_z == pytest.approx(want_z)


def test_long_chains_in_blocks(monkeypatch):
    rnd = np.random.default_rng(4)
    counts = np.array([5000, 3, 0, 1700, 512, 513])
    score, trans, start = rnd.normal(size=(int(counts.sum()), 2)), rnd.normal(size=(2, 2)), rnd.normal(size=2)
    got, pair, log_z = line_crf.marginals(score, counts, trans, start)
    monkeypatch.setattr(line_crf, "BLOCK", 10_000)
    want, want_pair, want_z = line_crf.marginals(score, counts, trans, start)
    assert np.allclose(got, want) and np.allclose(pair, want_pair) and log_z == pytest.approx(want_z)


@pytest.mark.parametrize(("run", "label", "folds", "out", "least"), [(toxicity.toxicity, "toxic", 3, 1, 0.8), (line_crf.quality, "quality", 5, 0, 0.95)])
def test_held_out(spark, run, label, folds, out, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == out for i in got.doc_id]).all()
    joined = got.merge(labels.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    assert _auc(held.score.to_numpy(), held[label].to_numpy()) > least
    clean = held[(held.toxic == 0) & (held.quality == 1)]
    assert (clean.predicted == (label == "quality")).mean() > 0.95


@pytest.mark.parametrize("run", [toxicity.toxicity, line_crf.quality])
def test_odd(odd, none, odd_labels, run):
    assert run(odd, odd_labels).count() == odd.count()
    assert {r.score for r in run(odd, odd_labels.where("1 = 0")).collect()} == {0.0}
    assert run(none, odd_labels).count() == 0


def test_hidden_words():
    kind = lambda w: toxicity.Lexicon().classify(w)[0]
    assert [kind(w) for w in ("idiot", "IDIOT!!", "1d10t", "i.d.i.o.t", "idiooot", "st*pid", "paris", "class", "****")] == [1, 1, 2, 2, 2, 2, 0, 0, 0]


def test_whole_rows_stay(odd, none, odd_labels):
    """Both filters give whole rows back: nulls, empty and long texts, repeated rows, empty tables, columns of any name."""
    for run in (toxicity.without_toxic, line_crf.without_low_quality):
        stay = run(odd, odd_labels)
        assert stay.columns == odd.columns and stay.exceptAll(odd).isEmpty()
        assert run(none, odd_labels).count() == 0
    nothing = odd_labels.where("1 = 0")
    assert toxicity.without_toxic(odd, nothing).count() == odd.count()  # every score is 0
    assert line_crf.without_low_quality(odd, nothing).count() == 0


def test_sample_is_bounded(spark):
    """A doc_id that many rows have is one training row, labels without a document take no place, and the largest label counts."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 200)] + [(2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    rows = labelled.training_rows(docs, labels, "toxic", F.col("doc_id") > 0, 1)
    assert rows.count() == 1
    rows = {r.doc_id: (r.text, r.label) for r in labelled.training_rows(docs, labels, "toxic", F.col("doc_id") > 0, 100).collect()}
    assert rows == {1: ("text 0", 1), 2: ("", 1), 3: ("c", 1)}
    assert labelled.training_rows(docs, labels, "toxic", F.col("doc_id") > 1, 100).count() == 2


PROSE = ["The river runs past the old mill and the road turns north.", "Most of the houses were built after the second war.", "In spring the valley is green and the paths are wet.", "They walked for hours before the rain began to fall."]
JUNK = ["||| $$$ ### 12 34 56 ||| >>> BUY NOW !!!", "@@@ === 99 %% CLICK {HERE} [] 77 88", "### ### ||| ~~~ 1 2 3 4 5 6 7 8 9", "<<>> $$$ WIN WIN WIN !!! ||| 00 00"]


def test_line_labels_change_within_documents(spark):
    """Good documents have some junk lines and bad ones some prose; the chain tells lines apart where only documents are labelled."""
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(300):
        lines = [(PROSE if (rnd.random() < 0.75) == (i % 2 == 0) else JUNK)[rnd.integers(4)] for _ in range(rnd.integers(5, 12))]
        rows.append((i, "\n".join(lines), i % 2 ^ 1))
    model = line_crf.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    halves = spark.createDataFrame([(0, "\n".join(PROSE + JUNK)), (1, "\n".join(JUNK + PROSE)), (2, "\n".join(PROSE)), (3, None)], "doc_id long, text string")
    got = line_crf.label_lines(halves, model).orderBy("doc_id", "line").collect()
    right = [r.good == w for r, w in zip(got, [True] * 4 + [False] * 8 + [True] * 8, strict=True)]
    assert sum(right[:16]) >= 14 and all(right[16:])  # the lines beside a change lean on their neighbours
    scores = {r.doc_id: r for r in line_crf.score_documents(halves, model).collect()}
    assert 3 <= scores[0].good_lines <= 5 and scores[0].n_lines == 8 and scores[2].score > scores[0].score and scores[3].n_lines == 0


def test_relabel_keeps_half_of_each_document():
    rnd = np.random.default_rng(6)
    counts = rnd.integers(0, 6, 50)
    labels, chars = rnd.integers(0, 2, 50), rnd.integers(1, 9, counts.sum()).astype(float)
    good = rnd.random(counts.sum())
    y, at = line_crf.relabel(good, chars, counts, labels), 0
    for n, label in zip(counts.tolist(), labels.tolist(), strict=True):
        own, size, marginal = y[at : at + n], chars[at : at + n], good[at : at + n]
        assert 2 * size[own == label].sum() >= size.sum()
        assert all(o in (label, int(m >= 0.5)) for o, m in zip(own, marginal, strict=True))
        at += n


def test_training_lines_are_bounded(spark):
    rows = spark.createDataFrame([(i, "\n".join(PROSE * (50 if i == 3 else 1)), i % 2) for i in range(20)], "doc_id long, text string, label int")
    x, chars, counts, labels = line_crf._sample(rows, 40)
    assert len(x) == len(chars) == counts.sum() == 40 and len(labels) == 10 and counts.max() == 4


def test_trees_against_exact_splits():
    """With few distinct values every threshold is a bin edge, so one round is the best tree of its depth by exhaustive greedy search."""
    rnd = np.random.default_rng(7)
    x = rnd.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] > 3) | (rnd.random(400) < 0.1)).astype(float)
    penalty, rate, least = 1.0, 0.2, 0.3
    model = boosting.fit(x, y, rounds=1, depth=2, rate=rate, least=least, penalty=penalty)
    base = np.log(y.mean() / (1 - y.mean()))
    p = np.full(400, y.mean())
    g, h = p - y, p * (1 - p)

    def grow(rows, depth):
        best = (1e-9, None, None)
        if depth:
            for j in range(3):
                for t in np.unique(x[rows, j])[:-1]:
                    left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    if h[left].sum() < least or h[right].sum() < least:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
        out = np.zeros(400)
        if best[1] is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + penalty)
            return out
        return grow(best[1], depth - 1) + grow(best[2], depth - 1)

    assert np.allclose(model.margin(x), base + rate * grow(np.arange(400), 2))


def test_isotonic_against_enumeration():
    """Without a prior the fit is the best non-decreasing one: no choice of blocks has less squared error."""
    rnd = np.random.default_rng(8)
    for _ in range(30):
        y = rnd.integers(0, 2, 8).astype(float)
        got = boosting.fit_isotonic(np.arange(8.0), y, prior=0.0)
        fits = []
        for cuts in range(128):
            blocks = np.split(np.arange(8), [i + 1 for i in range(7) if cuts >> i & 1])
            means = [y[b].mean() for b in blocks]
            if (np.diff(means) > 0).all():
                fits.append((round(sum(((y[b] - m) ** 2).sum() for b, m in zip(blocks, means, strict=True)), 9), len(blocks), [b.mean() for b in blocks], means))
        _, _, at, value = min(fits)
        assert np.allclose(got.at, at) and np.allclose(got.value, value)
        assert (np.diff(got.value) >= 0).all()


def _plain_features(text, lexicon):
    """The features of one text, each worked out on its own."""
    import math

    words = text.split()
    told = [lexicon.classify(w) for w in words]
    n, size = max(1, len(words)), max(1, len(text.encode()))
    insults, hidden = sum(t[0] == 1 for t in told), sum(t[0] == 2 for t in told)
    learned = sum(t[1] > 0 for t in told)
    yous = [i for i, t in enumerate(told) if t[2]]
    near = 0
    for i, t in enumerate(told):
        if (t[0] or t[1] > 0) and yous:
            sides = [j for j in yous if j >= i][:1] + [j for j in yous if j < i][-1:]
            near += sum(abs(j - i) <= toxicity.NEAR for j in sides)
    share = lambda test: sum(test(c) for c in text if ord(c) < 127) / size
    marks = ".,;:'\"-()"
    return [
        math.log1p(len(words)), insults, insults / n, learned, learned / n, hidden, hidden / n, near, near / n, len(yous) / n, share(str.isupper), sum(t[3] for t in told) / n,
        share(lambda c: c in "!?"), share(lambda c: c in marks), share(str.isdigit), share(lambda c: 33 <= ord(c) and not c.isalnum() and c not in "!?" + marks), sum(t[4] for t in told) / n, float(insults + hidden > 0), max((t[1] for t in told), default=0.0),
    ]


def test_features_are_the_plain_ones():
    rnd = random.Random(9)
    parts = ["you", "idiot", "1d1ot", "st*pid", "WORD", "sooooo", "du", "Depp!", "badword", "prefixed", "x" * 30, "...", "é", "n0w", "$$$", "plain", "tú", "payaso,", "\n", "(a)"]
    texts = ["", " ", *(" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    lexicon = toxicity.Lexicon({"badword": 2.0, "prefi-": 1.5})
    for cached in (0, 5, 1000):
        got = toxicity.Featurizer(lexicon, cached).features(texts)
        assert np.allclose(got, [_plain_features(t, lexicon) for t in texts], atol=1e-6)
