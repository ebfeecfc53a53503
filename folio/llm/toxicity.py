"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of lexicon words, their nearness to second-person words, capitals, punctuation and
obfuscation. The lexicon is a short list of insults and, for each language of the corpus, the words and word beginnings
that the training rows show to mark toxic documents, ``MAX_UNITS`` of them at most. Training uses a sample of at most ``max_rows``
labelled rows; every document is scored by the same features over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.boosting import Boosted, Isotonic, fit, fit_isotonic
from folio.llm.encoding import slices
from folio.llm.labelled import fold, keep_rows, training_rows

MAX_ROWS = 20_000
#: Words and word beginnings that the training rows may add to the lexicon.
MAX_UNITS = 5000
#: Units that a task counts before it hands their sums on, and bytes of text whose features are worked out at a time.
HELD_UNITS, SLICE = 100_000, 1_000_000
#: A word near a second-person word is at most so many words away.
NEAR = 5
#: Lengths of word beginnings that may enter the lexicon.
PREFIXES = (5, 6, 7)

# Insults, and second-person words of four languages.
INSULTS = frozenset((
    "idiot idiots moron morons stupid trash pathetic disgusting worthless clown clowns scum loser losers dumb imbecile jerk filth vermin retard bastard "
    "fool fools freak freaks creep creeps coward cowards pig pigs cretin cretins dimwit nitwit halfwit brainless useless repulsive scumbag lowlife psycho lunatic maggot maggots parasite parasites asshole bitch shit "
    "dumm dummkopf blödmann trottel depp deppen vollidiot arschloch abschaum versager schwein schweine missgeburt hurensohn wichser spast drecksau widerlich erbärmlich wertlos "
    "imbécile imbéciles crétin crétins connard connards connasse débile débiles abruti abrutis salaud salope ordure minable raclure enculé bouffon dégoûtant stupide "
    "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos tonto tonta cabrón gilipollas basura escoria mierda pendejo inútil payaso payasos asqueroso asquerosa perdedor patético"
).split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tus usted ustedes vosotros".split())
# Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = re.compile(r"^[^\w@$!*]+|[^\w@*]+$")
_INNER = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")
_STRETCH = re.compile(r"(.)\1{2,}")

FEATURES = ("log_words", "insults", "insult_rate", "learned", "learned_rate", "hidden", "hidden_rate", "near_you", "near_you_rate", "you_rate", "capital_rate", "shout_rate", "exclaim_rate", "mark_rate", "digit_rate", "sign_rate", "stretch_rate", "any_hit", "best_learned")


@dataclass
class Lexicon:
    """``learned``: weight of words and, with a trailing ``-``, of word beginnings."""

    learned: dict[str, float] = field(default_factory=dict)

    def classify(self, raw: str) -> tuple[int, float, bool, bool, bool]:
        """(1 insult, 2 hidden insult, 0 neither; weight in the learned lexicon; second person; all capitals; stretched)."""
        word = _EDGES.sub("", raw)
        low = word.lower()
        kind = 0
        if low in INSULTS:
            kind = 1
        elif low:
            plain = _STRETCH.sub(r"\1", _INNER.sub("", low.translate(LEET)))
            if plain in INSULTS or (len(low) > 3 and "*" in low and _masked(low)):
                kind = 2
        weight = 0.0
        if self.learned:
            weight = max(self.learned.get(low, 0.0), *(self.learned.get(low[:n] + "-", 0.0) for n in PREFIXES if len(low) >= n), 0.0)
        return kind, weight, low in SECOND_PERSON, len(word) > 1 and word.isupper(), bool(_STRETCH.search(low))


def _masked(word: str) -> bool:
    return any(len(x) == len(word) and all(a == b or b == "*" for a, b in zip(x, word, strict=True)) for x in INSULTS) and word.count("*") < len(word) - 1


class Featurizer:
    """Features of texts; a word's own part is worked out once for each task and kept."""

    def __init__(self, lexicon: Lexicon, max_cached: int = 200_000) -> None:
        self.lexicon, self.max_cached = lexicon, max_cached
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, 5), np.float32)
        kinds = np.zeros(256, np.int64)  # of bytes: 1 capital, 2 ! or ?, 3 other mark, 4 digit, 5 sign
        for i in range(33, 127):
            c = chr(i)
            kinds[i] = 1 if c.isupper() else 2 if c in "!?" else 3 if c in ".,;:'\"-()" else 4 if c.isdigit() else 5 if not c.isalpha() else 0
        self.kinds = kinds

    def _words(self, found: list[str]) -> np.ndarray:
        """A row for each word. Rows beyond the cache only last for this call."""
        at = np.fromiter(map(self.index.get, found, [-1] * len(found)), np.int64, len(found))
        fresh = {found[i]: None for i in np.flatnonzero(at < 0)}
        if not fresh:
            return self.table[at]
        rows = np.array([self.lexicon.classify(w) for w in fresh], np.float32)
        number = {w: len(self.table) + k for k, w in enumerate(fresh)}
        at[at < 0] = [number[found[i]] for i in np.flatnonzero(at < 0)]
        table = np.concatenate([self.table, rows])
        room = max(0, self.max_cached - len(self.index))
        if room:
            kept = list(number.items())[:room]
            self.table = table[: len(self.table) + len(kept)]
            self.index.update(kept)
        return table[at]

    def features(self, texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        rows = self._words([w for ws in words for w in ws])
        owner = np.repeat(np.arange(len(texts)), counts)
        kind, weight, second, shout, stretched = rows.T if len(rows) else np.zeros((5, 0))
        per = lambda v: np.bincount(owner, v, len(texts))
        insult, hidden, learned = per(kind == 1), per(kind == 2), per(weight > 0)
        best = np.zeros(len(texts))
        np.maximum.at(best, owner, weight)
        hits = np.flatnonzero((kind > 0) | (weight > 0))
        yous = np.flatnonzero(second > 0)
        near = np.zeros(len(texts))
        if len(hits) and len(yous):
            k = np.searchsorted(yous, hits)
            for nth in (k, k - 1):  # the next one and the one before, if the same text has them
                there = (nth >= 0) & (nth < len(yous))
                other, hit = yous[nth[there]], hits[there]
                close = (np.abs(other - hit) <= NEAR) & (owner[other] == owner[hit])
                near += np.bincount(owner[hit[close]], minlength=len(texts))
        content = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, content), np.int64, len(content))
        by = np.bincount(np.repeat(np.arange(len(texts)) * 6, sizes) + self.kinds[np.frombuffer(b"".join(content), np.uint8)], minlength=6 * len(texts)).reshape(-1, 6)
        n, size = np.maximum(counts, 1), np.maximum(sizes, 1)
        columns = (np.log1p(counts), insult, insult / n, learned, learned / n, hidden, hidden / n, near, near / n, per(second) / n, by[:, 1] / size, per(shout) / n, by[:, 2] / size, by[:, 3] / size, by[:, 4] / size, by[:, 5] / size, per(stretched) / n, (insult + hidden > 0) * 1.0, best)
        return np.stack(columns, axis=1)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.apply(self.trees.margin(x))


def learned_lexicon(rows: DataFrame, least: int = 4, ratio: float = 3.0, most: int = MAX_UNITS) -> Lexicon:
    """Words and word beginnings of (text, label) rows that at least ``least`` positive documents hold, and in which positive documents
    outweigh what chance gives by ``ratio`` standard errors and the others two to one. At most ``most`` by weight, then by spelling."""

    def told(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts)), pa.array([c[1] for c in counts.values()]), pa.array([c[0] for c in counts.values()])], names=["unit", "pos", "neg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = set()
                for raw in set(text.lower().split()):
                    word = _EDGES.sub("", raw)
                    if len(word) > 2:
                        units.add(word)
                        units.update(word[:n] + "-" for n in PREFIXES if len(word) >= n)
                for u in units:
                    counts.setdefault(u, [0, 0])[label > 0] += 1
                if len(counts) >= HELD_UNITS:
                    yield told(counts)
                    counts = {}
        if counts:
            yield told(counts)

    totals = {r.label > 0: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    if not pos or not neg:
        return Lexicon()
    summed = rows.select("text", "label").mapInArrow(run, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= least)
    a, b = (F.col("pos") + 0.5) / (pos + 1), (F.col("neg") + 0.5) / (neg + 1)
    summed = summed.withColumn("odds", F.log(a / b)).withColumn("sure", F.col("odds") / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
    chosen = summed.where((F.col("sure") >= ratio) & (F.col("pos") >= 2 * F.col("neg"))).orderBy(F.desc("odds"), "unit").limit(most).collect()
    return Lexicon({r.unit: float(r.odds) for r in chosen})


def train(rows: DataFrame, folds: int = 3) -> ToxicityModel:
    """Fits on (doc_id, text, label) rows. The lexicon and trees behind a row's calibration score are always those of the other folds, so what a lexicon
    owes to the rows that it was read from doesn't pass for skill. Without both labels among the rows the score is their share for every text."""
    parts, margins, truth = [], [], []
    for k in range(folds):
        mine = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(folds)) == k
        parts.append(_matrix(rows.where(mine), learned_lexicon(rows.where(~mine))))
    for k in range(folds):
        x = np.concatenate([p[0] for i, p in enumerate(parts) if i != k])
        y = np.concatenate([p[1] for i, p in enumerate(parts) if i != k])
        margins.append(fit(x, y).margin(parts[k][0]))
        truth.append(parts[k][1])
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(Lexicon(), fit(x, y), Isotonic(np.zeros(1), np.full(1, share)))
    return ToxicityModel(learned_lexicon(rows), fit(x, y), fit_isotonic(np.concatenate(margins), np.concatenate(truth)))


def _matrix(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(lexicon)
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                x = featurizer.features(texts.to_pylist())
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(list(x), pa.list_(pa.float64())), batch.column(2).slice(at, len(texts))], names=["doc_id", "x", "label"])

    found = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, x array<double>, label int").collect()
    found.sort(key=lambda r: (r.doc_id, r.label, r.x))
    return np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([float(r.label > 0) for r in found])


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, lexicon_hits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(model.lexicon)
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                x = featurizer.features(texts.to_pylist())
                hits = (x[:, 1] + x[:, 3] + x[:, 5]).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(model.score(x)), pa.array(hits)], names=["doc_id", "score", "lexicon_hits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, lexicon_hits long")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, lexicon_hits) of every row; learns from at most ``max_rows`` rows that aren't held out.

    Null and empty texts are scored by the features of an empty text; a text of any length is read whole; a null doc_id is scored and
    never learned from; repeated rows stay and score alike; of equal margins all have one score. Without labels every score is 0; an empty table gives
    no rows; other columns are left out, so their names can't clash."""
    model = train(training_rows(docs, labels, "toxic", ~held_out(F.col("doc_id")), max_rows))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lexicon_hits")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, as they were, with all their columns, whatever their names.

    Null and empty texts are scored as empty, repeated rows alike; a text of any length is scored whole; the threshold itself goes; an empty table stays empty; without
    labels every score is 0, so all rows stay."""
    model = train(training_rows(docs, labels, "toxic", ~held_out(F.col("doc_id")), max_rows))

    def judge():
        featurizer = Featurizer(model.lexicon)
        return lambda texts: model.score(featurizer.features(texts)) < threshold

    return keep_rows(docs, judge)
