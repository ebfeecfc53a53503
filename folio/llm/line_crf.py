"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word is labelled good or bad. A line's features are its own shape (length, character classes,
repeated words) and that of the lines before and behind it. Only documents have labels, so those of lines are hidden: at
first each line has its document's, then rounds of training and relabelling follow, in which lines that make up at least
half of a document's length keep its label and the others take that of their own marginal. So good documents may have bad
lines, and the chain learns where labels change. Forward-backward gives each line's marginal of being good, and their
mean, weighted by the lines' lengths, is calibrated to the document's probability by isotonic regression. Training uses at most ``MAX_ROWS``
labelled documents, and of these, in the order of their doc_ids' hashes, those that fit into ``MAX_LINES`` lines together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.boosting import Isotonic, fit_isotonic
from folio.llm.encoding import slices
from folio.llm.labelled import fold, keep_rows, training_rows
from folio.storage import cut

MAX_ROWS = 6_000
#: Lines of a chain that step one after another.
BLOCK = 512
MAX_LINES = 150_000
#: Rounds of relabelling, and steps of the first fit and of those that go on from it.
ROUNDS, FIRST_STEPS, NEXT_STEPS = 3, 100, 30
WHITE = " \t\n\x0b\x0c\r"
OWN = ("log_chars", "log_words", "letters", "capitals", "digits", "exclaims", "signs", "bars", "stops", "word_chars", "distinct", "same_next", "long_word", "seen", "ends")
#: Own features, those of the line before and of the line behind, and whether there is one.
N_FEATURES = 3 * len(OWN) + 2

_KINDS = np.zeros(256, np.int64)  # of bytes: 1 letter, 2 capital, 3 digit, 4 ! or ?, 5 sign, 6 bar, 7 stop
for _i in range(256):
    _c = chr(_i)
    _KINDS[_i] = 1 if _i >= 128 or "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() else 4 if _c in "!?" else 6 if _c == "|" else 5 if _c in "#*$%&<>@^~=+{}[]\\_/" else 7 if _c in ".,;:" else 0


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its characters, lines of each text)."""
    lines, counts, stats = [], np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        earlier: set[str] = set()
        for line in text.split("\n"):
            words = line.split()
            if not words:
                continue
            lines.append(line)
            counts[i] += 1
            n = len(words)
            stats.append((len(line), n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, max(map(len, words)), line in earlier, line.rstrip(WHITE)[-1:] in ".!?"))
            earlier.add(line)
    m = len(lines)
    if not m:
        return np.zeros((0, N_FEATURES)), np.zeros(0), counts
    content = [x.encode() for x in lines]
    sizes = np.fromiter(map(len, content), np.int64, m)
    by = np.bincount(np.repeat(np.arange(m) * 8, sizes) + _KINDS[np.frombuffer(b"".join(content), np.uint8)], minlength=8 * m).reshape(-1, 8) / sizes[:, None]
    s = np.array(stats, float)
    own = np.stack([np.log1p(s[:, 0]) / 5, np.log1p(s[:, 1]) / 4, by[:, 1], by[:, 2], by[:, 3] * 4, by[:, 4] * 4, by[:, 5] * 4, by[:, 6] * 8, by[:, 7] * 4, np.minimum(s[:, 0] / s[:, 1], 30) / 10, s[:, 2], s[:, 3], np.log1p(s[:, 4]) / 4, s[:, 5], s[:, 6]], axis=1)
    first = np.zeros(m, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    last = np.zeros(m, bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    before, behind = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], behind[last] = 0, 0
    return np.concatenate([own, before, behind, first[:, None] * 1.0, last[:, None] * 1.0], axis=1), s[:, 0], counts


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(score: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once. ``score``: each line's (bad, good) scores; chains are runs of ``counts`` lines.

    Chains are cut in blocks of ``BLOCK`` lines that step side by side. What a block does to the state at its first line is a product of 2 x 2 matrices; with those,
    states pass from block to block first. So steps grow with BLOCK and the blocks of the longest chain, not with its lines.
    Returns each line's label marginals, the summed marginals of neighbouring label pairs, and the summed log partition."""
    chains = np.flatnonzero(counts)
    if not len(chains):
        return score, np.zeros((2, 2)), 0.0
    n_blocks = -(-counts[chains] // BLOCK)
    chain = np.repeat(np.arange(len(chains)), n_blocks)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = (np.cumsum(counts) - counts)[chains][chain] + nth * BLOCK
    size = np.minimum(BLOCK, counts[chains][chain] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[0]])
    live = [order[: int(np.searchsorted(-size[order], -t, side="left"))] for t in range(steps)]  # blocks with more than t lines
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    entry, leave = start + score[begin], np.zeros((len(chain), 2))  # alpha of a block's first line, beta of its last one
    if len(chain) > len(chains):
        through = np.tile(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (len(chain), 1, 1))  # from the first line's state to the last one's
        for t in range(1, steps):
            some = live[t]
            through[some] = _soft(through[some][:, :, :, None] + trans, 2) + score[begin[some] + t][:, None, :]
        turn = np.argsort(nth, kind="stable")
        edges = np.searchsorted(nth[turn], np.arange(int(nth.max()) + 2))
        for j in range(1, len(edges) - 1):
            some = turn[edges[j] : edges[j + 1]]
            entry[some] = _soft(_soft(entry[some - 1][:, :, None] + through[some - 1], 1)[:, :, None] + trans, 1) + score[begin[some]]
        for j in range(len(edges) - 2, 0, -1):
            some = turn[edges[j] : edges[j + 1]]
            ahead = score[begin[some]] + _soft(through[some] + leave[some][:, None, :], 2)
            leave[some - 1] = _soft(trans + ahead[:, None, :], 2)
    alpha[begin], beta[begin + size - 1] = entry, leave
    for t in range(1, steps):
        at = begin[live[t]] + t
        alpha[at] = score[at] + _soft(alpha[at - 1][:, :, None] + trans, 1)
    log_z = _soft(alpha[(begin + size - 1)[np.append(nth[1:] == 0, True)]], 1)
    pair = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[live[t + 1]] + t
        ahead = trans + (score[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = _soft(ahead, 2)
        pair += np.exp(alpha[at][:, :, None] + ahead - log_z[chain[live[t + 1]], None, None]).sum(axis=0)
    later = np.flatnonzero(nth > 0)
    if len(later):
        at = begin[later]
        pair += np.exp(alpha[at - 1][:, :, None] + trans + (score[at] + beta[at])[:, None, :] - log_z[chain[later], None, None]).sum(axis=0)
    of = np.repeat(np.arange(len(chains)), counts[chains])
    return np.exp(alpha + beta - log_z[of][:, None]), pair, float(log_z.sum())


@dataclass
class LineModel:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray  # of features, for good against bad
    trans: np.ndarray
    start: np.ndarray
    calibration: Isotonic

    def good_share(self, x: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each text's length-weighted mean of its lines' marginals of being good, each line's marginal). Texts without lines have 0."""
        good = self._good(x, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, chars, len(counts))
        return np.bincount(owner, chars * good, len(counts)) / np.maximum(total, 1), good

    def _good(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        score = np.zeros((len(x), 2))
        score[:, 1] = _standard(x, self.mean, self.spread) @ self.weight
        return np.clip(marginals(score, counts, self.trans, self.start)[0][:, 1], 0, 1)


def _standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip((x - mean) / spread, -5, 5), np.ones((len(x), 1))], axis=1)


def fit_chain(x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = FIRST_STEPS, rate: float = 0.1, penalty: float = 1e-3, begin: LineModel | None = None) -> LineModel:
    """Maximum conditional likelihood by Adam over all chains, whose lines have the labels ``y``; goes on from ``begin`` if there is one."""
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = _standard(x, mean, spread)
    inside = np.ones(len(y), bool)
    inside[(np.cumsum(counts) - counts)[counts > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inside) - 1], y[inside]), 1)
    begun = np.bincount(y[~inside], minlength=2).astype(float)
    params = np.zeros(z.shape[1] + 6) if begin is None else np.concatenate([begin.weight, begin.trans.ravel(), begin.start])
    m, v = np.zeros_like(params), np.zeros_like(params)
    target = z.T @ y
    n = max(1, len(y))
    for step in range(1, steps + 1):
        w, trans, start = params[:-6], params[-6:-2].reshape(2, 2), params[-2:]
        score = np.zeros((len(z), 2))
        score[:, 1] = z @ w
        p, pair, _ = marginals(score, counts, trans, start)
        firsts = p[~inside].sum(axis=0) if len(p) else np.zeros(2)
        g = np.concatenate([target - z.T @ p[:, 1], (seen - pair).ravel(), begun - firsts]) / n - penalty * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineModel(mean, spread, params[:-6], params[-6:-2].reshape(2, 2), params[-2:], Isotonic(np.zeros(1), np.zeros(1)))


def relabel(good: np.ndarray, chars: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Line labels: the lines that fit a document's label best, up to half of its length, have it, and others what their marginal says."""
    owner = np.repeat(np.arange(len(counts)), counts)
    own = labels[owner]
    fit = np.where(own == 1, good, 1 - good)
    order = np.lexsort((np.arange(len(owner)), -fit, owner))
    before = np.cumsum(chars[order]) - chars[order]
    first = (np.cumsum(counts) - counts)[counts > 0]
    before -= np.repeat(before[first], counts[counts > 0])
    needed = np.zeros(len(owner), bool)
    needed[order] = 2 * before < np.bincount(owner, chars, len(counts))[owner]
    return np.where(needed, own, good >= 0.5).astype(np.int64)


def fit_hidden(x: np.ndarray, chars: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> LineModel:
    """A chain whose line labels are learned from those of documents."""
    model = fit_chain(x, counts, np.repeat(labels, counts))
    for _ in range(rounds):
        model = fit_chain(x, counts, relabel(model._good(x, counts), chars, counts, labels), NEXT_STEPS, begin=model)
    return model


def _sample(rows: DataFrame, max_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, lines of each document, labels) of training rows, as far as ``max_lines`` lines go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                x, chars, counts = line_features(texts.to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)])
                flat = np.concatenate([x, chars[:, None]], axis=1).astype(np.float32)
                pieces = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(counts), pa.array(pieces, pa.binary())], names=["doc_id", "label", "n", "x"])

    held = cut(rows.mapInArrow(run, "doc_id long, label int, n long, x binary"), "line-features")
    chosen, left = [], max_lines
    for r in held.select("doc_id", "n", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():  # a row for each document of the sample
        if r.n <= left:
            chosen.append((r.doc_id,))
            left -= r.n
    if not chosen:
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = held.join(F.broadcast(rows.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # so that folds don't follow an order of the labels
    every = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES + 1) for r in found]).astype(float)
    return every[:, :-1], every[:, -1], np.array([r.n for r in found], np.int64), np.array([int(r.label > 0) for r in found])


def train(rows: DataFrame, folds: int = 2, max_lines: int = MAX_LINES) -> LineModel:
    """Fits on (doc_id, text, label) rows; calibration uses shares from a chain fitted on the other fold. Without both labels among the rows the score is their share for every text."""
    x, chars, counts, labels = _sample(rows, max_lines)
    if len(np.unique(labels)) < 2:
        model = fit_chain(x[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), steps=0)
        model.calibration = Isotonic(np.zeros(1), np.full(1, float(labels.mean()) if len(labels) else 0.0))
        return model
    shares = np.zeros(len(labels))
    for k in range(folds):
        mine = np.arange(len(labels)) % folds == k
        rows_of = np.repeat(mine, counts)
        part = fit_hidden(x[~rows_of], chars[~rows_of], counts[~mine], labels[~mine])
        shares[mine] = part.good_share(x[rows_of], chars[rows_of], counts[mine])[0]
    model = fit_hidden(x, chars, counts, labels)
    model.calibration = fit_isotonic(shares, labels.astype(float))
    return model


def score_documents(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, good_lines) of every row; good_lines have a marginal of a half or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                x, chars, counts = line_features(texts.to_pylist())
                share, good = model.good_share(x, chars, counts)
                n_good = np.bincount(np.repeat(np.arange(len(counts)), counts), good >= 0.5, len(counts)).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(model.calibration.apply(share)), pa.array(counts), pa.array(n_good)], names=["doc_id", "score", "n_lines", "good_lines"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_lines long, good_lines long")


def label_lines(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, marginal, good): every line that holds a word, by its number among those of its text, with its marginal of being good and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                x, chars, counts = line_features(texts.to_pylist())
                good = model.good_share(x, chars, counts)[1]
                owner = np.repeat(np.arange(len(counts)), counts)
                line = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)).take(pa.array(owner)), pa.array(line), pa.array(good), pa.array(good >= 0.5)], names=["doc_id", "line", "marginal", "good"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, line long, marginal double, good boolean")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, good_lines) of every row; learns from at most ``max_rows`` rows that aren't held out.

    Null and empty texts are scored as a text of bad lines; a text of any length is read whole; a null doc_id is scored and never learned
    from; repeated rows stay and score alike; texts of equal share have one score. Without labels every score is 0; an empty table gives no rows; other columns are
    left out, so their names can't clash."""
    model = train(training_rows(docs, labels, "quality", ~held_out(F.col("doc_id")), max_rows))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "good_lines")


def without_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they were, with all their columns, whatever their names.

    Null and empty texts are scored as a text of bad lines, repeated rows alike; a text of any length is scored whole; the threshold itself stays; an empty table stays
    empty; without labels every score is 0, so no row stays."""
    model = train(training_rows(docs, labels, "quality", ~held_out(F.col("doc_id")), max_rows))
    return keep_rows(docs, lambda: lambda texts: model.calibration.apply(model.good_share(*line_features(texts))[0]) >= threshold)
