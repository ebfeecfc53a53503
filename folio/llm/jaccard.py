"""Near copies by the Jaccard similarity of word shingles, over SimHash links and MinHash bands.

Texts of equal shingle sets are one node. Pairs of nodes are retrieved in steps, and after each one the exact sets decide which of them
are similar and join components; pairs within a component need no look.

* Fingerprints that differ by few bits (``simhash.links``) join most copies of a group by a spanning forest.
* Buckets: two sets of similarity J share one of ``BANDS`` bands of ``ROWS`` least hashes with a probability of
  1 - (1 - J ** ROWS) ** BANDS, 0.9996 at 0.8. In a bucket of up to ``SMALL`` nodes all pairs over different components are compared. In a
  larger one all nodes outside its largest component first meet ``PIVOTS`` nodes of that.
* Large buckets that still hold several components are dealt in pairs of blocks, so that each node outside the largest one meets all others. A
  node's row has its set and a signature of ``SIGNATURE`` bytes, each of another least hash. Pairs whose signatures agree nearly as often as
  similar sets' do (within four standard deviations, so 0.9999 of those at 0.8) are compared in the task by the sets, and what is similar leaves it
  as a spanning forest of the components: fewer rows than came in, however many pairs are alike. No bucket is cut short.

Pairs whose sizes rule the similarity out are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.llm.encoding import binary_column, flat_values, give_back, slices
from folio.llm.rows import chooser
from folio.llm.shingles import distinct_runs, majority_bits, shingle_hashes
from folio.llm.simhash import links
from folio.llm.spread import spread_join, with_hot
from folio.storage import cut

BANDS, ROWS = 20, 5
#: Nodes of a bucket that are all compared; nodes of a larger one that others meet first.
SMALL, PIVOTS = 64, 4
#: Least hashes that a signature has a byte of, and values (64 to a signature, and those of sets) that a task takes at a time.
SIGNATURE, SIGNED_VALUES = 512, 4_000_000
#: Nodes of a block where a large bucket is dealt in pairs of blocks, and values of their sets on average.
BLOCK, BLOCK_VALUES = 1024, 1_000_000
#: Partners of a node that are compared first, those whose signatures agree best, and values of sets that are compared at once.
FIRST, COMPARED = 4, 2_000_000
#: Rows paired at a time: a row has under SMALL pairs in a small bucket, so this bounds what a task holds.
CHUNK = 50_000
#: Pairs with one set in a task.
FAN = 1024
#: Bytes of text that a task sketches at a time.
SKETCH_BYTES = 500_000

_ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = np.random.default_rng(43).integers(0, 1 << 63, (2, SIGNATURE), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set; empty sets have zeros."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        values = np.concatenate([sets[i] for i in some])
        first = np.cumsum(sizes[some]) - sizes[some]
        for j in range(BANDS * ROWS):
            out[some, j // ROWS] += (np.minimum.reduceat(values * _ODD[0, j], first) ^ np.uint64(j)) * _ODD[1, j]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SIGNATURE`` bytes for each set, none of them empty: a hash of each least hash. Sets of similarity J agree in about J + (1 - J) / 256 of them."""
    values, sizes = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), SIGNATURE), np.uint8)
    first = np.cumsum(sizes) - sizes
    for j in range(SIGNATURE if len(sets) else 0):
        out[:, j] = (np.minimum.reduceat(values * _SIGNED[0, j], first) * _SIGNED[1, j]) >> np.uint64(56)
    return out


def _least_agreeing(similar: float) -> float:
    """The share of a signature in which sets of ``similar`` agree but for four standard deviations."""
    return similar - 4 * (similar * (1 - similar) / SIGNATURE) ** 0.5


def _set_hash(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), 42)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(docs: DataFrame, key: str, words: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, fp, sim, m, keys): hash of the shingle set, SimHash of the shingles, size of the set, its bands (none if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2), SKETCH_BYTES):
                values, counts = shingle_hashes(texts.to_pylist(), words)
                sets = distinct_runs(values, counts)
                fp, m = np.array([_set_hash(s) for s in sets], np.uint64), np.array([len(s) for s in sets], np.int64)
                keys = _lists(band_keys(sets)[m > 0].reshape(-1), (m > 0) * BANDS)
                columns = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(fp.view(np.int64)), pa.array(majority_bits(values, counts).view(np.int64)), pa.array(m), keys]
                yield pa.record_batch(columns, names=["row", "doc_id", "fp", "sim", "m", "keys"])

    rows = docs.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long, sim long, m long, keys array<long>")


def _fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(x, y): each node with the least of its fingerprint, and the least nodes of linked fingerprints."""
    least = cut(nodes.groupBy("sim").agg(F.min("fp").alias("least")), "least-nodes")
    same = spread_join(nodes.select("sim", "fp"), least, ["sim"]).where("fp <> least").select(F.col("fp").alias("x"), F.col("least").alias("y"))
    linked = cut(links(least.select(F.col("sim").alias("fp")), distance), "fingerprint-links")
    half = cut(spread_join(linked.select(F.col("a").alias("sim"), "b"), least, ["sim"]).select(F.col("least").alias("x"), F.col("b").alias("sim")), "half-links")
    return same.unionByName(spread_join(half, least, ["sim"]).select("x", F.col("least").alias("y")))


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(key, fp, m, root) of nodes (fp, m, root, keys)."""
    return nodes.select(F.explode("keys").alias("key"), "fp", "m", "root")


def _pairs(group: np.ndarray, fp: np.ndarray, m: np.ndarray, root: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs over different components of each group, for rows sorted by group, of sizes that allow the similarity."""
    edges = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    sizes = np.diff(np.append(edges, len(group)))
    at = np.arange(len(group))
    left = np.repeat(edges + sizes, sizes) - at - 1  # rows of the group behind each
    a, b = [fp[:0]], [fp[:0]]
    for shift in range(1, int(sizes.max(initial=0))):
        at = at[left[at] >= shift]
        fits = at[(root[at] != root[at + shift]) & (np.minimum(m[at], m[at + shift]) >= similar * np.maximum(m[at], m[at + shift]))]
        a.append(fp[fits])
        b.append(fp[fits + shift])
    return np.concatenate(a), np.concatenate(b)


def _held(column: pa.Array) -> np.ndarray:
    """A column's values; signatures come as a matrix, sets as an array of arrays."""
    if pa.types.is_binary(column.type):
        return flat_values(column, np.uint8).reshape(-1, SIGNATURE)
    if not pa.types.is_list(column.type):
        return column.to_numpy()
    out = np.empty(len(column), object)
    ends = np.cumsum(column.value_lengths().to_numpy())
    for i, own in enumerate(np.split(column.flatten().to_numpy(), ends[:-1])):
        out[i] = own
    return out


def _grouped(batches: Iterator[pa.RecordBatch], columns: int, chunk: int = CHUNK) -> Iterator[tuple]:
    """Runs of whole groups (equal first column) of about ``chunk`` rows, or values where there are sets (the last column), as arrays."""
    held: list[tuple] = []
    size = 0
    weight = lambda x: len(x[0]) * (SIGNATURE // 8) + sum(map(len, x[-1])) if x[-1].dtype == object else len(x[0])
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(map(_held, batch.columns[:columns])))
        size += weight(held[-1])
        if size >= chunk:
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
            held = [tuple(x[end:] for x in whole)]
            size = weight(held[0])
            if end:
                yield tuple(x[:end] for x in whole)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
    held = []
    give_back()


def _batches(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(x), CHUNK):
        yield pa.record_batch([pa.array(x[i : i + CHUNK]), pa.array(y[i : i + CHUNK])], names=["x", "y"])


def _small_bucket_pairs(rows: DataFrame, similar: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, m, root in _grouped(batches, 4):
            yield from _batches(*_pairs(group, fp, m, root, similar))

    return rows.select("key", "fp", "m", "root").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "x long, y long")


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """Nodes outside a bucket's largest component with PIVOTS of that. rows: key, fp, root; a written table."""
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = cut(by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top")), "largest-roots")
    held = cut(spread_join(rows.select("key", "fp", "root"), largest, ["key"]), "bucket-roots")
    first = held.where("root = top").groupBy("key", F.pmod(F.xxhash64("fp"), F.lit(PIVOTS)).alias("part")).agg(F.min("fp").alias("y"))
    pivots = cut(first.groupBy("key").agg(F.collect_list("y").alias("pivots")), "pivots")  # PIVOTS of them for a key
    others = cut(held.where("root <> top").select("key", "fp"), "other-nodes")
    return spread_join(others, pivots, ["key"]).select(F.col("fp").alias("x"), F.explode("pivots").alias("y"))


def _joining(fp: np.ndarray, m: np.ndarray, root: np.ndarray, own: np.ndarray, sig: np.ndarray, sets: np.ndarray, similar: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the components of a pair of blocks, by similar sets: a node outside the largest component is compared with all nodes of others
    (of the other block, where there are two), and what has been joined is one component from then on."""
    _, label, sizes = np.unique(root, return_inverse=True, return_counts=True)
    x, y = [], []
    if len(sizes) < 2:
        return x, y
    two, top, least = len(np.unique(own)) > 1, int(sizes.argmax()), _least_agreeing(similar) * SIGNATURE
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(m) - m
    marked = np.zeros(int(code.max()) + 1, np.uint8)
    for i in np.flatnonzero(label != top).tolist():
        if label[i] == top:  # what it is still apart from meets it in its own turn
            continue
        fits = (label != label[i]) & (np.minimum(m, m[i]) >= similar * np.maximum(m, m[i]))
        j = np.flatnonzero(fits & (own != own[i]) if two else fits)
        agreeing = (sig[j] == sig[i]).sum(axis=1)
        j = j[np.argsort(-agreeing, kind="stable")][: int((agreeing >= least).sum())]
        if not len(j):
            continue
        mine = code[first[i] : first[i] + m[i]]
        marked[mine] = 1
        at = 0
        while at < len(j):
            to = FIRST if not at else max(at + 1, at + int(np.searchsorted(np.cumsum(m[j[at:]]), COMPARED)))
            some, at = j[at:to], to
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            begin = np.cumsum(m[some]) - m[some]
            place = np.repeat(first[some] - begin, m[some]) + np.arange(int(m[some].sum()))
            common = np.add.reduceat(marked[code[place]], begin, dtype=np.int64)
            alike = some[common >= similar * (m[i] + m[some] - common)]
            joined, once = np.unique(label[alike], return_index=True)
            x += [fp[i]] * len(once)
            y += fp[alike[once]].tolist()
            label[np.isin(label, [label[i], *joined])] = top if top in joined else label[i]
        marked[mine] = 0
    return x, y


def _open_pairs(rows: DataFrame, open_keys: DataFrame, signed: DataFrame, similar: float) -> DataFrame:
    """(x, y): similar pairs that join the components of the buckets ``open_keys`` as far as their similar sets do.

    rows: key, fp, m, root; a written table. signed: fp, sig, shingles. Nodes outside a bucket's largest component lie in blocks before the
    others'; each of these blocks meets all blocks. Only numbers are dealt by key; signatures and sets are joined to them after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, *columns in _grouped(batches, 7, SIGNED_VALUES):
            edges = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
                yield from _batches(*(np.array(z, np.int64) for z in _joining(*(c[a:b] for c in columns), similar)))

    blocks = lambda n, values: F.greatest(F.ceil(F.col(n) / F.lit(BLOCK)), F.ceil(F.col(values) / F.lit(BLOCK_VALUES)), F.lit(1)).cast("int")
    known = open_keys.select("key", "top", blocks("others", "other_values").alias("outside"), blocks("inner", "inner_values").alias("inside"))
    is_top, part = F.col("root") == F.col("top"), F.xxhash64("fp")
    own = F.when(is_top, F.col("outside") + F.pmod(part, "inside")).otherwise(F.pmod(part, "outside")).cast("long")
    last = F.col("outside") + F.when(is_top, 0).otherwise(F.col("inside")) - 1
    dealt = spread_join(rows, known, ["key"]).select("key", "fp", "m", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("pair")
    wide = dealt.select(pair, "fp", "m", "root", "own").join(signed, "fp").select("pair", "fp", "m", "root", "own", "sig", "shingles")
    return wide.repartition("pair").sortWithinPartitions("pair", "fp").mapInArrow(run, "x long, y long")


def _split_buckets(rows: DataFrame) -> DataFrame:
    """(key, top, inner, inner_values, others, other_values) of the buckets whose rows (key, fp, m, root) lie in several components: the largest one, its nodes and
    the values of their sets, and those of the others."""
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("m").alias("values"))
    found = by_root.groupBy("key").agg(F.max(F.struct("n", "root", "values")).alias("t"), F.sum("n").alias("n"), F.sum("values").alias("values")).where("n > t.n")
    return found.select("key", F.col("t.root").alias("top"), F.col("t.n").alias("inner"), F.col("t.values").alias("inner_values"), (F.col("n") - F.col("t.n")).alias("others"), (F.col("values") - F.col("t.values")).alias("other_values"))


def _open_buckets(rows: DataFrame) -> DataFrame:
    """(key, n) of the buckets whose rows (key, root) lie in several components."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "n")


def _dealt(pairs: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with which copy of the set of node ``side`` a pair meets, and how many copies each node's set has: one for every FAN pairs."""
    copies = cut(pairs.groupBy(side).agg(F.ceil(F.count("*") / F.lit(FAN)).cast("int").alias("copies")), "copies")
    if copies.where("copies > 1").isEmpty():
        return pairs.withColumn(f"{side}_copy", F.lit(0)), copies
    other = "y" if side == "x" else "x"
    return cut(spread_join(pairs, copies, [side]).withColumn(f"{side}_copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies"), "dealt-pairs"), copies


def _with_set(pairs: DataFrame, copies: DataFrame, sets: DataFrame, side: str, name: str) -> DataFrame:
    mine = sets.select(F.col("fp").alias(side), F.col("shingles").alias(name)).join(copies, side)
    return pairs.join(mine.withColumn(f"{side}_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"), [side, f"{side}_copy"])


def _chosen_sets(docs: DataFrame, key: str, rows: DataFrame, words: int, text_col: str, signed: bool = False) -> DataFrame:
    """(fp, shingles), or (fp, sig, shingles) if ``signed``, of the ``rows`` (row) of the numbered ``docs``; other texts are read and left.

    Sets are signed by the worker that made them: another step would hold a second worker for each task, and send all sets through the executor once more."""
    make = chooser(rows, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = make()
        for batch in batches:
            for _, texts in slices(batch.column(1).filter(pa.array(among(batch.column(0).to_numpy()))), SKETCH_BYTES):
                sets = distinct_runs(*shingle_hashes(texts.to_pylist(), words))
                fps, lists = pa.array(np.array([_set_hash(s) for s in sets], np.uint64).view(np.int64)), _lists(np.concatenate(sets), np.array([len(s) for s in sets]))
                if signed:
                    yield pa.record_batch([fps, binary_column(signatures(sets).reshape(-1), np.full(len(sets), SIGNATURE)), lists], names=["fp", "sig", "shingles"])
                else:
                    yield pa.record_batch([fps, lists], names=["fp", "shingles"])

    return docs.select(key, F.col(text_col).cast("string").alias("text")).mapInArrow(run, "fp long, sig binary, shingles array<long>" if signed else "fp long, shingles array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, words: int, similar: float, text_col: str) -> DataFrame:
    """(a, b) of ``pairs`` (x, y) whose sets are similar. Only the sets of nodes in pairs are made, once, and move."""
    pairs = cut(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    ends = pairs.select(F.col("x").alias("fp")).unionByName(pairs.select(F.col("y").alias("fp"))).distinct()
    sets = cut(_chosen_sets(docs, key, nodes.join(ends, "fp", "left_semi").select("row"), words, text_col), "shingle-sets")
    dealt, copies_x = _dealt(pairs, "x")
    dealt, copies_y = _dealt(dealt, "y")
    both = _with_set(_with_set(dealt, copies_x, sets, "x", "p"), copies_y, sets, "y", "q")
    both = both.select("x", "y", F.size("p").alias("m"), F.size("q").alias("n"), F.size(F.array_intersect("p", "q")).alias("c"))
    return both.where(F.col("c") >= similar * (F.col("m") + F.col("n") - F.col("c"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def similar_roots(docs: DataFrame, key: str, words: int, similar: float, distance: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, fp) of every row of the numbered ``docs``, and (fp, root): the component of each node."""
    held = cut(_sketches(docs, key, words, id_col, text_col), "sketches")
    every = cut(held.groupBy("fp").agg(F.min("row").alias("row"), F.first("sim").alias("sim"), F.first("m").alias("m"), F.first("keys").alias("keys")), "nodes")
    nodes = every.where("m > 0")

    def joined(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        """(node, root) after the similar ones of ``pairs`` have joined their components."""
        return grown(_verified(pairs, nodes, docs, key, words, similar, text_col), before)

    def grown(more: DataFrame, before: DataFrame | None) -> DataFrame:
        """(node, root) after the pairs ``more`` (a, b) have joined components."""
        return components(more if before is None else more.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def placed(found: DataFrame, name: str) -> DataFrame:
        return cut(nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "m", "keys", F.coalesce("root", "fp").alias("root")), name)

    found = joined(_fingerprint_pairs(nodes, distance), None)
    rows = _band_rows(placed(found, "members"))
    buckets = cut(_open_buckets(rows), "buckets")
    held_rows = cut(with_hot(rows, buckets, "key"), "bucket-rows")
    large = held_rows.where(F.col("n") > SMALL)
    pairs = _small_bucket_pairs(held_rows.where(F.col("n") <= SMALL), similar)
    some_large = not large.isEmpty()
    found = joined(pairs.unionByName(_pivot_pairs(large)) if some_large else pairs, found)
    if some_large:
        at = cut(large.select("key", "fp").join(placed(found, "members").drop("keys"), "fp"), "large-buckets")
        open_keys = cut(_split_buckets(at), "open-buckets")
        if not open_keys.isEmpty():
            wanted = nodes.join(at.join(open_keys, "key", "left_semi").select("fp").distinct(), "fp", "left_semi").select("row")
            signed = cut(_chosen_sets(docs, key, wanted, words, text_col, signed=True), "signatures")
            found = grown(cut(_open_pairs(at, open_keys, signed, similar), "open-links").toDF("a", "b"), found)
    member = every.select("fp").join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return held.select("row", "doc_id", "fp"), cut(member.select("fp", F.coalesce("root", "fp").alias("root")), "roots")
