"""SimHash fingerprints, links at a small Hamming distance by deletion-variant signatures, and their components.

Two 64-bit fingerprints that differ in at most four bits agree, but for one bit, in at
least one of three segments. Each fingerprint is indexed under every variant of every
segment with one bit taken out; fingerprints that share a variant meet and are compared
in full. What a task finds leaves it as a spanning forest, so a dense group sends on as
many rows as it has members, not its pairs. A variant that more than ``BLOCK``
fingerprints share is dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components, spanning
from folio.llm.encoding import give_back, slices
from folio.llm.rows import numbered, without_rows
from folio.llm.shingles import majority_bits, shingle_hashes
from folio.llm.spread import spread_join
from folio.storage import cut

#: Fingerprints that share one variant before it is dealt out in blocks.
BLOCK = 8192
#: Groups up to this size are compared together, by shifts over the sorted rows.
SMALL = 64
#: Rows compared at a time.
CHUNK = 100_000


def text_fingerprints(texts: list[str], words: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned fingerprints: a bit is 1 if it is set in over half the XXH64 hashes of the word shingles, repeats included.

    ASCII capitals are lowered; fewer words than a shingle count as one shingle; no words give zero."""
    return majority_bits(*shingle_hashes(texts, words, seed))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a long with the same bits; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), 500_000):
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(text_fingerprints(texts.to_pylist(), words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of as few segments as make one of them differ by at most one bit."""
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(key, fp): 64 rows for each fingerprint, one for each bit of each segment with that bit taken out."""
    cuts = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(i, 20_000).to_numpy().view(np.uint64)
                keys = []
                for s, (first, bits) in enumerate(cuts):
                    segment = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                    for j in range(bits):
                        below = segment & np.uint64((1 << j) - 1)
                        without = segment >> np.uint64(j + 1) << np.uint64(j) | below
                        keys.append(np.uint64((s << 6 | j) << 40) | without if bits <= 40 else without ^ np.uint64((s << 6 | j) << 56))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp.view(np.int64), len(keys)))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _compare(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by group: fingerprints of one group that differ by at most ``distance`` bits."""
    near = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= distance
    edges = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    sizes = np.diff(np.append(edges, len(group)))
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    left = np.repeat(np.append(edges, 0)[:-1] + sizes, sizes)[at] - at - 1  # rows of the group behind each
    for shift in range(1, SMALL):
        at, left = at[left >= shift], left[left >= shift]
        if not len(at):
            break
        hit = at[near(fp[at], fp[at + shift])]
        a.append(fp[hit])
        b.append(fp[hit + shift])
    for first, size in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = np.unique(fp[first : first + size])
        label = np.arange(len(own))
        for i in range(len(own) - 1):
            touched = np.unique(label[i:][near(own[i:], own[i])])
            if len(touched) > 1:
                label[np.isin(label, touched)] = touched[0]
        a.append(own)
        b.append(own[label])
    if not a:
        return fp[:0], fp[:0]
    x, y = np.concatenate(a), np.concatenate(b)
    return spanning(x[x != y], y[x != y]) if (x != y).any() else (fp[:0], fp[:0])


def _linker(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            group, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(group) if last else int(np.searchsorted(group, group[-1]))  # the last group may go on
            held, rows = ([(group[end:], fp[end:])] if end < len(group) else []), len(group) - end
            if end:
                x, y = _compare(group[:end], fp[:end], distance)
                if len(x):
                    yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from done(False)
        if rows:
            yield from done(True)
        held = []
        give_back()

    return run


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) of distinct fingerprints ``fps`` (fp): enough links at ``distance`` or fewer differing bits to join all that are reachable."""
    rows = variants(fps, distance)
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot-variants")
    schema = "a long, b long"
    if hot.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(distance), schema)
    cold = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(distance), schema)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = rows.join(hot, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("pair")  # two pairs on one number are only compared in vain
    split = dealt.select(pair, "fp").repartition("pair").sortWithinPartitions("pair", "fp").mapInArrow(_linker(distance), schema)
    return cold.unionByName(split)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that links reach. Null texts are empty; empty texts have fingerprint zero and link like any other;
    a text of any length gives one fingerprint of all its shingles; a bit that is set in just half of the hashes is 0; repeated rows
    stay; a null doc_id never names a component that has another, else component_id is null; an empty table gives no rows; other columns are left out,
    so their names can't clash."""
    held = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = cut(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct, distance))
    member = cut(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    low = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(spread_join(member, low, ["root"]).select("fp", "component_id"), "named")
    return spread_join(held, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, words: int = 5, similar: float = 0.8, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of rows whose sets of word shingles have a Jaccard similarity of ``similar`` or more, the row with the smallest doc_id, as it was.

    Fingerprint links retrieve the closest pairs and MinHash bands those that more bits part; exact sets verify all of them (``jaccard``).
    Of equal doc_ids (null last) any one row stays. Null and empty texts are alike and only like each other; a text of any length counts
    with all its shingles; an empty table gives no rows; other columns stay as they are. Rows are told apart by a
    number that is written with them first."""
    from folio.llm.jaccard import similar_roots

    held_docs, key = numbered(docs)
    held, roots = similar_roots(held_docs, key, words, similar, distance, id_col, text_col)
    rooted = cut(spread_join(held, roots, ["fp"]).select("root", "row", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row").alias("order")), "rooted")
    best = rooted.groupBy("root").agg(F.min("order").alias("best"))
    dropped = spread_join(rooted, best, ["root"]).where("row <> best.row").select(F.col("row").alias(key))
    return without_rows(held_docs, dropped, key).select(*docs.columns)
