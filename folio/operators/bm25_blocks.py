"""BM25 search over postings in blocks of documents, with bounds that leave blocks out.

Documents stand in blocks of at most ``BLOCK`` that share their least token hashes, so that near texts and texts of one language
lie together. A block is one row: its documents, and for each token which of them have it and how much that adds. ``bounds`` has the
most that a token adds in a block. A search first sums these bounds for each query and block, looks into the few blocks that
promise most, and takes the k-th best score found there as the least that counts; other blocks whose bound is below it are left out.
Scores are summed within a block's row, so that rows of queries and blocks are shuffled, not of queries and documents, and only hits come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.bm25 import EPSILON, K1, B, Index, idf, top_k
from folio.storage import cut

#: Documents of a block, blocks that a query looks into first, queries that meet a block's row together.
BLOCK, FIRST, QUERIES = 256, 2, 64
#: Scores that differ by less count as equal: searches round to six digits.
NEAR = 2e-6


@dataclass
class BlockIndex:
    """``blocks`` (block, ids, numbers, offsets, docs, parts), ``bounds`` (number, block, most), ``vocabulary`` (token, number, weight)."""

    blocks: DataFrame
    bounds: DataFrame
    vocabulary: DataFrame

    def save(self, path: str) -> None:
        self.blocks.write.parquet(f"{path}/blocks")
        self.bounds.repartitionByRange("number", "block").sortWithinPartitions("number", "block").write.parquet(f"{path}/bounds")
        self.vocabulary.write.parquet(f"{path}/vocabulary")


def load_index(spark: SparkSession, path: str) -> BlockIndex:
    """An index that ``BlockIndex.save`` wrote."""
    return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "bounds", "vocabulary")))


def build_index(index: Index) -> BlockIndex:
    """Blocks from the tables of a plain index, written to the shared folder."""
    raw = idf(F.col("n_docs"), F.col("df"))
    weighted = index.vocabulary.crossJoin(F.broadcast(index.stats)).select("token", F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw).alias("weight"))  # one row
    vocabulary = cut(weighted.withColumn("number", F.monotonically_increasing_id()), "numbered-vocabulary")
    # a document's place: by its two least token hashes; blocks are runs of BLOCK in the range partitions
    hashes = index.postings.groupBy("id").agg(F.min(F.xxhash64("token")).alias("h"), F.min(F.xxhash64("token", F.lit(1))).alias("g"))
    ordered = cut(cut(hashes, "token-hashes").repartitionByRange("h", "g", "id").sortWithinPartitions("h", "g", "id").withColumn("at", F.monotonically_increasing_id()), "places")
    place = ordered.select("id", (F.shiftright("at", 33) * (1 << 31) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / BLOCK)).alias("block"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = index.postings.join(vocabulary.select("token", "number"), "token").join(place, "id").crossJoin(F.broadcast(index.stats.select("avgdl"))).select("block", "number", "id", part.alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            number, doc, value = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, docs = np.unique(doc, return_inverse=True)
            numbers, offsets = np.unique(number, return_index=True)
            columns = (ids, numbers, np.append(offsets, len(number)).astype(np.int32), docs.astype(np.int32), value)
            return pa.record_batch([pa.array([now]), *(pa.array([c]) for c in columns)], names=["block", "ids", "numbers", "offsets", "docs", "parts"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and block[a] != now:
                    yield flush()
                    held = []
                now = int(block[a])
                held.append(tuple(batch.column(c).slice(a, b - a).to_numpy() for c in (1, 2, 3)))
        if held:
            yield flush()

    dealt = rows.repartition("block").sortWithinPartitions("block", "number", "id")
    blocks = cut(dealt.mapInArrow(pack, "block long, ids array<long>, numbers array<long>, offsets array<int>, docs array<int>, parts array<double>"), "blocks")

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, numbers, offsets, parts in zip(*batch.columns, strict=True):
                number, edges = numbers.values.to_numpy(), offsets.values.to_numpy()
                best = np.maximum.reduceat(parts.values.to_numpy(), edges[:-1])
                yield pa.record_batch([pa.array(number), pa.array(np.full(len(number), block.as_py())), pa.array(best)], names=["number", "block", "most"])

    bounds = blocks.select("block", "numbers", "offsets", "parts").mapInArrow(most, "number long, block long, most double")
    return BlockIndex(blocks, cut(bounds, "bounds"), vocabulary)


def search(index: BlockIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, exact, score, rank), scores rounded to six digits, ties by id, of the k best documents that share a token: the same as ``top_k`` of ``bm25.scores``.

    ``asked``: (query, token, qtf). Queries without a known token have no rows."""
    known = cut(asked.join(index.vocabulary, "token").select("query", "number", (F.col("qtf") * F.col("weight")).alias("w")), "asked")
    asked_vectors = cut(known.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("v")).select("query", F.col("v.number").alias("asked"), F.col("v.w").alias("weights")), "asked-vectors")
    bound = cut(index.bounds.join(known, "number").groupBy("query", "block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("most")).alias("bound")), "block-bounds")
    first = top_k(bound, FIRST, by="bound", tie="block").select("query", "block")
    found = cut(_scored(index, first.withColumn("least", F.lit(float("-inf"))), asked_vectors, k), "first-hits")
    least = top_k(found, k).groupBy("query").agg(F.max("rank").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).select("query", (F.col("s") - NEAR).alias("least"))
    rest = bound.join(first, ["query", "block"], "left_anti").join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = rest.where(F.col("bound") >= F.col("least")).select("query", "block", "least")
    every = found.unionByName(_scored(index, rest, asked_vectors, k))
    return top_k(every.select("query", "id", F.col("score").alias("exact"), F.round("score", 6).alias("score")), k)


def looked_into(index: BlockIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query, blocks, left_out): of the blocks that share a token with a query, how many a search leaves out."""
    known = asked.join(index.vocabulary, "token").select("query", "number", (F.col("qtf") * F.col("weight")).alias("w"))
    bound = index.bounds.join(known, "number").groupBy("query", "block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("most")).alias("bound"))
    least = search(index, asked, k).groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    out = (F.col("n") == k) & (F.col("bound") < F.col("s") - NEAR)
    return bound.join(least, "query").groupBy("query").agg(F.count("*").alias("blocks"), F.count_if(out).alias("left_out"))


def _scored(index: BlockIndex, pairs: DataFrame, asked_vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, score) of the hits of (query, block, least): of each block the k best of at least ``least``, and what is as good as the last of them."""
    group = F.floor(F.pmod(F.xxhash64("query"), F.lit(1 << 20)) / ((1 << 20) / 16))  # a block may be asked by very many queries
    needed = pairs.join(asked_vectors, "query").withColumn("group", group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, offsets, docs, parts = (batch.column(i) for i in range(5))
            for row in range(batch.num_rows):
                own, number, edge, doc, part = (c[row].values.to_numpy() for c in (ids, numbers, offsets, docs, parts))
                out: list[tuple] = []
                for q in batch.column(5)[row].values:
                    asked, weight = q["asked"].values.to_numpy(), q["weights"].values.to_numpy()
                    at = np.minimum(np.searchsorted(number, asked), len(number) - 1)
                    hit = number[at] == asked
                    start, size = edge[at[hit]].astype(np.int64), np.diff(edge)[at[hit]]
                    ends = np.cumsum(size)
                    if not len(ends):
                        continue
                    place = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))
                    score = np.bincount(doc[place], weights=np.repeat(weight[hit], size) * part[place], minlength=len(own))
                    there = np.flatnonzero((np.bincount(doc[place], minlength=len(own)) > 0) & (score >= q["least"].as_py()))
                    if len(there) > k:
                        there = there[score[there] >= np.partition(score[there], len(there) - k)[len(there) - k] - NEAR]
                    out.append((np.full(len(there), q["query"].as_py()), own[there], score[there]))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query", "id", "score"])

    grouped = needed.withColumn("part", F.floor(F.monotonically_increasing_id() / QUERIES))  # at most QUERIES of a task's rows together
    grouped = grouped.groupBy("block", "group", "part").agg(F.collect_list(F.struct("query", "asked", "weights", "least")).alias("queries"))
    met = index.blocks.join(grouped, "block").select("ids", "numbers", "offsets", "docs", "parts", "queries")
    return met.mapInArrow(run, "query long, id long, score double")

