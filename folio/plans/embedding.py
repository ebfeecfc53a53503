"""Embedding as a stage: contents in batches, several tries, and a table of vectors by content, so that only new contents are embedded."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.storage import cut, open_fs

Embedder = Callable[[list[str]], list[list[float]]]

# Texts of a call, tries of a call, and seconds before the second one; the third waits twice as long.
BATCH, TRIES, WAIT = 64, 3, 1.5


def call(embed: Embedder, texts: list[str], tries: int = TRIES, wait: float = WAIT) -> list[list[float]]:
    """The vectors of one call; an error of the last try is raised, as is an answer of another length."""
    for n in range(1, tries + 1):
        try:
            found = embed(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception:
            if n == tries:
                raise
            time.sleep(wait * n)
    raise AssertionError


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(key, embedding): the vectors that there are, one for each content; none if the table hasn't been made yet."""
    from pyarrow import fs as pafs

    fs, inner = open_fs(store)
    if fs.get_file_info(inner).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], "key string, embedding array<float>")
    return spark.read.schema("key string, embedding array<float>").parquet(store).groupBy("key").agg(F.first("embedding").alias("embedding"))


def embed_new(rows: DataFrame, embed: Embedder, store: str, content: str = "content", batch: int = BATCH, tries: int = TRIES, wait: float = WAIT) -> int:
    """Embeds the contents of ``rows`` whose hash the table at ``store`` doesn't have, each once, and appends their vectors; tells how many there were.

    Contents are dealt by their hash, so that copies of one content, of which there may be any number, cost a key each and no call. Tasks call with up to ``batch`` texts.
    Vectors are written when all calls have succeeded: a failed job leaves the table as it was, and the contents are asked for again. Null and blank contents have no vector."""
    spark = rows.sparkSession
    asked = rows.where(F.trim(F.coalesce(content, F.lit(""))) != "").select(F.sha2(content, 256).alias("key"), F.col(content).alias("content"))
    fresh = asked.join(stored(spark, store).select("key"), "key", "left_anti").groupBy("key").agg(F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for at in range(0, one.num_rows, batch):
                some = one.slice(at, batch)
                vectors = call(embed, some.column(1).to_pylist(), tries, wait)
                yield pa.record_batch([some.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "embedding"])

    made = cut(fresh.mapInArrow(run, "key string, embedding array<float>"), "new-vectors")
    n = made.count()
    if n:
        made.write.mode("append").parquet(store)
    return n


def embedded(rows: DataFrame, embed: Embedder, store: str, content: str = "content", **more: object) -> DataFrame:
    """``rows`` with ``embedding``; null where there is no content. Contents that the table at ``store`` knows aren't embedded again."""
    embed_new(rows, embed, store, content, **more)
    vectors = stored(rows.sparkSession, store)
    return rows.withColumn("key", F.sha2(content, 256)).join(vectors, "key", "left").drop("key")
