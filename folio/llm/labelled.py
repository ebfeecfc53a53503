"""Labelled rows for the trained operators, and how their documents are held out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.encoding import slices
from folio.storage import cut

#: Parts that training rows are written in.
PARTS = 32
#: Bytes of text that are judged at a time.
SLICE = 1_000_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label), one row for each of at most ``limit`` labelled documents for which ``keep`` (over doc_id) holds; written.

    Over ``limit``, the documents with the least hash of their doc_id are taken: a sample that doesn't depend on how rows are
    partitioned. Of several labels of one doc_id the largest counts, of several texts the least; null labels, labels without a document and
    documents without a label or number are left out before the sample is taken."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(keep)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = cut(sample, "sample")  # ``limit`` pairs of numbers at most
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return cut(found.repartition(PARTS, "doc_id"), "training-rows")


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, whose text the judge finds true; null texts are judged as empty.
    ``judge()`` is called once in each task."""
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            for at, texts in slices(batch.column(at_text).cast(pa.string()), SLICE):
                yield batch.slice(at, len(texts)).filter(pa.array(keep(texts.to_pylist())))

    return docs.mapInArrow(run, docs.schema)
