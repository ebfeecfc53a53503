"""Exact k-nearest-neighbour search over embedding columns."""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.vectors import cosine
from folio.operators.bm25 import top_k
from folio.storage import new_folder, open_fs

#: Query vectors that are multiplied at once, and blocks of them that one pass over the table takes.
QUERY_BLOCK, PASS_BLOCKS = 1024, 16


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def metadata_where(filepath: str | None = None, heading: str | None = None, tag: str | None = None) -> Column | None:
    """A condition on rows (filepath, heading_path, tags), for a search among those that meet it: the file, a part of the heading path, one of the tags. None asks for nothing.

    It stands before the search, so Catalyst pushes the file's part into the scan, and k rows come back if so many meet it."""
    asked = []
    if filepath:
        asked.append(F.col("filepath") == filepath)
    if heading:
        asked.append(F.contains(F.coalesce("heading_path", F.lit("")), F.lit(heading)))
    if tag:
        asked.append(F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    return reduce(lambda a, b: a & b, asked) if asked else None


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query, id, similarity, rank): the k most similar rows of ``vectors`` to each row of ``queries``. Rows and queries without an id or a vector take no part.

    Tasks write the queries in blocks of ``QUERY_BLOCK`` to the shared folder; the driver only has the blocks' names. Each task reads block after
    block, multiplies it by its rows and keeps the k best of each query, so that k rows a task and query are shuffled and no table of pairs is
    made. A pass over ``vectors`` takes ``PASS_BLOCKS`` blocks, which bounds what a task keeps."""
    paths = _write_blocks(queries, id_col, vector_col)
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    out = None
    for first in range(0, max(1, len(paths)), PASS_BLOCKS):

        def run(batches: Iterator[pa.RecordBatch], mine: list[str] = paths[first : first + PASS_BLOCKS]) -> Iterator[pa.RecordBatch]:
            found: dict[str, list[np.ndarray]] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 16_384):
                    own, unit = batch.column(0).slice(at, 16_384).to_numpy(), _unit(_rows_of(batch.column(1).slice(at, 16_384)))
                    for path in mine:
                        ids, matrix = _read_block(path)
                        similarity = matrix @ unit.T
                        if exclude_self:
                            similarity[ids[:, None] == own] = -np.inf
                        least = max(0, len(own) - k)
                        enough = np.partition(similarity, least, axis=1)[:, least, None]  # the k-th best of these rows; ties with it stay for now
                        q, r = np.nonzero((similarity >= enough) & (similarity > -np.inf))
                        fresh = (ids[q], own[r], similarity[q, r])
                        found[path] = _best([np.concatenate(x) for x in zip(found[path], fresh, strict=True)] if path in found else list(fresh), k)
            for some in found.values():
                yield pa.record_batch([pa.array(x) for x in some], names=["query", "id", "similarity"])

        passed = rows.mapInArrow(run, "query long, id long, similarity double")
        out = passed if out is None else out.unionByName(passed)
    return top_k(out, k, by="similarity")


def _write_blocks(queries: DataFrame, id_col: str, vector_col: str) -> list[str]:
    """Paths of files of at most QUERY_BLOCK queries each: ids, then unit vectors, as numpy arrays."""
    folder = new_folder(queries.sparkSession, "query-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, n = TaskContext.get().taskAttemptId(), 0  # a repeated task writes files of its own
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                content = io.BytesIO()
                np.save(content, batch.column(0).slice(at, QUERY_BLOCK).to_numpy())
                np.save(content, _unit(_rows_of(batch.column(1).slice(at, QUERY_BLOCK))))
                with fs.open_output_stream(f"{inner}/{attempt}-{n}.npy") as out:
                    out.write(content.getvalue())
                yield pa.record_batch([pa.array([f"{folder}/{attempt}-{n}.npy"])], names=["path"])
                n += 1

    asked = queries.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    full = asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK)))  # queries may be strewn over many partitions; each block is a read of all vectors
    return [r.path for r in full.mapInArrow(run, "path string").collect()]


@functools.lru_cache(maxsize=32)
def _read_block(path: str) -> tuple[np.ndarray, np.ndarray]:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as stream:
        content = io.BytesIO(stream.read())
    return np.load(content), np.load(content)


def _rows_of(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length as a matrix, without a Python object a row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, id, similarity) the k most similar of each query, ties by id."""
    order = np.lexsort((found[1], -found[2], found[0]))
    query = found[0][order]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return [x[order][nth < k] for x in found]


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def min_max_similarity(found: DataFrame, distance: str = "distance", group: str | None = None) -> DataFrame:
    """Adds ``dense``: 1 for the nearest of a result set, 0 for the farthest, 1 for all where they are equal."""
    found, low, high = _bounds(found, distance, group)
    return found.withColumn("dense", 1 - (F.col(distance) - low) / F.when(high > low, high - low).otherwise(1.0)).drop("__low", "__high")


def min_max_sparse(found: DataFrame, score: str = "score", group: str | None = None) -> DataFrame:
    """Adds ``sparse``: 1 for the best hit, 0 for the worst, 0 for all where they are equal."""
    found, low, high = _bounds(found, score, group)
    return found.withColumn("sparse", (F.col(score) - low) / F.when(high > low, high - low).otherwise(1.0)).drop("__low", "__high")


def _bounds(found: DataFrame, value: str, group: str | None) -> tuple[DataFrame, Column, Column]:
    """``found`` with the least and largest value of its group, or of all rows, which one row then tells every task."""
    if group:
        over = Window.partitionBy(group)
        return found, F.min(value).over(over), F.max(value).over(over)
    one = found.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    return found.crossJoin(F.broadcast(one)), F.col("__low"), F.col("__high")
