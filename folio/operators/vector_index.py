"""An index over embedding columns, held as tables: cells, product-quantised codes, and lists of rows by cell.

Vectors are scaled to length one. ``cells`` k-means centres share them out; what is left of a vector beside its cell's centre is cut into
parts of ``PART`` numbers, and each part is coded by the nearest of 256 centres. Centres are fitted on a sample of at most ``SAMPLE_ROWS`` rows; every row
that has an id and a vector of the index's width is in the index. A list is kept in blocks of at most ``BLOCK`` rows, a table row each: ids, codes and vectors.
A search sends each query to the blocks of its nearest cells by an equality join on (cell, block), ranks a block's rows by their codes, and compares
the best of them exactly, so that similarities are those of ``dense.knn_join`` and only k rows for each query and block are shuffled.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import dense
from folio.operators.bm25 import top_k
from folio.storage import cut, new_folder, open_fs

#: Rows that centres are fitted on at most, and cells at most: both bound what the driver and each task hold.
SAMPLE_ROWS, MOST_CELLS = 65_536, 16_384
#: Numbers of a vector that one code stands for, rows of a block, queries whose cells are chosen at once, rounds of k-means.
PART, BLOCK, PROBED, ROUNDS = 4, 2048, 256, 12
#: Of the neighbours of sampled rows, the share whose cells a search looks into by default; how many times k rows of a block are compared exactly.
RECALL, REFINED = 0.96, 4
#: Sampled rows whose neighbours in the sample tell how many cells that takes, and neighbours of each.
ASKED, NEIGHBOURS = 256, 50


@dataclass
class Model:
    """``cells`` (cells x width), ``codes`` (parts x 256 x PART), the cells that a search looks into by default, and the kind of the vectors' numbers."""

    cells: np.ndarray
    codes: np.ndarray
    probes: int = 1
    kind: str = "<f4"

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, cells=self.cells, codes=self.codes, probes=np.array(self.probes), kind=np.array(self.kind))
        return out.getvalue()

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows as (parts, rows, PART), zeros after the last number."""
        parts = len(self.codes)
        padded = np.zeros((len(rows), parts * PART), np.float32)
        padded[:, : rows.shape[1]] = rows
        return padded.reshape(len(rows), parts, PART).transpose(1, 0, 2)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit rows."""
        cell = _nearest(rows, self.cells)
        codes = np.stack([_nearest(part, book) for part, book in zip(self.split(rows - self.cells[cell]), self.codes, strict=True)], axis=1)
        return cell, codes.astype(np.uint8)

    def guess(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded rows of a cell: those with its centre, and table lookups for each part."""
        total = np.repeat((queries @ self.cells[cell])[:, None], len(codes), axis=1)
        for part, (book, own) in enumerate(zip(self.codes, self.split(queries), strict=True)):
            total += (own @ book.T)[:, codes[:, part]]
        return total


@dataclass
class VectorIndex:
    """``lists`` (cell, block, ids, codes, vectors: a row for each block) and the path of the model."""

    lists: DataFrame
    model_path: str

    def save(self, path: str) -> None:
        """Writes the index to a folder that doesn't exist yet; blocks lie in the order of their cells."""
        self.lists.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.option("compression", "uncompressed").parquet(f"{path}/lists")
        _write(f"{path}/model.npz", _read(self.model_path))


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``VectorIndex.save`` wrote."""
    return VectorIndex(spark.read.parquet(f"{path}/lists"), f"{path}/model.npz")


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> VectorIndex:
    """An index of ``vectors``, written to the shared folder. Rows without an id or a vector are left out, rows of another width than the first
    sampled one are an error; a repeated id is as many rows; of equal vectors all are kept, in blocks that no single task has to hold together."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = _rows(vectors, id_col, vector_col, kind)
    n = rows.count()
    sample = _sample(rows, n)
    model = fit(dense._unit(dense._rows_of(sample["vector"].combine_chunks()).astype(np.float32)) if n else np.zeros((0, 1), np.float32), cells or max(1, min(MOST_CELLS, int(n**0.5))))
    model.kind = kind
    path = f"{new_folder(spark, 'vector-model')}/model.npz"
    _write(path, model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                own = batch.slice(at, 8192)
                raw = dense._rows_of(own.column(1)).astype(model.kind)
                cell, codes = model.place(dense._unit(raw.astype(np.float64)).astype(np.float32))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), own.column(0), _binary(codes), _binary(raw)], names=["cell", "id", "codes", "vector"])

    placed = cut(rows.mapInArrow(run, "cell int, id long, codes binary, vector binary"), "placed-vectors")
    # blocks are dealt by a hash of the id, so that a cell may have any share of the rows
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") * 1.25 / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(sizes), "cell")  # a row for each cell: at most MOST_CELLS
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("id", "codes", "vector"))).alias("rows"))
    joined = lambda c: F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r[c])), ""))
    return VectorIndex(cut(packed.select("cell", "block", F.col("rows.id").alias("ids"), joined("codes").alias("codes"), joined("vector").alias("vectors")), "vector-lists"), path)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    number = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("vector"))
    return rows.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")


def _sample(rows: DataFrame, n: int) -> pa.Table:
    """The rows of the least hashes of ids, at most SAMPLE_ROWS, in that order. Of a larger table those below a bound are asked for, so that no task passes on more than are
    taken in all; the bound is five standard deviations below the most. Where ids repeat so often that hardly any lie below it, any rows are taken."""
    hashed = rows.select(F.xxhash64("id").alias("h"), "id", "vector")
    share = (SAMPLE_ROWS - 5 * SAMPLE_ROWS**0.5) / n if n > SAMPLE_ROWS else 1.0
    some = hashed.where(F.col("h") < int((share - 0.5) * 2.0**64)) if share < 1 else hashed
    sample = some.limit(SAMPLE_ROWS).toArrow()
    if share < 1 and len(sample) < SAMPLE_ROWS // 2:
        sample = hashed.limit(SAMPLE_ROWS).toArrow()
    return sample.sort_by([("h", "ascending"), ("id", "ascending")])


def fit(sample: np.ndarray, cells: int, seed: int = 7) -> Model:
    """Centres of unit rows."""
    rnd = np.random.default_rng(seed)
    width = sample.shape[1]
    centres = _k_means(sample, cells, rnd)
    parts = -(-width // PART)
    model = Model(centres, np.zeros((parts, 256, PART), np.float32))
    if len(sample):
        few = sample[:16_384]
        left = model.split(few - centres[_nearest(few, centres)])
        model.codes = np.stack([_k_means(part, 256, rnd) for part in left])
        model.probes = _probes(sample, centres)
    return model


def _probes(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many cells of a sampled row have RECALL of its neighbours in the sample."""
    asked = sample[:ASKED]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return len(centres)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort((centres * centres).sum(axis=1) - 2 * asked @ centres.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], 1)
    ranks = np.take_along_axis(place, _nearest(sample, centres)[found], 1)
    return int(np.quantile(ranks, RECALL)) + 1


def _k_means(rows: np.ndarray, k: int, rnd: np.random.Generator) -> np.ndarray:
    """k centres; those that no row is nearest to stay where they are."""
    if not len(rows):
        return np.zeros((k, rows.shape[1]), np.float32)
    different = np.unique(rows, axis=0)
    centres = different[rnd.choice(len(different), min(k, len(different)), replace=False)].astype(np.float32)
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=rows[:, d], minlength=len(centres)) for d in range(rows.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return np.concatenate([centres, np.full((k - len(centres), rows.shape[1]), 1e3, np.float32)])  # centres that nothing is near


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres * centres).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([np.argmin(size - 2 * rows[i : i + step] @ centres.T, axis=1) for i in range(0, len(rows), step)]) if len(rows) else np.zeros(0, np.int64)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True, refined: int = REFINED) -> DataFrame:
    """(query, id, similarity, rank) of the k most similar rows in the ``probes`` nearest cells of each query, by default as many as ``RECALL`` asked for.

    With as many probes as there are cells and ``refined`` of 0 (all rows of a block), the result is that of ``dense.knn_join``. Queries without an id or a vector have no rows."""
    path = index.model_path
    paths = dense._write_blocks(_rows(queries, id_col, vector_col, "<f8"), "id", "vector")
    spark = queries.sparkSession

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        if not model.cells.any():  # of an empty table
            return
        wanted = min(len(model.cells), probes or model.probes)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                ids, exact = dense._read_block(paths[file])
                for at in range(0, len(ids), PROBED):
                    unit = exact[at : at + PROBED].astype(np.float32)
                    far = (model.cells * model.cells).sum(axis=1) - 2 * unit @ model.cells.T
                    cell = np.argpartition(far, wanted - 1, axis=1)[:, :wanted]
                    row = np.repeat(np.arange(at, at + len(unit)), wanted)
                    yield pa.record_batch([pa.array(np.full(len(row), file, np.int32)), pa.array(row.astype(np.int32)), pa.array(cell.reshape(-1).astype(np.int32))], names=["file", "row", "cell"])

    # a probe is the place of its query in the written blocks: vectors are read there and not shuffled
    probed = spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(probe, "file int, row int, cell int")
    grouped = probed.groupBy("cell", "file").agg(F.sort_array(F.collect_list("row")).alias("asked"))
    blocks = index.lists.groupBy("cell").agg(F.max("block").alias("last"))
    dealt = grouped.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), "last")).alias("block"), "file", "asked")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for i in range(batch.num_rows):
                cell, ids, codes, vectors, file, asked = (batch.column(c)[i] for c in range(6))
                ids, row = ids.values.to_numpy(), asked.values.to_numpy()
                every, units = dense._read_block(paths[file.as_py()])
                names, own = every[row], units[row]
                rows = dense._unit(np.frombuffer(vectors.as_py(), model.kind).reshape(len(ids), -1).astype(np.float64))
                if refined and refined * k < len(ids):
                    guessed = model.guess(own.astype(np.float32), cell.as_py(), np.frombuffer(codes.as_py(), np.uint8).reshape(len(ids), -1))
                    least = np.argsort(-guessed, axis=1, kind="stable")[:, : refined * k]
                else:
                    least = np.broadcast_to(np.arange(len(ids)), (len(names), len(ids)))
                similarity = np.stack([rows[some] @ one for some, one in zip(least, own, strict=True)]).round(12)  # equal rows are equally near
                found = ids[least]
                similarity[(found == names[:, None]) & exclude_self] = -np.inf
                order = np.lexsort((found, -similarity))[:, :k]
                found, similarity = np.take_along_axis(found, order, 1), np.take_along_axis(similarity, order, 1)
                q, r = np.nonzero(similarity > -np.inf)
                yield pa.record_batch([pa.array(names[q]), pa.array(found[q, r]), pa.array(similarity[q, r])], names=["query", "id", "similarity"])

    met = index.lists.hint("merge").join(dealt, ["cell", "block"]).select("cell", "ids", "codes", "vectors", "file", "asked")
    return top_k(met.mapInArrow(compare, "query long, id long, similarity double"), k, by="similarity")


def _binary(matrix: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    width = matrix.dtype.itemsize * matrix.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32)[: len(matrix) + 1]), pa.py_buffer(np.ascontiguousarray(matrix))])


def _write(path: str, content: bytes) -> None:
    fs, inner = open_fs(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(content)


def _read(path: str) -> bytes:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as stream:
        return stream.read()


@functools.lru_cache(maxsize=2)
def _model(path: str) -> Model:
    held = np.load(io.BytesIO(_read(path)))
    return Model(held["cells"], held["codes"], int(held["probes"]), str(held["kind"]))

