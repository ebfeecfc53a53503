"""Taking rows out of wide tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import cut, freed_shuffles, new_folder, open_fs


def numbered(docs: DataFrame, name: str = "numbered", codec: str = "snappy") -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the name of its column, which no other has. It is written, so that the numbers stay: the
    high bits are those of the writing task."""
    key = "__row"
    while key.lower() in map(str.lower, docs.columns):
        key += "_"
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), name, codec), key


def lists_by_part(rows: DataFrame, name: str) -> str:
    """Writes ``data`` (array of long) of rows (part, data) to a file for each part, in a new folder: its path. Files are named by their part
    alone, so tasks find their own and the driver keeps no list of them."""
    folder = new_folder(rows.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()  # a repeated task writes under another name until it has all
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        now, out, written = None, None, []

        def close() -> None:
            out.close()
            try:
                fs.move(f"{inner}/{now}-{attempt}.part", f"{inner}/{now}.bin")
            except OSError:
                if not fs.get_file_info(f"{inner}/{now}.bin").is_file:  # another attempt of this task was first
                    raise

        for batch in batches:
            parts, data = batch.column(0).to_numpy(), batch.column(1)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if parts[a] != now:
                    if out is not None:
                        close()
                    now = int(parts[a])
                    out = fs.open_output_stream(f"{inner}/{now}-{attempt}.part")
                    written.append(now)
                out.write(data.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        if out is not None:
            close()
        yield pa.record_batch([pa.array(written, pa.int64())], names=["part"])

    with freed_shuffles(rows.sparkSession):
        rows.select("part", "data").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long").write.format("noop").mode("overwrite").save()
    return folder


def read_list(folder: str, part: int) -> np.ndarray:
    """What ``lists_by_part`` wrote for a part, in any order; nothing if it had no rows."""
    fs, inner = open_fs(folder)
    if not fs.get_file_info(f"{inner}/{part}.bin").is_file:
        return np.zeros(0, np.int64)
    with fs.open_input_stream(f"{inner}/{part}.bin") as stream:
        return np.frombuffer(stream.read(), "<i8")


def chooser(chosen: DataFrame, key: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """For tasks over a ``numbered`` table: a function that makes a function from row numbers to whether ``chosen`` has them. Each task
    reads the lists of its own rows only, so nothing wide is shuffled and no list is sent to all tasks."""
    folder = lists_by_part(chosen.select(F.shiftright(key, 33).alias("part"), F.array(key).alias("data")), "row-lists")

    def make() -> Callable[[np.ndarray], np.ndarray]:
        loaded, own = None, None

        def among(rows: np.ndarray) -> np.ndarray:
            nonlocal loaded, own
            found = np.zeros(len(rows), bool)
            for part in np.unique(rows >> 33).tolist():
                if part != loaded:
                    loaded, own = part, read_list(folder, part)
                if len(own):
                    found |= np.isin(rows, own)
            return found

        return among

    return make


def without_rows(held: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``held`` (of ``numbered``) whose ``key`` isn't in ``dropped``, however many those are."""
    make, at = chooser(dropped, key), held.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = make()
        for batch in batches:
            yield batch.filter(pa.array(~among(batch.column(at).to_numpy())))

    return held.mapInArrow(run, held.schema)
