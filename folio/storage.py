"""Tables and files that operators keep in the cluster's shared folder between two of their jobs."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (as in local tests), a temporary one for this driver."""
    global _fallback
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, _fallback, ignore_errors=True)
    return "file://" + _fallback


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; removed at the end of the innermost ``scope``, or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_remove, path)
    return path


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Folders that are made in here go at its end: what they were for has been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(path)


def _remove(path: str) -> None:
    try:
        fs, inner = open_fs(path)
        fs.delete_dir(inner)
    except Exception:  # the folder may never have been made, or its store is gone by now
        pass


def open_fs(path: str):
    """(file system, path in it) of a URI or a plain path, for reading and writing raw files in tasks."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files: what they wrote to the shared folder is all that is read later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_folder = path
    return out


def discard(table: DataFrame | str) -> None:
    """Deletes what ``cut`` wrote for ``table``, or a folder of ``new_folder``, which no plan reads any more."""
    _remove(table if isinstance(table, str) else table._folio_folder)
