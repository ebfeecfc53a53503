"""Writing keyed tables with Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.state import delete_keys, upsert
from folio.storage import open_fs


def overwrite(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _versions(path: str) -> list[str]:
    """Names of a table's complete versions, oldest first: a version counts once Spark has put its mark of success into it."""
    from pyarrow import fs as pafs

    fs, inner = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("version-"))
    return [n for n in names if fs.get_file_info(f"{inner}/{n}/_SUCCESS").type == pafs.FileType.File]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a merged table; None if there is none yet."""
    names = _versions(path)
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def merge_into(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], gone: DataFrame | None = None) -> None:
    """Upserts ``changes`` into the table at ``path`` and deletes the keys of ``gone``; a table that doesn't exist yet is made.

    The result is a new version in a folder of its own, so a failure leaves the version before it as it was, and a reader of that one
    can finish. Of older versions only the one before stays. One writer at a time."""
    names, table = _versions(path), read_table(spark, path)
    merged = changes if table is None else upsert(delete_keys(table, gone, keys) if gone is not None else table, changes, keys)
    number = int(names[-1].removeprefix("version-")) + 1 if names else 0
    merged.write.mode("overwrite").parquet(f"{path}/version-{number:08d}")
    fs, inner = open_fs(path)
    for old in names[:-1]:
        fs.delete_dir(f"{inner}/{old}")


def append_once(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Appends the rows whose key the table doesn't have; one row for each new key."""
    try:
        fresh = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = rows
    fresh.dropDuplicates(keys).write.mode("append").parquet(path)


def clean(rows: DataFrame) -> DataFrame:
    """Empty strings and empty arrays become null, array elements strings: what a metadata store can hold."""
    out = []
    for field in rows.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "string":
            out.append(F.nullif(F.col(field.name), F.lit("")).alias(field.name))
        elif kind.startswith("array"):
            out.append(F.when(F.size(field.name) > 0, F.col(field.name).cast("array<string>")).alias(field.name))
        else:
            out.append(F.col(field.name))
    return rows.select(*out)


def report_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
