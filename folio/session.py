"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: dict[str, str] = {}

#: Bytes of rows that go to Python at once where a session sets none: Spark's 64 MB are held for each task by the executor, outside its heap, and by the worker.
BATCH_BYTES = "4m"


def build_session(app: str = "folio", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with the settings this library is written for: UTC, adaptive execution, Arrow batches of at most 10,000 rows and about 16 MB."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000").config("spark.sql.execution.arrow.maxBytesPerBatch", "16m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in (("spark.sql.shuffle.partitions", shuffle_partitions), ("spark.driver.memory", driver_memory)):
        if value:
            builder = builder.config(key, str(value))
    spark = (builder.master(master) if master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Has rows go to Python ``BATCH_BYTES`` at a time in this session, if it hasn't set a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="folio-zip-"), "folio_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
