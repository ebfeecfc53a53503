"""What nodes of a run and batches of a stream did, as Spark saw it: a table of (run, node, rows, ms, at)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from folio.storage import cut

SCHEMA = "run string, node string, rows long, ms double, at double"


class RunLog:
    """Collects rows of one run and appends them to the table at ``path``: a row for each node and batch, which are few however large the tables are."""

    def __init__(self, spark: SparkSession, path: str, run: str) -> None:
        self.spark, self.path, self.run = spark, path, run
        self.rows: list[tuple[str, str, int, float, float]] = []

    def add(self, node: str, rows: int, ms: float) -> None:
        self.rows.append((self.run, node, rows, ms, time.time()))

    def node(self, name: str, df: DataFrame) -> DataFrame:
        """Writes ``df`` to the shared folder, with its rows counted on the way by an observation, and notes them and how long it took."""
        seen, start = Observation(f"{self.run}:{name}:{len(self.rows)}"), time.time()
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")), "node")
        self.add(name, seen.get["rows"], 1000 * (time.time() - start))
        return out

    def save(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    @contextmanager
    def streams(self) -> Iterator[None]:
        """Batches of streams that run meanwhile are noted as ``name/batch`` with their input rows; a stream without a name by its id."""
        listener = _Batches(self)
        self.spark.streams.addListener(listener)
        try:
            yield
        finally:
            self.spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
            self.spark.streams.removeListener(listener)


class _Batches(StreamingQueryListener):
    def __init__(self, log: RunLog) -> None:
        self.log = log

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        self.log.add(f"{p.name or p.id}/{p.batchId}", p.numInputRows, float(p.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass
