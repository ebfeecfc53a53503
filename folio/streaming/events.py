"""Event streams: windows with watermarks, sessions, duplicates, late rows, keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.storage import new_folder


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table as a stream; times without a zone become UTC times, which watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append", last_only: bool | None = None) -> DataFrame:
    """Runs a stream over what is there now, and returns what it wrote: all batches in append mode, the last one in complete and update mode, unless ``last_only`` says otherwise.

    Batches go to folders of their own in the shared folder, so that a repeated batch overwrites itself."""
    spark = stream.sparkSession
    out, seen = new_folder(spark, "stream-out"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_folder(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    if not seen:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/batch={n}" for n in (seen[-1:] if last_only or last_only is None and mode != "append" else seen)]
    return spark.read.schema(stream.schema).parquet(*paths)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): bursts of events with no longer gap between them; the end is that of the last event plus the gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def running_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, last): a count for each key and the time of its last event."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max(F.unix_micros("ts").cast("double").__truediv__(1e6)).alias("last"))


def cache_stream(events: DataFrame, ttl: float = 3600.0, cap: int = 1000, late: str = "10 minutes") -> DataFrame:
    """(ctx_key, event_id, hit): answers of a keyed cache to the ``get`` rows of a stream (ctx_key, event_id, ts, kind: put or get, question).

    Each context has state of its own: when each of its questions was put last, the newest ``cap`` of them. A get hits if its question was put at most
    ``ttl`` seconds before. Rows of a batch count in the order of (ts, event_id). State of a context ends ``ttl`` after its last put, by the
    watermark, which falls ``late`` behind the newest row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        puts = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        ids, hits = [], []
        for event_id, at, kind, question in zip(rows["event_id"], rows["at"], rows["kind"], rows["question"], strict=True):
            if kind == "put":
                puts.pop(question, None)  # the newest stand last
                puts[question] = at
                if len(puts) > cap:
                    del puts[next(iter(puts))]
            else:
                ids.append(event_id)
                hits.append(question in puts and at - puts[question] <= ttl)
        newest = float(rows["at"].max())
        puts = {q: at for q, at in puts.items() if newest - at <= ttl}
        state.update((list(puts), list(puts.values())))
        ends = int(1000 * (max(puts.values(), default=newest) + ttl)) + 1
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"ctx_key": [key[0]] * len(ids), "event_id": ids, "hit": hits})

    kind = dict(events.dtypes)["ctx_key"]
    timed = events.withWatermark("ts", late).select("ctx_key", "event_id", "ts", "kind", "question", F.unix_micros("ts").cast("double").__truediv__(1e6).alias("at"))
    return timed.groupBy("ctx_key").applyInPandasWithState(step, f"ctx_key {kind}, event_id long, hit boolean", "questions array<string>, at array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(turns: DataFrame, idle: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """(session, n, last_entity, just_clarified): what a conversation keeps from turn to turn, for a stream (session, turn, ts, entity, clarified); sent after each batch.

    The last entity that isn't null stays until another one comes. A session ends when the watermark is ``idle`` seconds past its last turn."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, entity, clarified = state.get if state.exists else (0, None, False)
        rows = pd.concat(list(frames)).sort_values("turn")
        for row in rows.itertuples():
            n, entity, clarified = n + 1, entity if row.entity is None else row.entity, bool(row.clarified)
        state.update((n, entity, clarified))
        ends = int(1000 * (float(rows["at"].max()) + idle)) + 1
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"session": [key[0]], "n": [n], "last_entity": [entity], "just_clarified": [clarified]})

    kind = dict(turns.dtypes)["session"]
    timed = turns.withWatermark("ts", late).select("session", "turn", "ts", "entity", "clarified", F.unix_micros("ts").cast("double").__truediv__(1e6).alias("at"))
    return timed.groupBy("session").applyInPandasWithState(step, f"session {kind}, n long, last_entity string, just_clarified boolean", "n long, entity string, clarified boolean", "update", GroupStateTimeout.EventTimeTimeout)


def debounced(changes: DataFrame, key: str = "path") -> DataFrame:
    """The last operation for each path of a batch of changes (ts, path, op)."""
    return changes.groupBy(key).agg(F.max_by("op", F.struct("ts", "op")).alias("op"), F.max("ts").alias("ts"), F.count("*").alias("n"))


def sync_stream(changes: DataFrame, apply: Callable[[DataFrame], None], full_sync: Callable[[], None], calibrate: Callable[[], None] | None = None, burst: int = 5, every: int = 20, seconds: int = 3) -> object:
    """Feeds a stream of file changes to ``apply``, in micro-batches that hold the last operation for each path; a batch of ``burst`` paths or more is
    answered by a full sync instead, and every so many batches the derived tables are made anew. Batches follow each other, so there is one writer."""

    def step(batch: DataFrame, number: int) -> None:
        last = debounced(batch).persist()
        try:
            n = last.count()
            if n >= burst:
                full_sync()
            elif n:
                apply(last)
            if calibrate and number and number % every == 0:
                calibrate()
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(step).trigger(processingTime=f"{seconds} seconds").start()
