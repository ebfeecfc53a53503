"""Streams of file changes and of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.streaming import events as S


def _changes(spark, path, rows):
    spark.createDataFrame(rows, "ts long, path string, op string").coalesce(1).write.mode("append").parquet(path)


def test_bursts_become_one_batch(spark, tmp_path):
    path, seen = str(tmp_path / "changes"), []
    _changes(spark, path, [(1, "a.md", "add"), (2, "a.md", "delete"), (3, "b.md", "add")])
    stream = spark.readStream.schema("ts long, path string, op string").parquet(path)
    query = S.sync_stream(stream, lambda batch: seen.append(sorted((r.path, r.op) for r in batch.collect())), lambda: seen.append("full"), burst=5, seconds=1)
    try:
        query.processAllAvailable()
        _changes(spark, path, [(10 + i, f"{i}.md", "add") for i in range(6)])
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [[("a.md", "delete"), ("b.md", "add")], "full"]


def test_late_rows_are_left_out(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.range(3).select((F.timestamp_seconds(F.lit(10_000) + 4000 * F.col("id"))).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(path)
    first = S.run_to_end(S.tumbling(S.read_events(spark, path), "1 hour"))
    assert first.count() == 2  # the last window is still open


def test_counts_in_state(spark, tmp_path):
    path = str(tmp_path / "events")
    for k in range(2):
        spark.range(4).select(F.timestamp_seconds(F.col("id") + k).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(path)
    got = S.run_to_end(S.running_counts(S.read_events(spark, path, files_per_batch=1)), "complete")
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(0, 4), (1, 4)]


def test_cached_questions_expire(spark, tmp_path):
    """A put is found by later batches until its time to live is over; a context's state ends with its last put."""
    path = str(tmp_path / "asks")
    batches = [[("a", 1, 1000.0, "put", "x"), ("a", 2, 1001.0, "get", "x"), ("b", 3, 1001.0, "get", "x")], [("a", 4, 1050.0, "get", "x"), ("a", 5, 1060.0, "get", "y")], [("a", 6, 1101.0, "get", "x"), ("c", 7, 90_000.0, "put", "z")], [("a", 8, 90_001.0, "get", "x"), ("c", 9, 90_002.0, "get", "z")]]
    for rows in batches:
        frame = spark.createDataFrame(rows, "ctx_key string, event_id long, at double, kind string, question string")
        frame.select("ctx_key", "event_id", F.timestamp_seconds("at").alias("ts"), "kind", "question").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ctx_key string, event_id long, ts timestamp, kind string, question string").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.event_id: r.hit for r in S.run_to_end(S.cache_stream(stream, ttl=100.0)).collect()}
    assert got == {2: True, 3: False, 4: True, 5: False, 6: False, 8: False, 9: True}
