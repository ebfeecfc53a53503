"""Runs, turns, snapshots, upserts and the semantic cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.operators import state


@query("SELECT user_id AS run_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS place, event_type FROM events")
def run_snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", F.col("ts").alias("at"))
    return state.replay(events).select("run_id", "seq", "place", "event_type")


@query("""
WITH e AS (SELECT user_id AS run_id, epoch(ts) AS t, event_type FROM events), n AS (SELECT max(t) AS now FROM e)
SELECT run_id, CASE WHEN max((event_type = 'purchase')::INT) = 1 THEN 'finished' WHEN max(now) - max(t) > 600 THEN 'interrupted' ELSE 'running' END AS status, count(*) AS n_events,
       floor(max(t) - min(t))::BIGINT AS seconds FROM e, n GROUP BY run_id""")
def orphan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("event_type") == "purchase", "answer").otherwise("thought").alias("kind"))
    now = events.agg(F.max("at").alias("now"))
    found = state.run_status(events, F.lit(now.first()[0]))
    return found.withColumn("seconds", F.floor("seconds"))


@query("SELECT conv_id AS session_id, max(turn) AS idx_to, arg_max(text, turn) AS summary FROM conversations GROUP BY conv_id")
def latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx_to"), F.lit(0).alias("idx_from"), F.col("text").alias("summary"))
    return state.latest_summary(rows).select("session_id", "idx_to", "summary")


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 4")
def session_cap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.beyond_cap(table(spark, sf_dir, "conversations"), 4, "conv_id", "turn").select("conv_id", "turn")


@query("""
WITH c AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, min(turn) AS idx_from, max(turn) AS idx_to, count(*) AS n FROM c WHERE cost >= 500 AND n > 2 GROUP BY conv_id""")
def rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rolling_summary(table(spark, sf_dir, "conversations"), F.length("text"), 500, 2)


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    row = lambda d, mtime, text: d.select(F.col("doc_id").alias("filepath"), mtime.alias("mtime"), F.sha2(text, 256).alias("sha256"))
    old = row(docs.where("doc_id % 10 <> 0"), F.lit(1.0), F.col("text"))
    new = row(docs.where("doc_id % 10 <> 1"), F.when(F.col("doc_id") % 10 == 2, 2.0).otherwise(1.0), F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old, new


@query("SELECT doc_id AS filepath, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' ELSE 'unchanged' END AS change FROM documents")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.snapshot_diff(*_snapshots(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE source END AS source FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return state.upsert(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 3 = 0").withColumn("source", F.lit("changed")), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'fresh' END AS source FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return state.insert_new(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 3 = 0").withColumn("source", F.lit("fresh")), ["doc_id"])


@query("""
WITH a AS (SELECT vec_id AS ask_id, label % 3 AS ctx, embedding AS e, vec_id * 10.0 AS t FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS entry_id, label % 3 AS ctx, embedding AS e, vec_id * 10.0 + 5 AS ts FROM embeddings),
s AS (SELECT ask_id, entry_id, list_cosine_similarity(a.e::DOUBLE[], c.e::DOUBLE[]) AS similarity FROM a JOIN c ON a.ctx = c.ctx AND ts <= t AND t - ts <= 3600)
SELECT ask_id, entry_id, round(similarity, 5) AS similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY similarity DESC, entry_id) = 1""")
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("ctx_key", F.col("label") % 3).withColumn("time", F.col("vec_id") * 10.0)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("ask_id"), "ctx_key", "embedding", F.col("time").alias("at"))
    entries = vectors.select(F.col("vec_id").alias("entry_id"), "ctx_key", "embedding", (F.col("time") + 5).alias("ts"))
    return state.cache_lookup(asked, entries, 0.3).withColumn("similarity", F.round("similarity", 5))
