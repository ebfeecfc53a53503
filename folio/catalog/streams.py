"""Streams over events, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.streaming import answers, runs
from folio.streaming import events as S


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_events(spark, f"{sf_dir}/event[s].parquet")  # a pattern, since a stream of one file needs one


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.run_to_end(S.tumbling(_stream(spark, sf_dir), "1 hour"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.run_to_end(S.sliding(_stream(spark, sf_dir), "1 hour", "30 minutes"), "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' AS fresh FROM events),
s AS (SELECT user_id, ts, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.run_to_end(S.sessions(_stream(spark, sf_dir), "30 minutes"), "complete")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    twice = stream.unionByName(stream)
    return S.run_to_end(S.distinct_events(twice)).select("event_id", "event_type")


@query("SELECT user_id, count(*) AS n, round(max(epoch(ts)), 3) AS last FROM events GROUP BY user_id")
def stream_stateful_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_to_end(S.running_counts(_stream(spark, sf_dir)), "complete").withColumn("last", F.round("last", 3))


@query("SELECT 'u' || user_id AS path, last(event_type ORDER BY ts, event_type) AS op, count(*) AS n FROM events GROUP BY user_id")
def stream_debounce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _stream(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("op"), "ts")
    return S.run_to_end(S.debounced(changes), "complete").select("path", "op", "n")


@query("""
WITH e AS (SELECT user_id AS ctx_key, event_id, epoch(ts) AS t, CASE WHEN event_type = 'purchase' THEN 'put' ELSE 'get' END AS kind, 'q' || (event_id % 3) AS question FROM events),
p AS (SELECT *, max(CASE WHEN kind = 'put' THEN t END) OVER (PARTITION BY ctx_key, question ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS put_at FROM e)
SELECT ctx_key, event_id, coalesce(t - put_at <= 86400, false) AS hit FROM p WHERE kind = 'get'""")
def stream_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases put a question of their user into a cache that keeps it for a day; other events ask for it."""
    kind = F.when(F.col("event_type") == "purchase", "put").otherwise("get")
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("ctx_key"), "event_id", "ts", kind.alias("kind"), F.concat(F.lit("q"), F.col("event_id") % 3).alias("question"))
    return S.run_to_end(S.cache_stream(rows, ttl=86_400.0))


@query("""
SELECT conv_id AS session, count(*) AS n, arg_max(CASE WHEN role = 'user' THEN text END, turn) FILTER (role = 'user') AS last_entity, arg_max(text LIKE '%?', turn) AS just_clarified FROM conversations GROUP BY conv_id""")
def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation[s].parquet")
    rows = turns.select(F.col("conv_id").alias("session"), "turn", F.timestamp_seconds(86_400 + 60 * F.col("turn")).alias("ts"), F.when(F.col("role") == "user", F.col("text")).alias("entity"), F.col("text").endswith("?").alias("clarified"))
    told = S.run_to_end(S.session_stream(rows), "update", last_only=False)  # a row for each session and batch: the last one has all turns
    return told.groupBy("session").agg(F.max("n").alias("n"), F.max_by("last_entity", "n").alias("last_entity"), F.max_by("just_clarified", "n").alias("just_clarified"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT start, event_type, n FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed: what an append-mode stream has emitted by the end."""
    found = S.run_to_end(S.tumbling(_stream(spark, sf_dir), "1 hour"), "append")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _answers(spark: SparkSession, sf_dir: str, *marks: str) -> DataFrame:
    """The turns of all conversations as a stream of pieces of 1 to 13 characters, each text with marks after it."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation[s].parquet")
    text = F.concat(F.col("text"), *[F.expr(m) for m in marks])
    return answers.in_pieces(turns.select(F.concat_ws("-", "conv_id", "turn").alias("answer"), text.alias("text"), "turn"), F.col("turn") % 13 + 1)


_MEDIA = "concat(' ![see this](https://h', turn % 3, '.example/a.png?turn=', turn, ') and ![own](/assets/x) or ![cut](https://h1.exa')"


@query(rf"""
SELECT conv_id || '-' || turn AS answer, sha256(regexp_replace(text || {_MEDIA}, '!\[[^\]]*\]\(https?://(h1[.]example[^)\s]*|([^)\s/?#:]+)[^)\s]*)\)',
  CASE WHEN turn % 3 = 1 THEN '\0' ELSE '[远程图片已中和：\2]' END, 'g')) AS digest FROM conversations""")
def stream_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote images taken out of answers that come in pieces; one host of three is allowed, and the last image is cut off."""
    found = answers.whole(S.run_to_end(answers.media_stream(_answers(spark, sf_dir, _MEDIA), allow=("h1.example",))))
    return found.select("answer", F.sha2("text", 256).alias("digest"))


_MARKS = "concat(' [[IMG:a', turn % 5, ']] then [[IMG:a', turn % 7, ']][[IMG:', ' and [[IM')"


@query(rf"""
WITH t AS (SELECT conv_id || '-' || turn AS answer, text || {_MARKS} AS text FROM conversations)
SELECT answer, sha256(regexp_replace(regexp_replace(text, '\[\[IMG:a([0-3])\]\]', '![alt \1](/assets/\1)', 'g'), '\[\[IMG:[^\]\s]+\]\]', '', 'g')) AS digest FROM t""")
def stream_image_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image marks of answers that come in pieces, put in where the asset is known: four are."""
    n = spark.range(4).select(F.col("id").cast("string").alias("n"))
    known = n.select(F.concat(F.lit("a"), "n").alias("asset_id"), F.concat(F.lit("/assets/"), "n").alias("img_url"), F.concat(F.lit("alt "), "n").alias("alt"))
    found = answers.whole(S.run_to_end(answers.image_stream(_answers(spark, sf_dir, _MARKS), known)))
    return found.select("answer", F.sha2("text", 256).alias("digest"))


@query("""
WITH e AS (SELECT user_id AS run_id, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS answer FROM events),
g AS (SELECT *, ms - lag(ms) OVER w > 86400000 AS silent, count(*) OVER w AS n, row_number() OVER w AS k, lag(ms) OVER w AS before, min(ms) OVER (PARTITION BY run_id) AS first, max(ms) OVER () AS now, max(ms) OVER (PARTITION BY run_id) AS latest
      FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ms, NOT answer ROWS UNBOUNDED PRECEDING)),
f AS (SELECT run_id, min(k) FILTER (silent OR answer) AS k, max(n) AS n, max(latest) AS latest, max(now) AS now, min(first) AS first FROM g GROUP BY run_id)
SELECT run_id, CASE WHEN f.k IS NULL OR coalesce(silent, false) THEN 'interrupted' ELSE 'finished' END AS status,
       CASE WHEN f.k IS NULL THEN f.latest + 86400001 WHEN coalesce(silent, false) THEN before + 86400001 ELSE ms END AS at,
       CASE WHEN f.k IS NULL THEN f.n WHEN coalesce(silent, false) THEN f.k - 1 ELSE f.k END AS n_events,
       (CASE WHEN f.k IS NULL THEN f.latest WHEN coalesce(silent, false) THEN before ELSE ms END - f.first) / 1000 AS seconds
FROM f LEFT JOIN g USING (run_id, k) WHERE f.k IS NOT NULL OR f.latest + 86400001 <= f.now""")
def stream_ended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that got an answer, or were silent for more than a day: the last ones by a timer."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ts", (F.col("event_type") == "purchase").alias("answer"))
    return S.run_to_end(runs.ended_runs(rows, after=86_400.0))


@query("""
WITH RECURSIVE t AS (SELECT conv_id AS session, turn, length(text) AS cost, row_number() OVER w AS k, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (
  SELECT session, 0::BIGINT AS k, 1::BIGINT AS first, NULL::BIGINT AS a, NULL::BIGINT AS b FROM t WHERE k = 1
  UNION ALL
  SELECT s.session, t.k, CASE WHEN hit THEN t.k - 1 ELSE s.first END, CASE WHEN hit THEN s.first END, CASE WHEN hit THEN t.k - 2 END
  FROM s JOIN LATERAL (SELECT t.k, t.total - coalesce(p.total, 0) >= 500 AND t.k - s.first + 1 > 2 AS hit FROM t LEFT JOIN t p ON p.session = t.session AND p.k = s.first - 1 WHERE t.session = s.session AND t.k = s.k + 1) t ON true
)
SELECT s.session, x.turn AS idx_from, y.turn AS idx_to, b - a + 1 AS n, (y.total - x.total + x.cost)::DOUBLE AS cost
FROM s JOIN t x ON x.session = s.session AND x.k = a JOIN t y ON y.session = s.session AND y.k = b""")
def stream_summary_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of turns that summaries take in while conversations go on: over 500 characters, all but the last two turns."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation[s].parquet").withColumnRenamed("conv_id", "session")
    return S.run_to_end(runs.summary_ranges(turns, F.length("text"), 500, 2))
