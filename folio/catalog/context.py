"""Context algebra over conversations and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.functions import text as T
from folio.operators import context


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits of questions, a hundred for each: the score falls with the length, the heading is the first line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 100).alias("grp"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4)).alias("filepath"), F.concat_ws(" > ", "source", F.substring_index("text", "\n", 1)).alias("heading_path"),
        F.col("lang").alias("kind"), F.lit("").alias("placeholder"), (1000 / (F.col("n_chars") + 1)).alias("score"), (F.col("doc_id") % 3).cast("double").alias("mtime"), F.col("text").alias("content"), F.col("source").alias("title"),
    )


_HITS = "hits AS (SELECT doc_id AS id, doc_id // 100 AS grp, 'f' || (doc_id // 4) AS filepath, source || ' > ' || str_split(text, chr(10))[1] AS heading_path, lang AS kind, 1000 / (n_chars + 1) AS score, (doc_id % 3)::DOUBLE AS mtime, text AS content, source AS title FROM documents)"


@query(rf"""WITH {_HITS},
a AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY filepath, heading_path, kind ORDER BY mtime DESC, score DESC, id) = 1)
SELECT id, filepath, heading_path FROM a QUALIFY row_number() OVER (PARTITION BY md5(trim(regexp_replace(content, '\s+', ' ', 'g'))) ORDER BY mtime DESC, score DESC, id) = 1""")
def dedup_identity_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.dedup(_hits(spark, sf_dir)).select("id", "filepath", "heading_path")


@query("SELECT conv_id, turn, round((length(text) % 100) / 100.0 * pow(0.9, max(turn) OVER (PARTITION BY conv_id) - turn), 6) AS score FROM conversations")
def decay_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ago = F.max("turn").over(Window.partitionBy("conv_id")) - F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(context.decayed((F.length("text") % 100) / 100, ago), 6).alias("score"))


@query(f"""WITH {_HITS}, b AS (SELECT grp, id, sum(greatest(1, length(content) // 2)) OVER (PARTITION BY grp ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS n FROM hits)
SELECT grp, id, used::BIGINT AS used FROM b WHERE (used <= 2000 OR n = 1) AND n <= 30""")
def greedy_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.within_budget(_hits(spark, sf_dir), 2000, [F.desc("score"), F.asc("id")], ("grp",), most=30).select("grp", "id", "used")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.last_turns(table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role")


@query(f"""WITH {_HITS},
p AS (SELECT grp, id, sum(greatest(1, length(content) // 2)) OVER w AS used, row_number() OVER w AS n FROM hits WINDOW w AS (PARTITION BY grp ORDER BY score DESC, id)),
k AS (SELECT grp, id, used FROM p WHERE (used <= 1500 OR n = 1) AND n <= 30), s AS (SELECT grp, max(used) AS spent FROM k GROUP BY grp),
t AS (SELECT conv_id // 10 AS grp, conv_id * 1000 + turn AS turn, text FROM conversations),
h AS (SELECT grp, turn, sum(greatest(1, length(text) // 2)) OVER w AS used, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY grp ORDER BY turn DESC))
SELECT 'piece' AS part, grp, id FROM k UNION ALL SELECT 'turn', grp, turn FROM h LEFT JOIN s USING (grp) WHERE used + coalesce(spent, 0) <= 1500 OR n = 1""")
def total_budget_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 10).alias("grp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), F.col("text").alias("content"))
    kept, history = context.total_budget(_hits(spark, sf_dir), turns, 1500, "grp")
    return kept.select(F.lit("piece").alias("part"), "grp", "id").unionByName(history.select(F.lit("turn").alias("part"), "grp", F.col("turn").alias("id")))


@query(f"""WITH {_HITS}, n AS (SELECT grp, trim(str_split(heading_path, '>')[-1]) AS topic, score AS s FROM hits),
t AS (SELECT grp, topic, max(s) AS score FROM n WHERE topic <> '' GROUP BY grp, topic),
r AS (SELECT grp, topic, score, lead(score) OVER w AS second, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY grp ORDER BY score DESC, topic))
SELECT grp, topic AS top, round(CASE WHEN second IS NOT NULL AND score > 0 THEN (score - second) / score ELSE 1 END, 6) AS margin FROM r WHERE n = 1""")
def topic_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.topic_margin(_hits(spark, sf_dir), "grp").select("grp", "top", F.round("margin", 6).alias("margin"))


@query(f"""WITH {_HITS}, f AS (SELECT grp, title, heading_path, min(id) AS first FROM hits GROUP BY ALL)
SELECT grp, title, string_agg(heading_path, '；' ORDER BY first) AS headings FROM f GROUP BY grp, title""")
def coverage_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.headings_by_title(_hits(spark, sf_dir).withColumn("rank", F.col("id")), "grp")


@query(f"WITH {_HITS} SELECT heading_path FROM hits EXCEPT SELECT heading_path FROM hits WHERE grp % 2 = 0")
def coverage_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return context.uncovered(hits.select("heading_path"), hits.where("grp % 2 = 0").select("heading_path"))


@query("""
WITH r AS (SELECT user_id, event_id, floor(value)::BIGINT AS docs FROM events WHERE value IS NOT NULL),
f AS (SELECT *, (docs > coalesce(max(docs) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END)::INTEGER AS streak FROM i""")
def no_new_doc_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", F.floor("value").alias("docs"))
    return context.stale_streak(rounds, "user_id", "event_id", "docs").select("user_id", "event_id", "streak")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions: their role alone, their text, or their text and a question that leans on what was said; before them the last text."""
    from pyspark.sql import Window

    asked = F.expr("CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN concat(text, ' 它的性能呢') ELSE text END")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "turn", "text", asked.alias("asked"), before.alias("previous"))


_ASKED = "asked AS (SELECT conv_id || '-' || turn AS id, turn, text, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN text || ' 它的性能呢' ELSE text END AS asked, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)"


@query(f"WITH {_ASKED} SELECT id, turn > 0 AND (turn % 5 = 1 OR length(trim(asked)) < 8) AS needs FROM asked")
def needs_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", T.needs_condense(F.col("asked"), F.col("turn")).alias("needs"))


@query(f"""WITH {_ASKED}, r AS (SELECT *, CASE WHEN turn % 5 = 1 THEN text || ' FAISS的性能呢' ELSE asked END AS resolved FROM asked)
SELECT id, CASE WHEN trim(coalesce(previous, '')) <> '' THEN '参考上下文：' || left(trim(previous), 200) || chr(10) || '当前问题：' || resolved ELSE resolved END AS query FROM r""")
def fallback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 characters of the last text are the feature: the context of a question."""
    return _asked(spark, sf_dir).select("id", context.fallback_query(F.col("asked"), F.col("previous"), F.lit("FAISS")).alias("query"))


@query(f"""WITH {_ASKED} SELECT id, (CASE WHEN turn % 5 = 0 THEN 0.3 WHEN turn % 5 = 1 THEN 0.7 WHEN NOT contains(text, 'la') THEN 0.4 WHEN (length(text) % 100) / 100.0 < 0.2 THEN 0.5 ELSE 0.9 END)::DOUBLE AS confidence FROM asked""")
def condense_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    method, entity = F.when(F.col("turn") % 5 == 0, "fallback").otherwise("llm"), F.when(F.col("turn") % 5 != 1, "la")
    return _asked(spark, sf_dir).select("id", context.condense_confidence(method, entity, F.col("text"), (F.length("text") % 100) / 100).cast("double").alias("confidence"))
