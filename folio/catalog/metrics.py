"""Ranking and text metrics, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, sql_tokens, table
from folio.operators import bm25, bm25_rows, metrics, patterns
from folio.storage import cut

_RANKED = f"""
tok AS MATERIALIZED (SELECT doc_id, {sql_tokens("text")} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM tok) GROUP BY doc_id, token),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), st),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT query, token, count(*) AS qtf FROM (SELECT item_id AS query, unnest({sql_tokens("text")}) AS token FROM benchmark) GROUP BY query, token),
scored AS (SELECT query, post.doc_id AS item, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))) AS score FROM asked JOIN idf USING (token) JOIN post USING (token) JOIN tok USING (doc_id), st GROUP BY query, post.doc_id),
ranked AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, item) AS rank FROM scored QUALIFY rank <= 10),
gold AS (SELECT item_id AS query, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ten best documents for each benchmark item, written once, and the documents that hold its passage."""
    from folio.catalog.retrieval import saved_rows

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = bm25_rows.search(saved_rows(spark, sf_dir), bm25.query_tokens(asked), 10)
    return cut(found.select("query", F.col("id").alias("item"), "rank"), "ranked"), gold_by_passage(spark, sf_dir).select(F.col("item_id").alias("query"), F.col("doc_id").alias("item"))


def _at(k: int) -> str:
    return f"""round(CASE WHEN n_gold = 0 THEN 0 ELSE coalesce(hits_{k}, 0) / n_gold END, 5) AS recall_{k}, round(coalesce(hits_{k}, 0) / {k}, 5) AS precision_{k},
  round(CASE WHEN n_gold = 0 THEN 0 ELSE coalesce(dcg_{k}, 0) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, {k} + 1)) AS i) WHERE i <= n_gold) END, 5) AS ndcg_{k}"""


@query(f"""WITH {_RANKED}, f AS (SELECT query, item, min(rank) AS rank FROM ranked GROUP BY query, item), g AS (SELECT query, count(*) AS n_gold FROM gold GROUP BY query),
h AS (SELECT query, max(1 / rank) AS mrr, {", ".join(f"sum((rank <= {k})::INT) AS hits_{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg_{k}" for k in (3, 5, 10))} FROM f JOIN gold USING (query, item) GROUP BY query),
q AS (SELECT DISTINCT query FROM ranked), j AS (SELECT query, coalesce(n_gold, 0) AS n_gold, h.* EXCLUDE (query) FROM q LEFT JOIN g USING (query) LEFT JOIN h USING (query))
SELECT query, round(coalesce(mrr, 0), 5) AS mrr, {", ".join(_at(k) for k in (3, 5, 10))} FROM j""")
def mrr_recall_precision_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.ranking_metrics(*_ranked(spark, sf_dir))
    return found.select("query", *(F.round(c, 5).alias(c) for c in found.columns if c != "query"))


@query(f"""WITH {_RANKED}, f AS (SELECT query, item, rank FROM ranked), s AS (SELECT query, count(*) AS n_seen FROM f GROUP BY query), h AS (SELECT query, count(*) FILTER (rank <= 5) AS hits FROM f JOIN gold USING (query, item) GROUP BY query)
SELECT query, round(coalesce(hits, 0) / greatest(1, least(5, n_seen)), 5) AS precision_5 FROM s LEFT JOIN h USING (query)""")
def precision_by_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, gold = _ranked(spark, sf_dir)
    found = metrics.ranking_metrics(ranked, gold, ks=(5,), by_shown=True)
    return found.join(ranked.select("query").distinct(), "query", "left_semi").select("query", F.round("precision_5", 5).alias("precision_5"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_by_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id")


_PAIRS = "pairs AS (SELECT a.doc_id AS pair, a.text AS candidate, b.text AS reference FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text with that of the next one."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("pair"), F.col("text").alias("candidate")).join(docs.select((F.col("doc_id") - 1).alias("pair"), F.col("text").alias("reference")), "pair")


def _words(side: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({side}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"


@query(f"WITH {_PAIRS}, w AS (SELECT pair, {_words('candidate')} AS c, {_words('reference')} AS r FROM pairs) SELECT pair, round(CASE WHEN len(c) > 0 AND len(r) > 0 THEN len(list_intersect(c, r)) / len(list_distinct(list_concat(c, r))) ELSE 0 END, 5) AS similarity FROM w")
def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(metrics.normal_words(F.col("text"))).alias("words"))  # once for each text, which has two pairs
    pairs = docs.select(F.col("doc_id").alias("pair"), F.col("words").alias("c")).join(docs.select((F.col("doc_id") - 1).alias("pair"), F.col("words").alias("r")), "pair")
    return pairs.select("pair", F.round(metrics.shared_words(F.col("c"), F.col("r")), 5).alias("similarity"))


def _bleu_sql(n: int) -> str:
    gram = lambda s: f"SELECT pair, array_to_string({s}[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT pair, {s}, unnest(range(1, len({s}) - {n - 2})) AS i FROM w) GROUP BY ALL"
    return f"""WITH {_PAIRS}, w AS (SELECT pair, {_words("candidate")} AS c, {_words("reference")} AS r FROM pairs), cg AS ({gram("c")}), rg AS ({gram("r")}),
m AS (SELECT pair, sum(least(cg.n, coalesce(rg.n, 0))) AS clipped, count(*) AS kinds FROM cg LEFT JOIN rg USING (pair, g) GROUP BY pair)
SELECT pair, round(CASE WHEN kinds > 0 THEN CASE WHEN len(c) > len(r) THEN 1 ELSE exp(1 - len(r) / len(c)) END * clipped / kinds ELSE 0 END, 5) AS bleu FROM w LEFT JOIN m USING (pair)"""


@query(_bleu_sql(1))
def bleu_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bleu(_pairs(spark, sf_dir), 1).select("pair", F.round("bleu", 5).alias("bleu"))


@query(_bleu_sql(4))
def bleu_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bleu(_pairs(spark, sf_dir), 4).select("pair", F.round("bleu", 5).alias("bleu"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair", F.round(metrics.rouge_l(F.col("candidate"), F.col("reference")), 5).alias("rouge_l"))


@query("SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM (SELECT doc_id, source || '/' || lang || '/n' || doc_id || '.md' AS path FROM documents)")
def basename_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.functions.text import basename, stem

    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("n"), "doc_id", F.lit(".md")))
    return table(spark, sf_dir, "documents").select("doc_id", basename(path).alias("base"), stem(path).alias("stem"))


_RECORDS = "records AS (SELECT d.source AS arm, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE quality::DOUBLE END AS quality, toxic::DOUBLE AS toxic, (n_chars % 100)::DOUBLE AS latency FROM documents d LEFT JOIN labels USING (doc_id))"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("source").alias("arm"), F.when(F.col("doc_id") % 4 != 0, F.col("quality").cast("double")).alias("quality"), F.col("toxic").cast("double").alias("toxic"), (F.col("n_chars") % 100).cast("double").alias("latency"))


_ROLLED = "rolled AS (SELECT arm, metric, round(avg(value), 4) AS mean, count(value) AS n FROM (SELECT arm, unnest(['quality', 'toxic', 'latency']) AS metric, unnest([quality, toxic, latency]) AS value FROM records) GROUP BY arm, metric)"


@query(f"WITH {_RECORDS}, {_ROLLED} SELECT * FROM rolled")
def metric_rollup_null_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollup(_records(spark, sf_dir), ["arm"], ["quality", "toxic", "latency"])


@query(f"WITH {_RECORDS}, {_ROLLED} SELECT metric, CASE WHEN count(DISTINCT mean) >= 2 THEN arg_min(arm, (CASE WHEN metric = 'quality' THEN -mean ELSE mean END, arm)) END AS best FROM rolled WHERE mean IS NOT NULL GROUP BY metric".replace("arg_min(arm, (CASE WHEN metric = 'quality' THEN -mean ELSE mean END, arm))", "first(arm ORDER BY CASE WHEN metric = 'quality' THEN -mean ELSE mean END, arm)"))
def best_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_arm(metrics.rollup(_records(spark, sf_dir), ["arm"], ["quality", "toxic", "latency"]), ("latency", "toxic"))


@query("SELECT source AS variant, CASE WHEN quality = 1 THEN 'sufficient' WHEN quality = 0 THEN 'rewrite' ELSE 'unjudged' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "sufficient").when(F.col("quality") == 0, "rewrite").otherwise("unjudged")
    return docs.groupBy(F.col("source").alias("variant"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT source, round(avg(n_chars) FILTER (lang = 'en'), 1) AS en, round(avg(n_chars) FILTER (lang = 'fr'), 1) AS fr, round(avg(n_chars) FILTER (lang = 'de'), 1) AS de, round(avg(n_chars) FILTER (lang = 'es'), 1) AS es FROM documents GROUP BY source")
def variant_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.round(F.avg("n_chars"), 1))


@query("""
WITH c AS (SELECT conv_id, length(text)::BIGINT AS prompt, (length(text) // 2)::BIGINT AS completion, CASE WHEN turn > 0 THEN (length(text) // 4)::BIGINT ELSE 0 END AS cache_read FROM conversations)
SELECT conv_id, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, (sum(prompt) + sum(completion))::BIGINT AS total, CASE WHEN sum(prompt) > 0 THEN round(sum(cache_read) / sum(prompt), 4) ELSE 0 END AS hit_rate FROM c GROUP BY conv_id""")
def token_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("long")
    calls = table(spark, sf_dir, "conversations").select("conv_id", size.alias("prompt"), F.floor(size / 2).alias("completion"), F.when(F.col("turn") > 0, F.floor(size / 4)).otherwise(0).alias("cache_read"))
    return metrics.token_meter(calls, "conv_id")


@query("""
SELECT conv_id || '-' || turn AS id, (CASE WHEN turn % 5 < 3 THEN length(text) ELSE 0 END)::BIGINT AS prompt, (CASE WHEN turn % 5 < 3 THEN turn ELSE 0 END)::BIGINT AS completion,
       (CASE WHEN turn % 5 < 3 THEN length(text) // 2 ELSE 0 END)::BIGINT AS cache_read FROM conversations""")
def usage_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each turn in three layouts, or in none that can be read."""
    n, half = "length(text)", "length(text) div 2"
    layouts = (
        f"""concat('{{"input_tokens": ', {n}, ', "output_tokens": ', turn, ', "input_token_details": {{"cache_read": ', {half}, '}}}}')""",
        f"""concat('{{"prompt_tokens": ', {n}, ', "completion_tokens": ', turn, ', "prompt_tokens_details": {{"cached_tokens": ', {half}, '}}}}')""",
        f"""concat('{{"prompt_tokens": ', {n}, ', "completion_tokens": ', turn, ', "prompt_cache_hit_tokens": ', {half}, '}}')""",
    )
    usage = "CASE turn % 5 " + " ".join(f"WHEN {k} THEN {layout}" for k, layout in enumerate(layouts)) + " WHEN 3 THEN '{}' ELSE 'broken' END"
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.expr(usage).alias("usage"))
    return rows.select("id", metrics.normal_usage(F.col("usage")).alias("u")).select("id", "u.*")


@query("""
SELECT user_id AS run_id, count(*) FILTER (event_type = 'click') AS n_tool_calls, count(*) FILTER (event_type = 'view') AS n_verdicts, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'search' ELSE 'chat' END AS route FROM events GROUP BY user_id""")
def trajectory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "view", "judge").otherwise("answer")
    return metrics.trajectory(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), kind.alias("type")))


@query("""
WITH t AS (SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'retrieve' WHEN 'view' THEN 'retrieve' WHEN 'purchase' THEN 'generate' END AS stage, value AS ms FROM events)
SELECT run_id, s AS stage, round(coalesce(sum(ms) FILTER (stage = s), 0), 1) AS ms FROM t, (VALUES ('retrieve'), ('generate')) v(s) GROUP BY run_id, s""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("node"), F.col("value").alias("ms"))
    return metrics.stage_times(timings, {"click": "retrieve", "view": "retrieve", "purchase": "generate"})
