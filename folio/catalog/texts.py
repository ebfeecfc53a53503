"""Scans, filters, parsing and scalar functions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, sql_tokens, table
from folio.functions import blocks
from folio.functions import text as T
from folio.operators import bm25
from folio.sources.notes import from_documents

PATHS = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ai/' WHEN 1 THEN '.obsidian/' WHEN 2 THEN 'a/.trash/' WHEN 3 THEN 'Templates/x/' WHEN 4 THEN 'notes\\' WHEN 5 THEN 'x/templates/' ELSE '' END
  || source || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.HTML' WHEN 2 THEN '.txt' ELSE '.htm' END AS path
FROM documents"""

@query("""
SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS filepath, n_chars, source || ' › 《' || title || '》' AS prefix
FROM (SELECT *, trim(str_split(text, chr(10))[1]) AS title FROM documents)
WHERE lang = 'fr' AND n_chars >= 500""")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'fr' and n_chars >= 500")
    notes = from_documents(docs).withColumn("n_chars", F.length("text").cast("long"))
    return notes.select("doc_id", "filepath", "n_chars", T.prefix(F.col("dir"), F.col("title"), F.lit(T.NO_HEADING)).alias("prefix"))


@query(rf"""
SELECT doc_id, path, is_ignored, NOT is_ignored AND regexp_matches(lower(path), '\.(md|html|htm)$') AS indexable
FROM (SELECT *, len(list_filter(regexp_split_to_array(path, '[/\\]'), lambda s: starts_with(s, '.') OR lower(s) = 'templates')) > 0 AS is_ignored FROM ({PATHS}))""")
def ignore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_for_paths")
    paths = spark.sql(PATHS.replace("documents", "documents_for_paths").replace("AS VARCHAR", "AS STRING").replace("'notes\\'", "'notes\\\\'"))
    ignored = ("Templates",)
    return paths.select("doc_id", "path", T.is_ignored(F.col("path"), ignored).alias("is_ignored"), T.is_indexable(F.col("path"), ignored).alias("indexable"))


@query(r"""
SELECT md5(body) AS hash, min(doc_id) AS keep_id, count(*) AS copies
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents) GROUP BY body""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))


@query(f"""
SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf
FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens("text")}) AS token FROM documents) GROUP BY doc_id, token) GROUP BY token""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bm25.counted_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return counted.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"""
WITH d AS (SELECT doc_id, len({sql_tokens("text")}) AS dl FROM documents),
v AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens("text")}) AS token FROM documents) GROUP BY token)
SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl, (SELECT count(*) FROM v) AS n_tokens,
       (SELECT round(avg(ln((SELECT count(*) FROM d) - df + 0.5) - ln(df + 0.5)), 6) FROM v) AS mean_idf
FROM d""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.catalog.retrieval import saved_rows

    index = saved_rows(spark, sf_dir)
    n = index.vocabulary.agg(F.count("*").alias("n_tokens"))
    return index.stats.crossJoin(F.broadcast(n)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_tokens", F.round("mean_idf", 6).alias("mean_idf"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS emails,
       len(regexp_extract_all(text, 'https?://[^\s)]+'))::BIGINT AS urls,
       len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers,
       regexp_matches(text, '(?i)(diagram|chart|screenshot|figure|image)') AS image_intent
FROM documents""")
def regex_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), count(r"https?://[^\s)]+").alias("urls"),
        count("[0-9]+").alias("numbers"), text.rlike(T.IMAGE_INTENT).alias("image_intent"),
    )


@query("""
SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'Doc ' || doc_id WHEN 1 THEN 'It''s: ' || doc_id WHEN 2 THEN 'two lines ' || doc_id WHEN 3 THEN 'folded text ' || doc_id ELSE 'note' || doc_id END AS title,
       CASE doc_id % 5 WHEN 0 THEN 'ai|' || source WHEN 1 THEN 'ai|' || source || '|a, b' WHEN 2 THEN 'one|' || source ELSE '' END AS tags, CASE doc_id % 5 WHEN 1 THEN '检索增强' ELSE '' END AS aliases
FROM documents""")
def front_matter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under front matter of five kinds: lists in brackets, with dashes and over several lines, quotes, comments, folded text, and none."""
    i, source = F.col("doc_id").cast("string"), F.col("source")
    flow = F.concat(F.lit("---\ntitle: Doc "), i, F.lit("  # the title\ntags: [ai, "), source, F.lit("]\nmeta:\n  title: inner\n---\n"))
    dashed = F.concat(F.lit("---\ntitle: 'It''s: "), i, F.lit("'\ntags:  # all of them\n  - ai\n  - \""), source, F.lit("\"\n\n  - 'a, b'  # one tag\naliases:\n- 检索增强\n---\n"))
    lines = F.concat(F.lit("---\ntags: [one,\n  "), source, F.lit("]\ntitle: two\n  lines "), i, F.lit("\n---\n"))
    folded = F.concat(F.lit("---\r\ntitle: >\r\n  folded\r\n  text "), i, F.lit("\r\ntags: not a list\r\n---\r\n"))
    k = F.col("doc_id") % 5
    raw = F.concat(F.when(k == 0, flow).when(k == 1, dashed).when(k == 2, lines).when(k == 3, folded).otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce(T.front_matter_value(raw, "title"), F.concat(F.lit("note"), i)).alias("title"),
        F.array_join(T.front_matter_list(raw, "tags"), "|").alias("tags"), F.array_join(T.front_matter_list(raw, "aliases"), "|").alias("aliases"),
    )


@query(r"""
WITH r AS (SELECT doc_id AS id, regexp_replace(text, '(^|\n)([^\s\[\]|]+)', '\1[[\2|x]] [[\2]]', 'g') AS raw FROM documents)
SELECT id, i AS place, link FROM (
  SELECT id, link, row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS i FROM (
    SELECT id, link, min(n) AS first FROM (
      SELECT id, unnest(links) AS link, generate_subscripts(links, 1) AS n FROM (SELECT id, regexp_extract_all(raw, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1) AS links FROM r)
    ) GROUP BY id, link))""")
def wikilinks_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines begin with links to their first words."""
    raw = F.regexp_replace("text", r"(^|\n)([^\s\[\]|]+)", "$1[[$2|x]] [[$2]]")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(T.wikilinks(raw)).alias("place", "link")).select("id", F.col("place").cast("long").alias("place"), "link")


@query(r"""
WITH r AS (SELECT doc_id AS id, list_transform(str_split(text, chr(10)), lambda x: CASE WHEN length(x) <= 25 AND trim(x) <> '' THEN '## ' || trim(x) WHEN length(x) % 7 = 0 THEN '####### seven' WHEN length(x) % 7 = 1 THEN '#none' ELSE x END) AS lines FROM documents)
SELECT id, length(regexp_extract(l, '^(#{1,6})\s+(.+)$', 1))::INTEGER AS level, trim(regexp_extract(l, '^(#{1,6})\s+(.+)$', 2)) AS heading, n::INTEGER AS line
FROM (SELECT id, unnest(lines) AS l, generate_subscripts(lines, 1) AS n FROM r)
WHERE regexp_matches(l, '^(#{1,6})\s+(.+)$')""")
def headings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with short lines as headings, and lines that only look like one."""
    n = F.length
    line = lambda x: F.when((n(x) <= 25) & (F.trim(x) != ""), F.concat(F.lit("## "), F.trim(x))).when(n(x) % 7 == 0, "####### seven").when(n(x) % 7 == 1, "#none").otherwise(x)
    raw = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(T.headings(raw)).alias("h")).select("id", "h.level", F.col("h.text").alias("heading"), "h.line")


@query(r"""
SELECT doc_id AS id, place, kind, placeholder, true AS restored FROM documents, (VALUES
  (0, 0, 'mermaid', '[MERMAID_UID_00000000]'), (0, 1, 'code', '<CODE_UID_00000001>'), (0, 2, 'image', '[IMAGE_UID_00000002]'), (0, 3, 'image', '[IMAGE_UID_00000003]'),
  (1, 0, 'code', '<CODE_UID_00000000>'), (1, 1, 'table', '[TABLE_UID_00000001]')) v(k, place, kind, placeholder) WHERE doc_id % 3 = k""")
def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with diagrams, code, tables and images around their text."""
    k, text = F.col("doc_id") % 3, F.regexp_replace("text", r"[|!`\[]", " ")
    many = F.concat(F.lit("```mermaid\ngraph TD\nA-->B\n```\n"), text, F.lit("\n```py\nx = 1\n```\n![[img.png|300]] and ![alt](p.png)"))
    some = F.concat(F.lit("```python\nx = 1\n```\nCaption\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"), text)
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, many).when(k == 1, some).otherwise(text).alias("raw")).withColumn("text", F.col("raw"))
    held = blocks.extract(notes)
    back = blocks.restore(F.col("text"), F.col("blocks")) == F.col("raw")
    return held.select("id", back.alias("restored"), F.posexplode_outer("blocks").alias("place", "b")).where("b IS NOT NULL").select("id", "place", "b.kind", "b.placeholder", "restored")


@query(r"""
SELECT p_partkey, upper(p_brand) AS brand, left(p_type, 5) AS kind, length(p_name)::INTEGER AS name_length, reverse(p_brand) AS backwards,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS size_code, position('a' IN p_name)::INTEGER AS first_a, replace(p_name, ' ', '_') AS slug, sha256(p_name) AS digest
FROM part""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_brand").alias("brand"), F.left("p_type", F.lit(5)).alias("kind"), F.length("p_name").alias("name_length"), F.reverse("p_brand").alias("backwards"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size_code"), F.instr("p_name", "a").alias("first_a"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"), F.sha2("p_name", 256).alias("digest"),
    )


@query(r"""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, strftime(o_orderdate, '%Y-%m-%d') AS day,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS days
FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(at).alias("y"), F.month(at).alias("m"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(F.trunc(at, "month"), "yyyy-MM-dd").alias("month_start"), F.datediff(at, F.lit("1992-01-01").cast("date")).alias("days")
    )


@query(r"""
SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total,
       count(*) FILTER (value > 50) AS high FROM events GROUP BY ALL""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("value") > 50).alias("high"))


@query(r"""
SELECT vec_id, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x * x), 'sum'), 4) AS norm2, round(list_max(embedding)::DOUBLE, 5) AS high,
       len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive, round(list_sort(embedding)[1]::DOUBLE, 5) AS low FROM embeddings""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    norm = F.aggregate(F.transform(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 4).alias("norm2"), F.round(F.array_max(e).cast("double"), 5).alias("high"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.round(F.sort_array(e)[0].cast("double"), 5).alias("low"))


@query(f"""
SELECT doc_id, gram, count(*) AS n FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, {sql_tokens("text")} AS w FROM documents)))
GROUP BY doc_id, gram HAVING count(*) >= 3""")
def repeated_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return T.repeated_ngrams(words, "w", 3, 3)
