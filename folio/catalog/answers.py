"""What surrounds answers, and images: fixtures with their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.operators import answers, assets


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))


_ID = "conv_id || '-' || turn AS id"


@query(f"""SELECT {_ID}, CASE turn % 4 WHEN 0 THEN '{{"turn": ' || turn || '}}' WHEN 3 THEN '{{"b": {{"c": ' || turn || '}}}}' END AS block, CASE turn % 4 WHEN 1 THEN 'rewrite' ELSE 'sufficient' END AS verdict,
  CASE turn % 4 WHEN 0 THEN least(1.0, (length(text) % 100) / 50.0) WHEN 1 THEN 1.0 WHEN 3 THEN 0.0 END::DOUBLE AS share FROM conversations""")
def judge_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as what a judge says: its object inside the text, open, or not there, its verdict and its share as it wrote them."""
    said = F.expr("""concat(text, CASE turn % 4 WHEN 0 THEN concat(' ```json {"turn": ', turn, '} ``` done') WHEN 2 THEN ' open { only' WHEN 3 THEN concat('{"b": {"c": ', turn, '}}') ELSE '' END)""")
    word = F.expr("CASE turn % 4 WHEN 0 THEN 'nonsense' WHEN 1 THEN ' REWRITE ' WHEN 3 THEN 'Sufficient' END")
    share = F.expr("CASE turn % 4 WHEN 0 THEN CAST((length(text) % 100) / 50 AS string) WHEN 1 THEN '7' WHEN 2 THEN 'high' ELSE '-1' END")
    return _turns(spark, sf_dir).select("id", answers.json_block(said).alias("block"), answers.verdict(word).alias("verdict"), answers.clamp(share).alias("share"))


@query(f"""SELECT {_ID}, text || ' ' || CASE turn % 3 WHEN 0 THEN '![Fig](/assets/a0)' WHEN 1 THEN '![](/assets/a1)' ELSE '' END || ' and ' || CASE turn % 2 WHEN 0 THEN '![Fig](/assets/a0)' ELSE '' END AS answer FROM conversations""")
def image_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of two known images and of one that nobody has, behind the text of each turn."""
    rows = _turns(spark, sf_dir).select("id", F.expr("concat(text, ' [[IMG:a', turn % 3, ']] and ', CASE turn % 2 WHEN 0 THEN '[[IMG:a0]]' ELSE '[[IMG:ghost]]' END)").alias("answer"))
    known = table(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.concat(F.lit("a"), "n_nationkey").alias("asset_id"), F.concat(F.lit("/assets/a"), "n_nationkey").alias("img_url"), F.when(F.col("n_nationkey") == 0, "Fig").alias("alt"))
    return answers.replace_marks(rows, known)


@query(f"""SELECT {_ID}, CASE turn % 3 WHEN 0 THEN text || ' /assets/a' || n || '---' || n || '**相关图片：**' || n || n || '![B](/assets/b)' || n
  WHEN 1 THEN text || n || n || '---' || n || '**相关图片：**' || n || n || '![A](/assets/a)' || n || n || '![B](/assets/b)' || n ELSE text END AS answer FROM conversations, (SELECT chr(10) AS n)""".replace("' /assets/a' || n ||", "' /assets/a' || n || n ||"))
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three turns have two images in their context; one of them names the first itself."""
    rows = _turns(spark, sf_dir).select("id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" /assets/a"))).otherwise(F.col("text")).alias("answer"))
    two = F.expr("array(struct(1 AS n, '/assets/a' AS img_url, 'A' AS alt), struct(2 AS n, '/assets/b' AS img_url, 'B' AS alt))")
    images = rows.where("turn % 3 <> 2").select("id", F.inline(two))
    return answers.append_images(rows.select("id", "answer"), images)


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户: ' ELSE '助手: ' END || text, chr(10) ORDER BY turn) AS history FROM t WHERE n <= 20 GROUP BY conv_id""")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.history_lines(table(spark, sf_dir, "conversations"))


@query("""SELECT doc_id // 10 AS query, string_agg('### [' || rank || '] ' || source || '（修改于 2026-01-0' || (1 + doc_id % 3) || '）' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank FROM documents) GROUP BY doc_id // 10""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents' whole texts as the context of each question."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").withColumn("query", F.floor(F.col("doc_id") / 10))
    docs = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc_id")))
    first = F.lit(1767225600)  # the first of January 2026
    return answers.context_block(docs.select("query", "rank", F.col("source").alias("title"), (first + 86400 * (F.col("doc_id") % 3)).alias("mtime"), F.col("text").alias("content")))


@query("""SELECT doc_id AS id, 'obsidian://open?vault=My%20Notes&file=' || source || '%2F' || lang || '%20' || doc_id AS link, lower(hex(doc_id)) || '-' || lower(hex(n_chars)) AS tag, '[x](http://h/assets/' || doc_id || ')' AS url FROM documents""")
def links_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit(" "), "doc_id", F.lit(".md"))
    asset = F.concat(F.lit("[x](/assets/"), "doc_id", F.lit(")"))
    return docs.select(F.col("doc_id").alias("id"), answers.deep_link(path, "My Notes").alias("link"), answers.etag(F.col("doc_id") + 0.7, F.col("n_chars")).alias("tag"), answers.absolute_assets(asset, "http://h/").alias("url"))


@query(f"""
WITH i AS (SELECT doc_id AS id, doc_id % 6 AS k, 1 + doc_id % 2000 AS w, 1 + n_chars % 900 AS h, n_chars * 10 AS size FROM documents),
d AS (SELECT *, CASE WHEN k = 0 OR k = 1 THEN 'image/png' WHEN k = 2 THEN 'image/gif' WHEN k = 3 THEN 'image/svg+xml' WHEN k = 4 THEN 'image/jpeg' END AS mime, CASE WHEN k <= 3 THEN w END AS width, CASE WHEN k <= 3 THEN h END AS height FROM i)
SELECT id, mime, width, height, CASE WHEN k = 3 THEN 'use_svg'
  WHEN k = 1 OR (k <= 3 AND (least(w, h) < {assets.LEAST_SIDE} OR greatest(w, h) > {assets.MOST_RATIO} * least(w, h))) OR (size > 0 AND size < {assets.LEAST_BYTES}) THEN 'decorative' ELSE 'need_vlm' END AS treatment FROM d""")
def image_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG (one of them a logo), GIF, SVG, JPEG without a frame and unknown files, whose sides and sizes follow the documents."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "doc_id % 6 AS k", "1 + doc_id % 2000 AS w", "1 + n_chars % 900 AS h", "n_chars * 10 AS size")
    png = "unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'), '0806'))"
    gif = "unhex(concat('474946383961', lpad(hex(w % 256), 2, '0'), lpad(hex(w div 256), 2, '0'), lpad(hex(h % 256), 2, '0'), lpad(hex(h div 256), 2, '0')))"
    content = f"CASE WHEN k <= 1 THEN {png} WHEN k = 2 THEN {gif} WHEN k = 3 THEN CAST(concat('<svg width=\"', w, '\" height=\"', h, '\"></svg>') AS binary) WHEN k = 4 THEN unhex('FFD8FFE0') ELSE unhex('00010203') END"
    rows = rows.withColumn("content", F.expr(content)).withColumn("name", F.expr("CASE k WHEN 1 THEN 'logo.png' ELSE concat('photo', id) END"))
    rows = rows.select("id", "name", "size", assets.mime(F.col("content")).alias("mime"), assets.dimensions(F.col("content")).alias("d"))
    return rows.select("id", "mime", "d.width", "d.height", assets.treatment(F.col("name"), F.col("mime"), F.col("d.width"), F.col("d.height"), F.col("size")).alias("treatment"))


@query("""
SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN source || '/' || doc_id || '.png' WHEN 1 THEN 'img/' || doc_id || '.png' WHEN 2 THEN 'deep/' || lang || '/' || doc_id || '.png' WHEN 5 THEN source || '/a ' || doc_id || '.png' END AS path FROM documents""")
def image_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images beside their note, below the root, elsewhere by name, nowhere, remote, and with a space in their name; decoys of the first kind stand elsewhere too."""
    docs = table(spark, sf_dir, "documents")
    src = "CASE doc_id % 6 WHEN 1 THEN concat('img/', doc_id, '.png') WHEN 4 THEN concat('http://h/', doc_id, '.png') WHEN 5 THEN concat('a%20', doc_id, '.png') ELSE concat(doc_id, '.png') END"
    asked = docs.selectExpr("doc_id AS id", "source AS note_dir", f"{src} AS src")
    path = "CASE doc_id % 6 WHEN 0 THEN concat(source, '/', doc_id, '.png') WHEN 1 THEN concat('img/', doc_id, '.png') WHEN 2 THEN concat('deep/', lang, '/', doc_id, '.png') WHEN 5 THEN concat(source, '/a ', doc_id, '.png') END"
    files = docs.selectExpr(f"{path} AS path").where("path IS NOT NULL").unionByName(docs.where("doc_id % 6 = 0").selectExpr("concat('aa/', doc_id, '.png') AS path"))
    return assets.resolve(asked, files).select("id", "path")
