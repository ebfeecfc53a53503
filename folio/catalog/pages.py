"""HTML pages: titles, links, text, Markdown, hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.functions import diagrams
from folio.functions import html as H
from folio.operators import guard


def _sql_inner(tag: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query(f"""SELECT page_id, coalesce({_sql_inner("title")}, {_sql_inner("h1")}) AS title, {_sql_inner("h1")} AS h1 FROM pages""")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.title(html, F.col("url")).alias("title"), H._first(html, "h1").alias("h1"))


@query(r"""
SELECT page_id, i - 1 AS place, trim(href) AS href, NOT regexp_matches(trim(href), '^(#|//|[A-Za-z][A-Za-z0-9+.\-]*:)') AS relative
FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages))""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.hrefs(F.col("html"))).alias("place", "href"))
    return links.select("page_id", F.col("place").cast("long").alias("place"), "href", (~F.col("href").rlike(r"^(#|//|[A-Za-z][A-Za-z0-9+.\-]*:)")).alias("relative"))


_STRIPPED = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "nav"):
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '(?is)<{_tag}(\s[^>]*)?>.*?</{_tag}\s*>', ' ', 'g')"


@query(rf"""
SELECT page_id, length(body)::INTEGER AS n_chars, md5(body) AS digest
FROM (SELECT page_id, trim(regexp_replace(regexp_replace({_STRIPPED}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages)""")
def html_noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "pages").select("page_id", H.strip_noise(F.col("html")).alias("body"))
    return body.select("page_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query_part FROM pages""")
def html_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", guard.host(F.col("url")).alias("host"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("")).alias("query_part"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_markdown(F.col("html")).alias("markdown"))


@query("""
SELECT doc_id AS id, what, number, replace(a, '#', doc_id::VARCHAR) AS a, replace(b, '#', doc_id::VARCHAR) AS b, replace(replace(label, '#', doc_id::VARCHAR), '@', lang) AS label, "group" FROM documents, (VALUES
  (0, 'edge', 0, 'A#', 'B', '', ''), (0, 'edge', 1, 'B', 'C', '@', ''), (0, 'edge', 2, 'C', 'D', '', ''),
  (0, 'node', 0, 'A#', 'rect', 'Start #', ''), (0, 'node', 1, 'B', 'diamond', 'Choice', ''), (0, 'node', 2, 'C', 'circle', 'End', 'S'), (0, 'node', 3, 'D', 'cylinder', 'Store', 'S'),
  (1, 'edge', 0, 'X', 'Y#', 'some text', ''), (1, 'node', 0, 'X', 'rect', 'X', ''), (1, 'node', 1, 'Y#', 'rect', 'Y#', '')) v(k, what, number, a, b, label, "group") WHERE doc_id % 3 = k""")
def mermaid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow chart for each document: shapes, labels and groups; every third is a sequence diagram, which has no graph."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    shapes = F.concat(F.lit("graph TD\nA"), i, F.lit("[Start "), i, F.lit("] --> B{Choice}\nB -->|"), "lang", F.lit("| C((End))\nsubgraph S\nC --> D[(Store)]\nend"))
    plain = F.concat(F.lit("flowchart LR\nX -- some text --> Y"), i)
    charts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, shapes).when(k == 1, plain).otherwise("sequenceDiagram\nA->>B: hi").alias("source"))
    return diagrams.mermaid_graph(charts).withColumn("number", F.col("number").cast("int"))


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing for each document: two boxes, a line between them and texts; every fourth is no XML."""
    label = F.concat(F.lit("Client "), F.col("doc_id").cast("string"))
    drawn = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><rect id="a" x="0" y="0" width="40" height="20"/><text x="20" y="10">'), label, F.lit('</text><rect id="b" x="200" y="0" width="40" height="20"/><text x="220" y="12">'), "source", F.lit('</text><line x1="40" y1="10" x2="200" y2="10"/><text x="120" y="5">call</text></svg>'))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 3, "no xml").otherwise(drawn).alias("source"))


@query("""SELECT doc_id AS id, 'a' AS a, 'b' AS b, 'call' AS label FROM documents WHERE doc_id % 4 <> 3""")
def svg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.svg_graph(_drawings(spark, sf_dir))[1]


@query("""SELECT doc_id AS id, name, 'rect' AS shape, CASE name WHEN 'a' THEN 'Client ' || doc_id ELSE source END AS label FROM documents, (VALUES ('a'), ('b')) v(name) WHERE doc_id % 4 <> 3""")
def svg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.svg_graph(_drawings(spark, sf_dir))[0]
