"""The link graph of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.functions import html as H
from folio.operators import graph
from folio.storage import cut

_SQL_TITLE = "coalesce({}, {})".format(*(rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')" for tag in ("title", "h1")))
_GRAPH = rf"""
links AS (SELECT DISTINCT 'p' || page_id || '.html' AS src, ltrim(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["'']', 1)), '/') AS link FROM pages),
titled AS MATERIALIZED (SELECT 'p' || page_id || '.html' AS dst, {_SQL_TITLE} AS title FROM pages),
names AS (SELECT key, arg_min(dst, (level, dst)) AS dst FROM (
  SELECT lower(title) AS key, 1 AS level, dst FROM titled UNION ALL SELECT lower(replace(dst, '.html', '')), 2, dst FROM titled
  UNION ALL SELECT lower(unnest(list_filter(str_split(title, ' '), lambda x: x <> ''))), 3, dst FROM titled) WHERE key IS NOT NULL GROUP BY key),
edges AS MATERIALIZED (SELECT DISTINCT src, coalesce(dst, '[[' || link || ']]') AS dst, dst IS NULL AS is_stub FROM links LEFT JOIN names ON key = lower(trim(link)) WHERE src <> coalesce(dst, '[[' || link || ']]'))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by the rules of notes: a link is another page's title, its name, or a word of its title."""
    html = F.col("html")
    name = F.concat(F.lit("p"), "page_id", F.lit(".html"))
    pages = table(spark, sf_dir, "pages").select(name.alias("filepath"), H.title(html, F.col("url")).alias("title"), F.transform(H.hrefs(html), lambda x: F.ltrim(x, F.lit("/"))).alias("wikilinks"))
    return graph.resolve_links(pages.withColumn("aliases", F.array_remove(F.split("title", " "), "")))


@query(f"WITH {_GRAPH} SELECT src, dst, is_stub FROM edges")
def edges_resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"""WITH {_GRAPH} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree
FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@query(f"""WITH {_GRAPH}, d AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY src)
SELECT (SELECT count(DISTINCT node) FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges)) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, node, n AS out_degree, rank
FROM (SELECT *, row_number() OVER (ORDER BY n DESC, node)::INTEGER AS rank FROM d) WHERE rank <= 3""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(_edges(spark, sf_dir))


_SEEDED = f"""{_GRAPH}, e AS (SELECT src, dst FROM edges WHERE NOT is_stub), seeds AS (SELECT 'p' || page_id || '.html' AS seed FROM pages WHERE page_id % 100 = 0)"""


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links between pages, and as seeds the stated query set: pages with a number that 100 divides."""
    seeds = table(spark, sf_dir, "pages").where("page_id % 100 = 0").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("seed"))
    return _edges(spark, sf_dir).where("not is_stub").select("src", "dst"), seeds


@query(f"""WITH {_SEEDED},
h1 AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN e ON src = seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN e ON src = node),
h3 AS (SELECT DISTINCT seed, dst AS node FROM h2 JOIN e ON src = node),
every AS (SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 UNION ALL SELECT seed, node, 3 FROM h3)
SELECT seed, node, min(hop) AS hop, 1 / pow(2.0, min(hop) - 1) AS decay FROM every WHERE node <> seed GROUP BY seed, node""")
def bfs_expand_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, seeds = _seeded(spark, sf_dir)
    return graph.expand(cut(e, "edges"), seeds, 3)


@query(f"""WITH {_SEEDED},
h1 AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN e ON src = seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN e ON src = node),
r AS (SELECT seed, node, 1 / pow(2.0, min(hop) - 1) AS decay FROM (SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) WHERE node <> seed GROUP BY seed, node),
c AS (SELECT 'p' || doc_id // 4 || '.html' AS filepath, doc_id AS chunk_id FROM documents),
f AS (SELECT * FROM r WHERE node IN (SELECT filepath FROM c) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY decay DESC, node) <= 8)
SELECT seed, filepath, chunk_id, round(decay * 0.1, 6) AS score FROM f JOIN c ON node = filepath
QUALIFY row_number() OVER (PARTITION BY seed ORDER BY decay DESC, filepath, chunk_id) <= 24""")
def neighbor_chunks_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, seeds = _seeded(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4), F.lit(".html")).alias("filepath"), F.col("doc_id").alias("chunk_id"))
    return graph.neighbour_chunks(graph.expand(cut(e, "edges"), seeds, 2), chunks).withColumn("score", F.round("score", 6))
