"""Splitting documents into sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, table
from folio.functions.splitting import parents_by_text, sections
from folio.plans.index_build import flat_chunks, window_chunks


def _headed(docs: DataFrame) -> DataFrame:
    """Documents as notes: short lines without a full stop inside become second-level headings."""
    line = F.transform(F.split("text", "\n"), lambda x: F.when((F.length(x) <= 25) & (F.trim(x) != ""), F.concat(F.lit("## "), F.trim(x))).otherwise(x))
    return docs.select("doc_id", F.array_join(line, "\n").alias("text"))


@query(r"""
WITH l AS (
  SELECT doc_id, n, CASE WHEN length(x) <= 25 AND trim(x) <> '' THEN trim(x) END AS heading, x
  FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS x, generate_subscripts(str_split(text, chr(10)), 1) AS n FROM documents)
),
s AS (SELECT *, sum((heading IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l),
h AS (SELECT doc_id, section, max(heading) AS heading_path, string_agg(CASE WHEN heading IS NULL THEN x END, chr(10) ORDER BY n) AS body FROM s GROUP BY doc_id, section)
SELECT doc_id, section::BIGINT AS section, coalesce(heading_path, '无标题') AS heading_path, length(regexp_replace(body, '^\s+|\s+$', '', 'g'))::INTEGER AS n_chars
FROM h WHERE regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''""")
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections(_headed(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "section", "heading_path", F.length("body").alias("n_chars"))


@query(r"""
SELECT doc_id, i::INTEGER AS chunk_index, md5(substring(text, i * 650 + 1, 800)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 800) / 650.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query()
def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_chunks(table(spark, sf_dir, "documents"))


@query()
def split_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parents_by_text(_headed(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "parent", "parent_path", "child", "child_path", F.length("child_body").alias("n_chars"))
