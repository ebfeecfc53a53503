"""From files to searchable tables, whole or incrementally."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import blocks
from folio.functions.splitting import sections, split_parents, split_recursive
from folio.functions.text import prefix
from folio.operators.graph import resolve_links
from folio.operators.state import delete_keys, snapshot_diff


@dataclass
class Tables:
    chunks: DataFrame
    parents: DataFrame
    edges: DataFrame
    files: DataFrame


def build(docs: DataFrame, child_size: int = 800, child_overlap: int = 150, parent_size: int = 2000) -> Tables:
    """Chunks, parents, link edges and file states of documents (filepath, dir, title, tags, aliases, wikilinks, text, mtime, sha256).

    Rich blocks are taken out before a text is split and put back into the chunks; each block and the front matter's tags and aliases
    give chunks of their own. A chunk's id is its file, its place and its class."""
    held = blocks.extract(docs.select("filepath", "dir", "title", "tags", "aliases", "text", "mtime"))
    split = split_parents(sections(held.select("filepath", "text"), "filepath"), "filepath", child_size, child_overlap, parent_size)
    meta = held.select("filepath", "dir", "title", "tags", "mtime", "blocks")
    body = split.join(meta, "filepath")
    content = blocks.restore(F.col("child_body"), F.col("blocks"))
    parent_id = F.concat_ws("::", "filepath", F.lit("parent"), F.col("parent").cast("string"))
    children = body.select(
        "filepath", F.lit("text").alias("chunk_class"), F.struct("parent", "child").alias("__order"), "dir", "title", "tags", "mtime", F.col("child_path").alias("heading_path"), parent_id.alias("parent_id"),
        F.concat_ws("\n\n", F.nullif(prefix(F.col("dir"), F.col("title"), F.col("child_path")), F.lit("")), content).alias("content"),
        *(blocks.has_kind(F.col("child_body"), F.col("blocks"), k).alias(f"has_{k}") for k, _ in blocks.KINDS),
    )
    none = [F.lit(False).alias(f"has_{k}") for k, _ in blocks.KINDS]
    summed = blocks.summaries(held, "filepath").join(meta.drop("blocks"), "filepath").select(
        "filepath", F.lit("extracted_summary").alias("chunk_class"), F.struct(F.col("number").cast("long").alias("parent"), F.lit(0).cast("long").alias("child")).alias("__order"), "dir", "title", "tags", "mtime",
        F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("parent_id"), F.col("summary").alias("content"), *none,
    )
    lines = F.array_compact(F.array(F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "))), F.when(F.size("aliases") > 0, F.concat(F.lit("别名: "), F.array_join("aliases", ", ")))))
    fronts = held.select("*", F.posexplode(lines).alias("n", "line")).select(
        "filepath", F.lit("front_matter").alias("chunk_class"), F.struct(F.col("n").cast("long").alias("parent"), F.lit(0).cast("long").alias("child")).alias("__order"), "dir", "title", "tags", "mtime",
        F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("parent_id"), F.col("line").alias("content"), *none,
    )
    rows = children.unionByName(summed).unionByName(fronts)
    number = F.concat_ws("::", "filepath", F.col("__order.parent").cast("string"), F.col("__order.child").cast("string"), "chunk_class")
    chunks = rows.withColumn("chunk_id", number).drop("__order")
    parents = body.select(parent_id.alias("parent_id"), "filepath", F.col("parent_path").alias("heading_path"), blocks.restore(F.col("parent_body"), F.col("blocks")).alias("content")).dropDuplicates(["parent_id"])
    files = docs.select("filepath", "mtime", "sha256")
    return Tables(chunks, parents, resolve_links(docs.select("filepath", "title", "aliases", "wikilinks")), files)


def flat_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """(doc id, chunk_index, content): recursive chunks without regard to headings."""
    return docs.select(id_col, F.posexplode(split_recursive(F.col(text_col), size, overlap)).alias("chunk_index", "content"))


def window_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """(doc id, chunk_index, content): windows of ``size`` characters that begin every ``size - overlap``."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text_col) - size) / step)).cast("int")
    return docs.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), last)).alias("chunk_index")).select(id_col, "chunk_index", F.substring(F.col(text_col), F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def refresh(old: Tables, docs: DataFrame, **settings: int) -> tuple[Tables, DataFrame]:
    """The tables after new, changed and deleted files, and the changes themselves. Only new and changed files are split again; links are resolved over all documents."""
    changes = snapshot_diff(old.files, docs.select("filepath", "mtime", "sha256"))
    touched = changes.where("change in ('new', 'changed')").select("filepath")
    stale = changes.where("change in ('changed', 'deleted')").select("filepath")
    fresh = build(docs.join(touched, "filepath", "left_semi"), **settings)
    keep = lambda table: delete_keys(table, stale, ["filepath"])
    tables = Tables(
        keep(old.chunks).unionByName(fresh.chunks), keep(old.parents).unionByName(fresh.parents),
        resolve_links(docs.select("filepath", "title", "aliases", "wikilinks")), docs.select("filepath", "mtime", "sha256"),
    )
    return tables, changes
