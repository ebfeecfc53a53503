"""The link graph: resolving links, degrees, expansion by hops, neighbours' chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import stem
from folio.storage import cut

# Caps of what an expansion adds to an answer's context, and the weight of an added chunk.
MAX_FILES, MAX_CHUNKS, NEIGHBOUR_WEIGHT = 8, 24, 0.1


def resolve_links(notes: DataFrame) -> DataFrame:
    """(src, dst, is_stub) from notes (filepath, title, aliases, wikilinks).

    A link is a title, else a file's stem, else an alias, whatever the case; of several notes the first path. A link to none is the stub
    ``[[link]]``. A note doesn't link to itself, and an edge counts once."""
    by_title = notes.select(F.lower("title").alias("key"), F.lit(1).alias("level"), F.col("filepath").alias("dst"))
    by_stem = notes.select(F.lower(stem(F.col("filepath"))).alias("key"), F.lit(2).alias("level"), F.col("filepath").alias("dst"))
    by_alias = notes.select(F.explode("aliases").alias("key"), F.col("filepath").alias("dst")).select(F.lower("key").alias("key"), F.lit(3).alias("level"), "dst")
    names = by_title.unionByName(by_stem).unionByName(by_alias).groupBy("key").agg(F.min(F.struct("level", "dst")).alias("best")).select("key", F.col("best.dst").alias("dst"))
    links = notes.select(F.col("filepath").alias("src"), F.explode("wikilinks").alias("link")).distinct().withColumn("key", F.lower(F.trim("link")))
    found = links.join(names, "key", "left")
    target = F.coalesce("dst", F.concat(F.lit("[["), F.col("link"), F.lit("]]")))
    return found.select("src", target.alias("target"), F.col("dst").isNull().alias("is_stub")).where("src <> target").distinct().withColumnRenamed("target", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def summary(edges: DataFrame, most: int = 3) -> DataFrame:
    """(n_nodes, n_edges, node, out_degree, rank): the sizes of a graph, beside each of the ``most`` nodes with the most links out."""
    found = cut(degrees(edges), "degrees")
    sizes = found.agg(F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"))
    best = found.where("out_degree > 0").orderBy(F.desc("out_degree"), "node").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("out_degree"), "node"))).crossJoin(F.broadcast(sizes)).select("n_nodes", "n_edges", "node", "out_degree", "rank")  # one row


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, hop, decay): what each seed reaches along edges, at its least hop, with decay 1 / 2 ** (hop - 1).

    One join for each hop; nodes that were reached before are left out of the frontier, so that it grows with the nodes and not with the paths."""
    frontier = seeds.select(F.col("seed"), F.col("seed").alias("node")).distinct()
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        ahead = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, ["seed", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0").withColumn("decay", F.pow(F.lit(2.0), 1 - F.col("hop")))


def neighbour_chunks(reached: DataFrame, chunks: DataFrame, max_files: int = MAX_FILES, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(seed, filepath, chunk_id, score): chunks of the nearest files, at most so many files and chunks a seed; stubs have no chunks."""
    files = reached.join(chunks.select(F.col("filepath").alias("node")).distinct(), "node", "left_semi")
    nth = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("decay"), "node"))
    files = files.withColumn("n", nth).where(F.col("n") <= max_files).drop("n")
    found = files.join(chunks, files.node == chunks.filepath).select("seed", "filepath", "chunk_id", (F.col("decay") * NEIGHBOUR_WEIGHT).alias("score"))
    nth = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "filepath", "chunk_id"))
    return found.withColumn("n", nth).where(F.col("n") <= max_chunks).drop("n")


def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, next): where links of ``nodes`` (node) lead."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).join(nodes.select("node"), "node", "left_semi")


def predecessors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, next): where links to ``nodes`` (node) come from."""
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).join(nodes.select("node"), "node", "left_semi")


def image_neighbours(hits: DataFrame, chunks: DataFrame, budget: int = 6) -> DataFrame:
    """(query, chunk_id): text chunks that stand under the heading of an image that was hit, at most ``budget`` for each query, by id.

    hits: query, chunk_id, kind, heading_path. chunks: chunk_id, kind, heading_path. Chunks that were hit themselves don't count."""
    headings = hits.where("kind = 'image' and heading_path <> ''").select("query", "heading_path").distinct()
    near = headings.join(chunks.where("kind <> 'image'"), "heading_path").join(hits.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti").select("query", "chunk_id").distinct()
    nth = F.row_number().over(Window.partitionBy("query").orderBy("chunk_id"))
    return near.withColumn("n", nth).where(F.col("n") <= budget).drop("n")
