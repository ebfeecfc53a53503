"""Fusing dense and sparse hits, structural boosts, parents, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import IMAGE_INTENT, structural_form, tokens
from folio.operators.bm25 import top_k

# Weights of the parts and of the boosts.
DENSE_WEIGHT = 0.7
TITLE_PART, HEADING_PART, DIR_PART = 0.6, 0.3, 0.1
BOOST_OVER, BOOST, TITLE_BONUS, IMAGE_BOOST = 0.5, 0.25, 0.15, 1.15


def fuse(dense: DataFrame, sparse: DataFrame, weight: float = DENSE_WEIGHT, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, dense, sparse, score): every hit of either side, the missing side counting 0."""
    both = dense.select(*keys, "dense").join(sparse.select(*keys, "sparse"), list(keys), "full_outer").fillna(0.0, ["dense", "sparse"])
    return both.withColumn("score", weight * F.col("dense") + (1 - weight) * F.col("sparse"))


def prepared(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds what the scores of hits need of a query, so that its text is looked at once and not once for each hit: ``asked_tokens`` (distinct), ``asked_form``, ``asks_image``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return queries.withColumns({"asked_tokens": F.array_distinct(tokens(whole)), "asked_form": structural_form(whole), "asks_image": whole.rlike(IMAGE_INTENT)})


def structural_score(asked_tokens: Column, title: Column, heading_path: Column, directory: Column) -> Column:
    """How much of the query's distinct tokens the title, headings and directory hold; at most 1."""
    share = lambda field: F.size(F.array_intersect(asked_tokens, tokens(F.coalesce(field, F.lit(""))))) / F.size(asked_tokens)
    total = TITLE_PART * share(title) + HEADING_PART * share(heading_path) + DIR_PART * share(directory)
    return F.when(F.size(asked_tokens) > 0, F.least(F.lit(1.0), total)).otherwise(0.0)


def title_hit(asked_form: Column, title: Column) -> Column:
    """The query holds the whole title, both in structural form."""
    form = structural_form(title)
    return F.coalesce((F.length(title) > 1) & (form != "") & F.contains(asked_form, form), F.lit(False))


def boosted(score: Column, structural: Column, hit: Column, asks_image: Column | None = None, kind: Column | None = None) -> Column:
    out = score + F.when(structural > BOOST_OVER, BOOST * structural).otherwise(0.0) + F.when(hit, TITLE_BONUS).otherwise(0.0)
    if asks_image is None or kind is None:
        return out
    return out * F.when(asks_image & (kind == "image"), IMAGE_BOOST).otherwise(1.0)


def collapse_parents(hits: DataFrame, parents: DataFrame, group: str | None = None) -> DataFrame:
    """The best child of each parent, with the parent's content where the parent is known; children without a parent stay."""
    keys = [F.coalesce("parent_id", F.concat(F.lit("id:"), F.col("id").cast("string")))] + ([F.col(group)] if group else [])
    best = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where("__n = 1").drop("__n")
    found = best.join(parents.select("parent_id", F.col("content").alias("__parent")), "parent_id", "left")
    return found.withColumn("content", F.coalesce("__parent", "content")).drop("__parent")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], query: Column, k: int, group: str | None = "query") -> DataFrame:
    """The k best by the scorer's value, which replaces ``score``; dense and sparse stay."""
    return top_k(hits.withColumn("score", scorer(query, F.col("content"))), k, group=group)


def overlap_scorer(asked_tokens: Column, content: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's distinct tokens that the content holds."""
    return F.when(F.size(asked_tokens) > 0, F.size(F.array_intersect(asked_tokens, tokens(content))) / F.size(asked_tokens)).otherwise(0.0)


def pin_visual(ranked: DataFrame, k: int, visual: Column, intent: Column) -> DataFrame:
    """The first k by rank; where the query asks for an image and none of them is visual, the best visual hit takes the last place."""
    marked = ranked.withColumn("__visual", visual).withColumn("__intent", intent)
    shown = F.sum(F.when(F.col("rank") <= k, F.col("__visual").cast("int")).otherwise(0)).over(Window.partitionBy("query"))
    best = F.row_number().over(Window.partitionBy("query", "__visual").orderBy("rank"))
    total = F.count("*").over(Window.partitionBy("query"))
    marked = marked.withColumn("__shown", shown).withColumn("__best", best).withColumn("__total", F.least(total, F.lit(k)))
    pin = F.col("__intent") & (F.col("__shown") == 0)
    chosen = marked.withColumn("__pinned", pin & F.col("__visual") & (F.col("__best") == 1))
    any_pin = F.max(F.col("__pinned").cast("int")).over(Window.partitionBy("query"))
    chosen = chosen.withColumn("__any", any_pin).where(F.col("__pinned") | (F.col("rank") <= F.col("__total") - F.col("__any")))
    return chosen.withColumn("rank", F.when(F.col("__pinned"), F.col("__total")).otherwise(F.col("rank"))).drop("__visual", "__intent", "__shown", "__best", "__total", "__pinned", "__any")
