"""Context algebra: deduplication, decay, budgets, coverage, convergence, condensing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import NO_HEADING, PRONOUNS, content_hash, token_count

# Decay for each turn, the most pieces kept, and the confidence of each way of condensing.
DECAY, MAX_PIECES = 0.9, 30
FALLBACK, NO_ANTECEDENT, NO_ENTITY, DISAGREE, COMPETING, AGREE = 0.3, 0.3, 0.7, 0.4, 0.5, 0.9


def dedup(hits: DataFrame, identity: tuple[str, ...] = ("filepath", "heading_path", "kind", "placeholder"), content: str = "content", group: tuple[str, ...] = ()) -> DataFrame:
    """Of hits with one identity, then of hits with one content, the newest stays, then the best score, then the least id."""
    best = (F.desc_nulls_last("mtime"), F.desc("score"), F.asc("id"))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]
    for by in (keys, [content_hash(F.coalesce(F.col(content), F.lit("")))]):
        hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*group, *by).orderBy(*best))).where("__n = 1").drop("__n")
    return hits


def decayed(score: Column, turns: Column) -> Column:
    return score * F.pow(F.lit(DECAY), turns)


def within_budget(rows: DataFrame, budget: int, order: list[Column], group: tuple[str, ...] = (), tokens: Column | None = None, most: int | None = None, content: str = "content") -> DataFrame:
    """The longest beginning of each group, in ``order``, whose tokens fit the budget; the first row always stays. Adds ``used``.

    A row costs a token at least unless ``tokens`` says otherwise, so no more than ``budget`` rows of a group can stay: their bound on the row
    number takes effect in each task before the shuffle, and no task sorts a whole group."""
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*order)
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = token_count(F.col(content)) if tokens is None else tokens
    first = min([x for x in (most, max(1, budget) if tokens is None else None) if x], default=None)
    rows = rows.withColumn("__n", F.row_number().over(over))
    out = (rows.where(F.col("__n") <= first) if first else rows).withColumn("used", F.sum(cost).over(upto))
    return out.where((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def total_budget(pieces: DataFrame, history: DataFrame, budget: int, session: str) -> tuple[DataFrame, DataFrame]:
    """History keeps what the pieces leave of the budget: pieces go first, the best ones, then the newest turns."""
    kept = within_budget(pieces, budget, [F.desc("score"), F.asc("id")], (session,), most=MAX_PIECES)
    spent = kept.groupBy(session).agg(F.max("used").alias("spent"))
    over = Window.partitionBy(session).orderBy(F.desc("turn"))
    cost = F.sum(token_count(F.col("content"))).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    newest = history.withColumn("__n", F.row_number().over(over)).where(F.col("__n") <= max(1, budget))  # a turn costs a token at least
    turns = newest.withColumn("used", cost).join(spent, session, "left")
    turns = turns.where((F.col("used") + F.coalesce("spent", F.lit(0)) <= budget) | (F.col("__n") == 1)).drop("__n", "spent")
    return kept, turns


def last_turns(turns: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    over = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("__n", F.row_number().over(over)).where(F.col("__n") <= n).drop("__n")


def similar_turns(turns: DataFrame, similarity: str, least: float = 0.3, session: str = "conv_id") -> DataFrame:
    """Turns at least so similar to the question; all of a session's turns where none is."""
    passing = F.sum((F.col(similarity) >= least).cast("int")).over(Window.partitionBy(session))
    return turns.withColumn("__p", passing).where((F.col(similarity) >= least) | (F.col("__p") == 0)).drop("__p")


def last_heading(path: Column) -> Column:
    return F.trim(F.element_at(F.split(path, ">"), -1))


def topic_margin(hits: DataFrame, group: str) -> DataFrame:
    """(group, top, margin): (best - second) / best over topics, a topic's score being its best hit's; 1 for a single topic or a best that isn't positive."""
    known = hits.where((F.coalesce("heading_path", F.lit("")) != "") & (F.col("heading_path") != NO_HEADING)).withColumn("topic", last_heading(F.col("heading_path"))).where("topic <> ''")
    topics = known.groupBy(group, "topic").agg(F.max("score").alias("score"))
    over = Window.partitionBy(group).orderBy(F.desc("score"), "topic")
    ranked = topics.withColumn("second", F.lead("score").over(over)).withColumn("n", F.row_number().over(over)).where("n = 1")
    margin = F.when(F.col("second").isNotNull() & (F.col("score") > 0), (F.col("score") - F.col("second")) / F.col("score")).otherwise(1.0)
    return ranked.select(group, F.col("topic").alias("top"), margin.alias("margin"))


def condense_confidence(method: Column, entity: Column, condensed: Column, margin: Column, competing_under: float = 0.2) -> Column:
    """How far a condensed question can be trusted: two independent ways that agree, disagree, or compete."""
    return (
        F.when(method == "fallback", FALLBACK)
        .when(F.coalesce(entity, F.lit("")) == "", NO_ENTITY)
        .when(~F.contains(F.coalesce(condensed, F.lit("")), entity), DISAGREE)
        .when(margin < competing_under, COMPETING)
        .otherwise(AGREE)
    )


def fallback_query(current: Column, previous: Column, entity: Column) -> Column:
    """The question with its first pronoun replaced by the entity, after the last question as context."""
    before = F.regexp_extract(current, rf"(?s)^(.*?){PRONOUNS}", 1)
    behind = F.regexp_extract(current, rf"(?s)^.*?{PRONOUNS}(.*)$", 2)
    resolved = F.when((F.coalesce(entity, F.lit("")) != "") & current.rlike(PRONOUNS), F.concat(before, entity, behind)).otherwise(current)
    asked = F.left(F.trim(F.coalesce(previous, F.lit(""))), F.lit(200))
    return F.when(asked != "", F.concat(F.lit("参考上下文："), asked, F.lit("\n当前问题："), resolved)).otherwise(resolved)


def headings_by_title(hits: DataFrame, group: str) -> DataFrame:
    """(group, title, headings): each title's distinct headings in the order in which they first appear by rank."""
    firsts = hits.groupBy(group, "title", "heading_path").agg(F.min("rank").alias("first"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "heading_path"))), lambda x: x["heading_path"]), "；")
    return firsts.groupBy(group, "title").agg(listed.alias("headings"))


def uncovered(all_headings: DataFrame, shown: DataFrame) -> DataFrame:
    return all_headings.subtract(shown)


def stale_streak(rounds: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``streak``: how many rounds up to this one have brought nothing new, a round being new when its value is over all before."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = (F.col(value) > F.coalesce(F.max(value).over(before), F.lit(0))).cast("int")
    marked = rounds.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(upto))
    inside = Window.partitionBy(group, "__island").orderBy(order)
    return marked.withColumn("streak", F.row_number().over(inside) - F.when(F.col("__island") > 0, 1).otherwise(0)).drop("__fresh", "__island")
