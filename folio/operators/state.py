"""Keyed state as tables: upserts, runs and events, turns and summaries, the semantic cache, file snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.vectors import cosine

# Seconds after which a run counts as orphaned and a cache entry as old; the likeness that a cache hit needs.
ORPHAN_AFTER, CACHE_TTL, CACHE_LIKENESS, CACHE_ENTRIES = 600, 3600, 0.92, 1000


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of the same key; null keys are keys like any other. ``changes`` has one row a key."""
    on = [table[k].eqNullSafe(changes[k]) for k in keys]
    return table.join(changes, on, "left_anti").unionByName(changes)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key the table doesn't have."""
    return table.unionByName(rows.join(table, keys, "left_anti"))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "filepath") -> DataFrame:
    """(key, change): new, changed, unchanged or deleted, from two snapshots (key, mtime, sha256).

    Another time of change is enough for ``changed``; with the same time the hash decides."""
    a, b = old.select(key, F.col("mtime").alias("m0"), F.col("sha256").alias("h0"), F.lit(True).alias("__old")), new.select(key, F.col("mtime").alias("m1"), F.col("sha256").alias("h1"), F.lit(True).alias("__new"))
    same = F.col("m0").eqNullSafe(F.col("m1")) & F.col("h0").eqNullSafe(F.col("h1"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def run_status(events: DataFrame, now: Column, run: str = "run_id", at: str = "at", kind: str = "kind") -> DataFrame:
    """(run, status, n_events, seconds): finished if it has an answer, interrupted if it has been silent too long, else running."""
    found = events.groupBy(run).agg(F.count("*").alias("n_events"), F.min(at).alias("first"), F.max(at).alias("last"), F.max((F.col(kind) == "answer").cast("int")).alias("answered"))
    status = F.when(F.col("answered") == 1, "finished").when(now - F.col("last") > ORPHAN_AFTER, "interrupted").otherwise("running")
    return found.select(run, status.alias("status"), "n_events", (F.col("last") - F.col("first")).alias("seconds"))


def replay(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Each run's events once, with their place in the order of ``seq``."""
    once = latest(events, [run, seq], [F.desc("at")])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(seq)))


def latest_summary(summaries: DataFrame, session: str = "session_id") -> DataFrame:
    return latest(summaries, [session], [F.desc("idx_to"), F.desc("idx_from")])


def beyond_cap(turns: DataFrame, cap: int, session: str, order: str) -> DataFrame:
    """The oldest rows of sessions over the cap: what a trim deletes."""
    over = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("__n", F.row_number().over(over)).where(F.col("__n") > cap).drop("__n")


def rolling_summary(turns: DataFrame, cost: Column, budget: int = 3000, keep: int = 6, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, idx_from, idx_to, n): the turns that a summary takes in, all but the last ``keep`` of sessions whose turns cost over the budget."""
    whole = Window.partitionBy(session)
    marked = turns.withColumn("__cost", F.sum(cost).over(whole)).withColumn("__n", F.row_number().over(whole.orderBy(F.desc(order))))
    return marked.where((F.col("__cost") >= budget) & (F.col("__n") > keep)).groupBy(session).agg(F.min(order).alias("idx_from"), F.max(order).alias("idx_to"), F.count("*").alias("n"))


def cache_lookup(asked: DataFrame, entries: DataFrame, likeness: float = CACHE_LIKENESS, ttl: float = CACHE_TTL) -> DataFrame:
    """(ask_id, entry_id, similarity): of each question the most similar entry of its context that is young enough and similar enough; ties by id.

    asked: ask_id, ctx_key, embedding, at. entries: entry_id, ctx_key, embedding, ts. Times are dealt in buckets as long as the time to live, so
    a question only meets its context's entries of its own bucket and the one before, and a busy context is spread over its buckets."""
    bucket = lambda at: F.floor(at / F.lit(ttl))
    asked = asked.withColumn("__bucket", F.explode(F.array(bucket(F.col("at")), bucket(F.col("at")) - 1)))
    entries = entries.withColumn("__bucket", bucket(F.col("ts")))
    same = (F.col("a.ctx_key") == F.col("e.ctx_key")) & (F.col("a.__bucket") == F.col("e.__bucket"))
    pairs = asked.alias("a").join(entries.alias("e"), same & (F.col("e.ts") <= F.col("a.at")) & (F.col("a.at") - F.col("e.ts") <= ttl))
    scored = pairs.select("a.ask_id", "e.entry_id", cosine(F.col("a.embedding"), F.col("e.embedding")).alias("similarity")).where(F.col("similarity") >= likeness)
    return scored.groupBy("ask_id").agg(F.min_by(F.struct("entry_id", "similarity"), F.struct(-F.col("similarity"), F.col("entry_id"))).alias("b")).select("ask_id", "b.entry_id", "b.similarity")


def cache_stats(asked: DataFrame, found: DataFrame, group: str = "ctx_key") -> DataFrame:
    """(group, hits, misses, hit_rate) of questions (group, ask_id) and what ``cache_lookup`` found for them."""
    joined = asked.select(group, "ask_id").join(found.select("ask_id", F.lit(1).alias("hit")), "ask_id", "left")
    counted = joined.groupBy(group).agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return counted.withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 4))
