"""Ranking metrics, text metrics and roll-ups of evaluation runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ranking_metrics(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (3, 5, 10), query: str = "query", item: str = "item", by_shown: bool = False) -> DataFrame:
    """(query, mrr, and recall, precision and ndcg at each k) of every query that either side has.

    ranked: query, item, rank from 1. gold: query, item. An item counts at its first rank. Without gold and without results recall
    is 1; without gold but with results, or the other way round, 0. Precision divides by k, or ``by_shown`` by how many of the first k there are, one at least."""
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    first = ranked.groupBy(query, item).agg(F.min("rank").alias("rank"))
    right = gold.select(query, item).distinct().withColumn("hit", F.lit(1))
    n_gold = right.groupBy(query).agg(F.count("*").alias("n_gold"))
    n_seen = first.groupBy(query).agg(F.count("*").alias("n_seen"))
    hits = first.join(right, [query, item], "inner")
    columns = [F.max(1 / F.col("rank")).alias("mrr")]
    for k in ks:
        inside = F.col("rank") <= k
        columns += [F.sum(inside.cast("int")).alias(f"hits_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    found = n_gold.join(n_seen, query, "full_outer").join(hits.groupBy(query).agg(*columns), query, "left").fillna(0)
    empty = F.when(F.col("n_gold") == 0, F.when(F.col("n_seen") == 0, 1.0).otherwise(0.0))
    out = [F.col(query), F.col("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out += [F.coalesce(empty, F.col(f"hits_{k}") / F.col("n_gold")).alias(f"recall_{k}"), (F.col(f"hits_{k}") / (F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_seen"))) if by_shown else k)).alias(f"precision_{k}"), F.coalesce(empty, F.col(f"dcg_{k}") / ideal).alias(f"ndcg_{k}")]
    return found.select(*out)


def normal_words(text: Column) -> Column:
    """Lower case, marks as spaces, split on white space."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_remove(F.split(plain, r"\s+"), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if either side has none."""
    return shared_words(normal_words(a), normal_words(b))


def shared_words(x: Column, y: Column) -> Column:
    """The same for lists of words."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def bleu(pairs: DataFrame, n: int, key: str = "pair", candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """(key, bleu): clipped n-gram matches over *distinct* candidate n-grams, times the brevity penalty. Grams are counted within a pair's row; none is shuffled."""

    @F.pandas_udf("kinds long, clipped long")
    def matched(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        counts = [_matches(a.split(), b.split(), n) for a, b in zip(c, r, strict=True)]
        return pd.DataFrame({"kinds": [k for k, _ in counts], "clipped": [m for _, m in counts]}, dtype=np.int64)

    words = pairs.select(key, normal_words(F.col(candidate)).alias("c"), normal_words(F.col(reference)).alias("r"))
    found = words.select(key, F.size("c").alias("n_c"), F.size("r").alias("n_r"), matched(F.array_join("c", " "), F.array_join("r", " ")).alias("m"))
    penalty = F.when(F.col("n_c") > F.col("n_r"), 1.0).otherwise(F.exp(1 - F.col("n_r") / F.col("n_c")))
    return found.select(key, F.when(F.col("m.kinds") > 0, penalty * F.col("m.clipped") / F.col("m.kinds")).otherwise(0.0).alias("bleu"))


def _matches(candidate: list[str], reference: list[str], n: int) -> tuple[int, int]:
    """(distinct n-grams of the candidate, how many of them the reference has, each as often as both have it)."""
    grams = lambda words: Counter(zip(*(words[i:] for i in range(n)), strict=False))
    c = grams(candidate)
    return len(c), (c & grams(reference)).total()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of the longer text; a step for each character of the other that it has."""
    if len(a) < len(b):
        a, b = b, a
    masks = _places(a, set(a) & set(b))
    hits = [masks[c] for c in b if c in masks]
    full = row = (1 << len(a)) - 1
    for at in range(0, len(hits), 64):  # carries beyond the text go after each 64 steps
        for mask in hits[at : at + 64]:
            hit = row & mask
            row = row + hit | row ^ hit
        row &= full
    return len(a) - row.bit_count()


def _places(text: str, wanted: set[str]) -> dict[str, int]:
    """For each of the ``wanted`` characters, which all occur, a number whose bits are its places; a bit at a time would cost the square of a text's length."""
    if not wanted:
        return {}
    coded = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    order = np.argsort(coded, kind="stable")
    kinds, first = np.unique(coded[order], return_index=True)
    marked = np.zeros(len(coded), np.uint8)
    out = {}
    for code, places in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
        if chr(code) in wanted:
            marked[places] = 1
            out[chr(code)] = int.from_bytes(np.packbits(marked, bitorder="little").tobytes(), "little")
            marked[places] = 0
    return out


@F.pandas_udf(DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of characters; two empty texts are alike, one empty text isn't like another."""

    def one(a: str, b: str) -> float:
        if not a or not b:
            return float(not a and not b)
        return 2 * common_subsequence(a, b) / (len(a) + len(b))

    return pd.Series([one(a or "", b or "") for a, b in zip(candidate, reference, strict=True)], dtype=np.float64)


def rollup(records: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """(group, metric, mean, n): means over values that aren't null, rounded to four places; null where there are none."""
    stacked = records.select(*group, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    return stacked.groupBy(*group, "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


def best_arm(means: DataFrame, lower_is_better: tuple[str, ...] = (), arm: str = "arm") -> DataFrame:
    """(metric, best): the arm with the best mean by the metric's direction; null where all arms are alike."""
    signed = F.when(F.col("metric").isin(list(lower_is_better) or [""]), -F.col("mean")).otherwise(F.col("mean"))
    best = F.min_by(arm, F.struct(-signed, F.col(arm)))
    return means.where("mean is not null").groupBy("metric").agg(F.when(F.countDistinct("mean") >= 2, best).alias("best"))


def token_meter(calls: DataFrame, group: str) -> DataFrame:
    """(group, calls, prompt, completion, total, hit_rate): sums, and cache reads over prompt tokens to four places."""
    sums = calls.groupBy(group).agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cache_read").alias("cache_read"))
    rate = F.when(F.col("prompt") > 0, F.round(F.col("cache_read") / F.col("prompt"), 4)).otherwise(0.0)
    return sums.select(group, "calls", "prompt", "completion", (F.col("prompt") + F.col("completion")).alias("total"), rate.alias("hit_rate"))


def normal_usage(usage: Column) -> Column:
    """struct<prompt, completion, cache_read> of a usage JSON in any of three vendors' layouts."""
    first = lambda *paths: F.coalesce(*(F.get_json_object(usage, p).cast("long") for p in paths), F.lit(0).cast("long"))
    return F.struct(
        first("$.input_tokens", "$.prompt_tokens").alias("prompt"),
        first("$.output_tokens", "$.completion_tokens").alias("completion"),
        first("$.input_token_details.cache_read", "$.prompt_tokens_details.cached_tokens", "$.prompt_cache_hit_tokens").alias("cache_read"),
    )


def trajectory(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, n_tool_calls, n_verdicts, route): events (run, seq, type, verdict) as one record a run."""
    found = events.groupBy(run).agg(F.count_if(F.col("type") == "tool_call").alias("n_tool_calls"), F.count_if(F.col("type") == "judge").alias("n_verdicts"))
    return found.withColumn("route", F.when(F.col("n_tool_calls") > 0, "search").otherwise("chat"))


def stage_times(timings: DataFrame, stages: dict[str, str], run: str = "run_id") -> DataFrame:
    """(run, stage, ms): nodes' times summed by stage, missing stages 0, to one place. Times are summed as decimals of nine places, so that the order of rows
    never decides how a half is rounded; where one is no such number (NaN, infinite, over 10^19), as doubles."""
    of = F.create_map(*[F.lit(x) for pair in stages.items() for x in pair])
    names = sorted(set(stages.values()))

    def total(name: str) -> Column:
        ms = F.when(F.col("stage") == name, F.col("ms").cast("double"))
        exact = ms.try_cast("decimal(28,9)")
        return F.coalesce(F.when(F.count(exact) == F.count(ms), F.round(F.sum(exact), 1).cast("double")).otherwise(F.round(F.sum(ms), 1)), F.lit(0.0)).alias(name)

    wide = timings.withColumn("stage", of[F.col("node")]).groupBy(run).agg(*map(total, names))
    return wide.select(run, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("stage", "ms"))


def run_report(runs: DataFrame, group: str, ok: Column, latency: Column) -> DataFrame:
    """(group, n, n_ok, ok_rate, latency): how many runs succeeded, and the mean latency of those that did, to four places; null where none did."""
    counted = runs.groupBy(group).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(F.when(ok, latency)), 4).alias("latency"))
    return counted.select(group, "n", "n_ok", F.round(F.col("n_ok") / F.col("n"), 4).alias("ok_rate"), "latency")


def unanswered(records: DataFrame, answer: str = "answer") -> DataFrame:
    """Records without an answer: a run that has any is not to be compared with others."""
    return records.where(F.trim(F.coalesce(answer, F.lit(""))) == "")
