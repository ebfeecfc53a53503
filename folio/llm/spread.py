"""Joins on keys that may hold any share of the rows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import cut

#: A key is hot if it has over LEAST_HOT rows and over one row in MOST_HOT / 2, so at most MOST_HOT keys are.
LEAST_HOT, MOST_HOT = 256, 1_000_000


def with_hot(rows: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``known`` (the key or keys, n: its rows). Keys that may have a large share of ``rows`` go to where the rows are: at most MOST_HOT
    of them, as many as the sum of all n lets be that large."""
    most = 2 * (known.agg(F.sum("n")).first()[0] or 0) // MOST_HOT
    is_hot = F.col("n") > max(LEAST_HOT, most)
    hot = cut(known.where(is_hot), "hottest")
    if hot.isEmpty():
        return rows.join(known.hint("merge"), key)
    cold = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(known.where(~is_hot).hint("merge"), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row for each key, where a key may hold any share of ``rows``.

    Keys that are hot go to where the rows are: at most MOST_HOT of them, however many rows there are. Other keys have at most
    max(LEAST_HOT, 2 * rows / MOST_HOT) rows in one task. ``rows`` is read twice, so it should be a written table."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = rows.count()
    hot = cut(counts.where(F.col("__n") > max(LEAST_HOT, 2 * total // MOST_HOT)).drop("__n").join(one, keys), "hot-keys")
    if hot.isEmpty():
        return rows.join(one, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)
