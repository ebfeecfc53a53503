"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.spread import spread_join
from folio.storage import cut


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links held in one task: (node, smallest node of its component) for every other node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        while (jumped := new[new] != new).any():
            new[jumped] = new[new][jumped]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (a, b) with a > b. Large: a node's larger neighbours move to its smallest one; small: its smaller neighbours and itself do.

    A node may have any share of the edges as neighbours, so its smallest one goes to where they are if they are many."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = spread_join(around, least, ["u"])
    moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't the smallest of its component; root is.

    Each round is written to the shared folder, so that a lost executor costs one round at most. Rounds grow with the
    logarithm of the longest chain; an edge table that has not settled after ``rounds`` raises an error."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = cut(_star(cut(_star(now, True), "edges"), False), "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components have not settled after {rounds} rounds")
