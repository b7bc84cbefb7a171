"""Connected components of a link table, by alternating star contractions as joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    pulled = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return pulled.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its smallest node.

    Nodes without a link are not in the result. Loops, repeated and reversed links are allowed; a link with
    a null end is none. Each round is a stored table, so a lost executor costs a re-read, not the rounds.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
        edges = materialize(_stars(edges), "links")
    raise RuntimeError("components did not settle")


def star_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n local rows linked by (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label
