"""Exact order statistics and quantiles per group, over columns of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here the wanted
order statistics are found by narrowing value ranges: each pass is one map-side combined histogram
for all groups and ranks at once, of at most ``BINS`` + 1 rows per range still open.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048


def _bin(value: Column, low, high) -> Column:
    """Number of the part of [low, high] a value lies in; the two ends never share a part."""
    width = float(high) / BINS - float(low) / BINS
    if width <= 0 or math.floor(float(high) / width - float(low) / width) <= 0:  # too close for division
        return (value > F.lit(low)).cast("long")
    return F.floor(value.cast("double") / F.lit(width) - F.lit(float(low) / width)).cast("long")


def order_statistics(df: DataFrame, by: str, col: str, ranks: dict) -> dict:
    """{(group, rank): (value, rows below it, rows equal to it)} for 0-based ranks per group.

    ``ranks`` {group: [rank, ...]}. Nulls do not count; values must be finite. Ranges shrink with every
    pass, as the smallest and largest value of a range fall into different parts.
    """
    groups = list(ranks)
    rows = df.where(F.col(col).isNotNull() & F.col(by).isin(groups)).select(F.col(by).alias("g"), F.col(col).alias("v"))
    top = rows.groupBy("g").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    found: dict = {}
    spans = [(r["g"], r["a"], r["b"], 0, r["n"], sorted(set(ranks[r["g"]]))) for r in top]
    while spans:
        still = []
        for g, a, b, before, n, wanted in spans:
            if a == b:
                found.update({(g, r): (a, before, n) for r in wanted})
            else:
                still.append((g, a, b, before, n, wanted))
        if not still:
            break
        where = [(F.col("g") == g) & (F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b)) for g, a, b, *_ in still]
        span = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(where)])
        part = F.coalesce(*[F.when(w, _bin(F.col("v"), s[1], s[2])) for w, s in zip(where, still, strict=True)])
        hist = rows.select(span.alias("span"), part.alias("bin"), "v").where("span is not null").groupBy("span", "bin")
        hist = hist.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        spans = []
        for i, (g, _, _, before, _, wanted) in enumerate(still):
            seen = before
            for h in sorted((h for h in hist if h["span"] == i), key=lambda h: h["a"]):
                mine = [r for r in wanted if seen <= r < seen + h["n"]]
                if mine:
                    spans.append((g, h["a"], h["b"], seen, h["n"], mine))
                seen += h["n"]
    return found


def exact_quantiles(df: DataFrame, by: str, col: str, probs: Sequence[float]) -> dict:
    """{group: {prob: value}} by linear interpolation between neighbouring order statistics.

    Nulls do not count; a group without values has None. Values are ordered as doubles with NaN above
    Infinity: an order statistic there is that value, and an interpolation with it follows arithmetic.
    """
    value = F.col(col).cast("double")
    kind = F.when(F.isnan(value), 2).when(value == float("inf"), 1).when(value == float("-inf"), -1).otherwise(0)
    rows = df.select(F.col(by).alias("g"), value.alias("v"), F.when(value.isNotNull(), kind).alias("kind"))
    count: dict = {}
    for r in rows.groupBy("g", "kind").agg(F.count(F.lit(1)).alias("n")).collect():
        count.setdefault(r["g"], {})[r["kind"]] = r["n"]
    ends = {-1: -math.inf, 1: math.inf, 2: math.nan}
    ranks, place = {}, {}
    for g, kinds in count.items():
        n = sum(m for k, m in kinds.items() if k is not None)
        place[g] = {p: (n - 1) * p for p in probs} if n else {}
        low, finite = kinds.get(-1, 0), kinds.get(0, 0)
        wanted = {r - low for h in place[g].values() for r in (math.floor(h), math.ceil(h)) if low <= r < low + finite}
        if wanted and g is not None:
            ranks[g] = sorted(wanted)
    at = order_statistics(rows.where("kind = 0"), "g", "v", ranks) if ranks else {}

    def statistic(g, r: int) -> float:
        kinds = count[g]
        for k in (-1, 0, 1, 2):
            m = kinds.get(k, 0)
            if r < m:
                return at[g, r][0] if k == 0 else ends[k]
            r -= m
        raise ValueError("rank beyond the last value")

    out: dict = {}
    for g in count:
        out[g] = {p: None for p in probs}
        for p, h in place[g].items():
            low, high = statistic(g, math.floor(h)), statistic(g, math.ceil(h))
            out[g][p] = low if low == high else low + (high - low) * (h - math.floor(h))
    return out
