"""Dense positions in a given order, without one task ever holding a whole key.

A window ``row_number`` over a key sends all rows of that key to one task. Here the order is cut
into levels of coarse buckets: counts per bucket (small, combined on the map side) give every
bucket its offset, and ``row_number`` only runs inside one finest bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 65536


def bucketed_rank(
    df: DataFrame, out: str, by: Sequence[str], levels: Sequence[Column], order: Sequence[Column]
) -> DataFrame:
    """Add ``out`` = 1-based position of the row within ``by``, ordered by levels and then ``order``.

    ``levels`` are order-preserving, ever finer buckets of the sort order, e.g. day, second, first
    digits of the tie key.
    """
    by = list(by)
    names = [f"_lv{i}" for i in range(len(levels))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(levels, names)])
    counts = tagged.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets, total = counts, F.lit(0).cast("long")
    for i, name in enumerate(names):
        outer = by + names[:i]
        level = counts.groupBy(*outer, name).agg(F.sum("_n").alias("_m"))
        run = W.partitionBy(*outer).orderBy(name).rowsBetween(W.unboundedPreceding, -1)
        level = level.select(*outer, name, F.coalesce(F.sum("_m").over(run), F.lit(0)).alias(f"_off{i}"))
        offsets = offsets.join(level, outer + [name])
        total = total + F.col(f"_off{i}")
    offsets = offsets.select(*by, *names, total.alias("_off"))
    inside = W.partitionBy(*by, *names).orderBy(*order)
    ranked = tagged.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, by + names)
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_rn", "_off", *names)
        .select(*df.columns, out)
    )


def spread(df: DataFrame, rows: int, key: str, small: int = 512, large: int = 50_000) -> DataFrame:
    """``rows`` narrow rows dealt out by a key before they grow, as when a list is joined to each.

    Adaptive execution sizes partitions by the bytes of the narrow rows and would leave a few; a given number is
    kept. Up to a few per core they hold at least ``small`` rows, beyond that ``large`` ones.
    """
    few = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows // small, few), rows // large), key)


def time_levels(time_col: str, key_col: str) -> list[Column]:
    """Levels for rows ordered by unix seconds and then by an md5 tie key."""
    return [F.floor(F.col(time_col) / 86400), F.col(time_col), F.substring(key_col, 1, 3)]


def md5_levels(key_col: str, rows: int) -> list[Column]:
    """Levels for ``rows`` rows ordered by an md5 key: about BUCKET_ROWS of them share the finest one."""
    digits = max(3, math.ceil(math.log(max(1, rows) / BUCKET_ROWS, 16)))
    return [F.substring(key_col, 1, d) for d in range(3, digits + 1, 3)] + ([F.substring(key_col, 1, digits)] if digits % 3 else [])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key with their rank; Spark limits each task's share before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
