"""Expressions and aggregates over ARRAY columns holding vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: Column, eps: float = 1e-12) -> Column:
    """x / max(|x|, eps). The norm is bound once, outside the loop over the elements."""
    bound = F.array(F.greatest(norm(vec), F.lit(eps)))
    return F.transform(bound, lambda n: F.transform(vec, lambda x: x / n))[0]


def blend(q: Column, u: Column, alpha: Column) -> Column:
    """normalize(alpha * q + (1 - alpha) * u)."""
    weights = F.array(alpha)
    mixed = F.transform(weights, lambda a: F.zip_with(q, u, lambda x, y: a * x + (F.lit(1.0) - a) * y))[0]
    return l2_normalize(mixed)


def vector_dim(df: DataFrame, vec: str) -> int:
    """The one dimension of a vector column; 0 without vectors. Vectors of several lengths are an error."""
    size = F.size(F.col(vec))
    row = df.where(F.col(vec).isNotNull()).agg(F.min(size).alias("low"), F.max(size).alias("high")).collect()[0]
    if row["low"] != row["high"]:
        raise ValueError(f"vectors of {row['low']} to {row['high']} elements in one column")
    return row["low"] or 0


def sum_vectors(df: DataFrame, keys: Sequence[str], vec: str, out: str, weight: Column | None = None, mean: bool = False) -> DataFrame:
    """Element-wise (weighted) sum or mean per key, of any length of vectors.

    One vector aggregate: partial sums are combined on the map side, so a key that holds a large share of the rows
    sends one row per task; no row is exploded, and the plan does not grow with the dimension. Null vectors add
    nothing, a key without any gets none. The mean divides by the number of vectors, whatever their weights.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = as_double(F.col(vec))
    if weight is not None:
        x = F.transform(F.array(weight), lambda w: F.transform(as_double(F.col(vec)), lambda e: e * w))[0]
    rows = df.where(F.col(vec).isNotNull()).select(*keys, array_to_vector(x).alias("_v"))
    total = (Summarizer.mean if mean else Summarizer.sum)(F.col("_v"))
    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0).alias("_all"))
    return grouped.agg(total.alias("_t")).select(*keys, vector_to_array("_t").alias(out))
