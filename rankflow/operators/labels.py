"""Labels, activity filters, time split and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankflow.functions.quantiles import order_statistics

# Label codes.
POSITIVE, NEGATIVE, NEUTRAL = 1, 0, -1

COPIES_PER_TASK = 1_000_000


def assign_labels(
    df: DataFrame, positive_threshold: float = 4, negative_threshold: float = 2, keep_neutral: bool = False
) -> DataFrame:
    """B1: score >= positive -> 1, <= negative -> 0, otherwise neutral (dropped unless kept)."""
    if negative_threshold >= positive_threshold:
        raise ValueError("negative_threshold must be below positive_threshold")
    label = (
        F.when(F.col("score") >= positive_threshold, POSITIVE)
        .when(F.col("score") <= negative_threshold, NEGATIVE)
        .otherwise(NEUTRAL)
    )
    out = df.withColumn("label", label.cast("int"))
    return out if keep_neutral else out.where(F.col("label") != NEUTRAL)


def filter_active_entities(df: DataFrame, min_user_interactions: int = 2, min_product_reviews: int = 1) -> DataFrame:
    """B2: keep active users, and then products that still have enough rows. A bound of 1 costs nothing."""

    def keep(rows: DataFrame, key: str, least: int) -> DataFrame:
        if least <= 1:
            return rows
        active = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(key)
        return rows.join(active, key, "left_semi")

    return keep(keep(df, "user_id", min_user_interactions), "product_id", min_product_reviews)


def _locate(hist: Sequence, left: int) -> tuple:
    """(value, rows in it, position inside it) of the ``left``-th row of an ordered histogram."""
    for h in hist:
        if left <= h["n"]:
            return h["v"], h["n"], left
        left -= h["n"]
    raise ValueError("position beyond the last row")


def _narrow(df: DataFrame, key: Column, size: int, left: int) -> tuple[str, int, bool]:
    """Narrow a boundary inside rows of one time by the md5 key, three hex digits at a time.

    Returns the key prefix of the boundary, how many of its rows belong to the left side, and whether
    that is all of them. Each step is one histogram of at most 4096 rows, so no row is ever sorted.
    """
    prefix = ""
    while left < size and len(prefix) < 32:
        rows = df.where(key.startswith(prefix)) if prefix else df
        hist = rows.groupBy(F.substring(key, 1, len(prefix) + 3).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
        prefix, size, left = _locate(hist, left)
    return prefix, left, left == size


def time_split(
    df: DataFrame,
    train_frac: float = 0.70,
    val_frac: float = 0.15,
    test_frac: float = 0.15,
    time_col: str = "timestamp",
    tie_key: str | None = None,
) -> DataFrame:
    """Tag rows train/val/test by row position in (timestamp, tie key) order, with exact sizes.

    Timestamps may be of any numeric type and unit, but not null. The tie key is an md5 string (by
    default of all columns). Only the two boundary rows are searched for: the boundary times as order
    statistics, ties by key prefix; all rows are then tagged by comparison, without a shuffle. If a
    boundary falls inside a run of equal rows, these copies are counted and dealt out by count.
    """
    parts = [Fraction(str(x)) for x in (train_frac, val_frac, test_frac)]
    if abs(sum(parts) - 1) > Fraction(1, 10**6):
        raise ValueError(f"train, val and test shares add up to {float(sum(parts))} instead of 1")
    names = ["train", "val", "test"]
    key = F.col(tie_key) if tie_key else F.md5(F.to_json(F.struct(*df.columns)))
    time = F.col(time_col)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(time_col).alias("known")).collect()[0]
    n = row["n"]
    if row["known"] < n:
        raise ValueError(f"{n - row['known']} rows have no {time_col}")
    cuts = [n * s.numerator // s.denominator for s in (parts[0], parts[0] + parts[1])]
    at = order_statistics(df.select(F.lit(0).alias("all"), time.alias("v")), "all", "v", {0: [c - 1 for c in cuts if c]}) if any(cuts) else {}
    sides: list[Column] = []
    runs: dict[tuple, dict] = {}
    for i, cut in enumerate(cuts):
        if cut == 0:
            sides.append(F.lit(False))
            continue
        value, before, size = at[0, cut - 1]
        now, left = F.lit(value), cut - before
        if left == size:
            sides.append(time <= now)
            continue
        prefix, left, whole = _narrow(df.where(time == now), key, size, left)
        # "g" sorts after every hex digit.
        earlier = (time < now) | ((time == now) & (key < prefix))
        same = (time == now) & (key >= prefix) & (key < prefix + "g")
        sides.append(earlier | same if whole else earlier)
        if not whole:
            runs.setdefault((value, prefix), {"same": same, "names": names[i:], "bounds": []})["bounds"].append(left)

    tag = F.when(sides[0], names[0]).when(sides[1], names[1]).otherwise(names[2])
    in_run = F.lit(False)
    for run in runs.values():
        in_run = in_run | run["same"]
    out = (df.where(~in_run) if runs else df).withColumn("split", tag)
    for run in runs.values():
        out = out.unionByName(_deal_copies(df.where(run["same"]), run["bounds"], run["names"]))
    return out


def _deal_copies(run: DataFrame, bounds: list[int], names: list[str]) -> DataFrame:
    """Split rows that share one sort key by count: (distinct row, copies), then copies in chunks."""
    cols = run.columns
    groups = run.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy(*cols).rowsBetween(W.unboundedPreceding, -1))
    groups = groups.withColumn("_b", F.coalesce(before, F.lit(0)))
    pieces, start = [], F.lit(0).cast("long")
    for name, bound in zip(names, [*bounds, None]):
        stop = F.col("_n") if bound is None else F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(bound) - F.col("_b")))
        pieces.append(F.struct(F.lit(name).alias("split"), (stop - start).alias("m")))
        start = stop
    dealt = groups.select(*cols, F.explode(F.array(*pieces)).alias("_p")).where("_p.m > 0")
    chunks = F.expr(f"sequence(0L, (_p.m - 1) div {COPIES_PER_TASK})")
    dealt = dealt.select(*cols, "_p", F.explode(chunks).alias("_c")).repartition(F.col("_c"))
    size = f"least(_p.m - _c * {COPIES_PER_TASK}, {COPIES_PER_TASK}L)"
    return dealt.select(
        *cols, F.expr("_p.split").alias("split"), F.explode(F.expr(f"sequence(1L, {size})")).alias("_i")
    ).drop("_i")


def split_ranges(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """One row with the time range of every split and whether the order holds."""
    def edge(fn, split):
        return fn(F.when(F.col("split") == split, F.col(time_col)))

    row = df.agg(
        edge(F.max, "train").alias("train_max"),
        edge(F.min, "val").alias("val_min"),
        edge(F.max, "val").alias("val_max"),
        edge(F.min, "test").alias("test_min"),
    )
    ordered = F.lit(True)
    for early, late in (("train_max", "val_min"), ("val_max", "test_min"), ("train_max", "test_min")):
        ordered = ordered & F.coalesce(F.col(early) <= F.col(late), F.lit(True))
    return row.withColumn("no_leakage", ordered)


def check_no_future_leakage(df: DataFrame, time_col: str = "timestamp") -> None:
    """Raise when a split starts before the previous one ends."""
    row = split_ranges(df, time_col).collect()[0]
    if not row["no_leakage"]:
        raise ValueError(f"future leakage between splits: {row.asDict()}")


def repeat_users(train: DataFrame, evaluated: DataFrame, min_train_interactions: int = 3) -> DataFrame:
    """Users of the evaluated split with enough rows in train."""
    active = (
        train.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_train"))
        .where(F.col("n_train") >= min_train_interactions)
    )
    return active.join(evaluated.select("user_id").distinct(), "user_id", "left_semi")


def dataset_statistics(df: DataFrame, brands: DataFrame, min_train_interactions: int = 3) -> DataFrame:
    """(scope, statistic, value) rows over a split-tagged, labelled table."""
    counts = [
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("product_id").alias("products"),
        F.sum((F.col("label") == POSITIVE).cast("long")).alias("positives"),
        F.sum((F.col("label") == NEGATIVE).cast("long")).alias("negatives"),
    ]
    per_split = df.groupBy(F.col("split").alias("scope")).agg(*counts)
    whole = df.agg(*counts).select(F.lit("all").alias("scope"), "*")
    wide = whole.unionByName(per_split)
    long = wide.unpivot("scope", ["rows", "users", "products", "positives", "negatives"], "statistic", "value")
    n_brands = brands.agg(F.countDistinct("brand").alias("value")).select(
        F.lit("all").alias("scope"), F.lit("brands").alias("statistic"), "value"
    )
    train = df.where(F.col("split") == "train")
    active = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_train_interactions)
    repeats = (
        df.where(F.col("split") != "train")
        .select("split", "user_id")
        .distinct()
        .join(active, "user_id", "left_semi")
        .groupBy(F.col("split").alias("scope"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select("scope", F.lit("repeat_users").alias("statistic"), "value")
    )
    return long.unionByName(n_brands).unionByName(repeats)


def catalog_statistics(catalog: DataFrame, title_queries: DataFrame, ngram_queries: DataFrame) -> DataFrame:
    """One row of catalog and query counts."""
    n_title = title_queries.agg(F.count(F.lit(1)).alias("n"))
    n_ngram = ngram_queries.agg(F.count(F.lit(1)).alias("n"))
    stats = catalog.agg(
        F.count(F.lit(1)).alias("catalog_products"),
        F.countDistinct("category_id").alias("catalog_categories"),
        F.sum((F.col("brand") != "unknown").cast("long")).alias("catalog_brands"),
        F.avg(F.length("cleaned_text")).alias("avg_text_length"),
    )
    return stats.select(
        "*", n_title.scalar().alias("queries_title"), n_ngram.scalar().alias("queries_ngram")
    )
