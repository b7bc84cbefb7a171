"""Training pairs with hard negatives, and the contrastive loss over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions.hashing import seeded_int, seeded_key
from rankflow.functions.ordering import bucketed_rank, md5_levels

NUMBER_BUCKET = 65536


def positive_pairs(interactions: DataFrame, queries: DataFrame) -> DataFrame:
    """distinct (user_id, product_id, query_text) of positive interactions and their queries."""
    positives = interactions.where(F.col("label") == 1).select("user_id", "product_id").distinct()
    return positives.join(queries.select("product_id", "query_text").distinct(), "product_id").select(
        "user_id", "product_id", "query_text"
    )


def _numbered(products: DataFrame, by: list[str], out: str) -> DataFrame:
    """Dense 0-based number of every product within ``by``, in md5 order of the id."""
    keyed = products.withColumn("_k", F.md5(F.col("product_id").cast("string")))
    ranked = bucketed_rank(keyed, out, by, md5_levels("_k", products.count()), [F.col("_k"), F.col("product_id")])
    return ranked.withColumn(out, F.col(out) - 1).drop("_k")


def hard_negatives(pairs: DataFrame, catalog: DataFrame, seed: int = 42) -> DataFrame:
    """one negative per pair: same category, not a positive of the user; seeded.

    Products of a category are numbered; a pair starts at a hashed number and takes the first one,
    going round, that is not a positive of the user. Runs of consecutive positives are found per
    (user, category), so every pair needs two equi-joins and no candidate list is ever built. When
    the user has all of the category, any other catalog product is taken by the same numbering.
    """
    base = catalog.groupBy("product_id").agg(
        F.min(F.struct("cleaned_text", "category_id")).alias("c")
    ).select("product_id", "c.cleaned_text", F.coalesce("c.category_id", F.lit("unknown")).alias("category_id"))
    numbered = _numbered(base, ["category_id"], "no")
    sizes = base.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    products = _numbered(numbered, [], "gno")
    n_all = base.agg(F.count(F.lit(1)).alias("n")).scalar()

    # Runs of consecutively numbered positives per (user, category).
    mine = pairs.select("user_id", "product_id").distinct().join(
        numbered.select("product_id", "category_id", "no"), "product_id"
    )
    chunk = [F.floor(F.col("no") / NUMBER_BUCKET)]
    place = bucketed_rank(mine, "place", ["user_id", "category_id"], chunk, [F.col("no")])
    runs = place.withColumn("run", F.col("no") - F.col("place"))
    ends = runs.groupBy("user_id", "category_id", "run").agg(F.max("no").alias("end"))
    taken = runs.join(ends, ["user_id", "category_id", "run"]).select("user_id", "category_id", "no", "end")

    start = seeded_int(seed, F.col("user_id"), F.col("product_id"), F.col("query_text"))
    work = (
        pairs.join(products.select("product_id", "category_id", "cleaned_text", "gno"), "product_id")
        .join(sizes, "category_id")
        .withColumn("h", start)
        .withColumn("s", F.pmod("h", F.col("n")))
    )
    at = taken.select("user_id", "category_id", F.col("no").alias("s"), F.col("end").alias("end1"))
    work = work.join(at, ["user_id", "category_id", "s"], "left")
    # First free number at or after s; past the last number the search goes on at 0.
    first = F.coalesce(F.col("end1") + 1, F.col("s"))
    work = work.withColumn("p", F.when(first >= F.col("n"), F.lit(0).cast("long")).otherwise(first)).withColumn(
        "wrapped", first >= F.col("n")
    )
    from_zero = taken.where(F.col("no") == 0).select("user_id", "category_id", F.col("end").alias("end0"))
    work = work.join(from_zero, ["user_id", "category_id"], "left")
    choice = F.when(F.col("wrapped"), F.coalesce(F.col("end0") + 1, F.lit(0).cast("long"))).otherwise(F.col("p"))
    work = work.withColumn("no", choice).withColumn("full", F.col("no") >= F.col("n"))
    neg = numbered.select("category_id", "no", F.col("product_id").alias("neg1"), F.col("cleaned_text").alias("neg_text1"))
    work = work.join(neg, ["category_id", "no"], "left")
    # Fallback: any product but the positive one.
    g = F.pmod("h", n_all)
    g = F.when(g == F.col("gno"), F.pmod(g + 1, n_all)).otherwise(g)
    work = work.withColumn("gneg", F.when(F.col("full"), g))
    anyone = products.select(F.col("gno").alias("gneg"), F.col("product_id").alias("neg2"), F.col("cleaned_text").alias("neg_text2"))
    work = work.join(anyone, "gneg", "left")
    return work.select(
        "user_id",
        "product_id",
        "query_text",
        F.coalesce("neg1", "neg2").alias("neg_product_id"),
        F.col("cleaned_text").alias("pos_text"),
        F.coalesce("neg_text1", "neg_text2").alias("neg_text"),
    ).where(F.col("neg_product_id") != F.col("product_id"))


def assign_batches(pairs: DataFrame, batch_size: int = 32, seed: int = 42) -> DataFrame:
    """Seeded shuffle of the pairs into batches of exactly batch_size rows (the last may be smaller)."""
    keyed = pairs.withColumn("_k", seeded_key(seed, F.col("user_id"), F.col("product_id"), F.col("query_text")))
    ranked = bucketed_rank(keyed, "pos_in_epoch", [], md5_levels("_k", pairs.count()), [F.col("_k")])
    return ranked.withColumn("batch_id", F.floor((F.col("pos_in_epoch") - 1) / batch_size)).drop("_k")


def contrastive_loss(rows: DataFrame, temperature: float = 0.05) -> DataFrame:
    """per batch, mean cross-entropy of q . [pos; neg] / T with the own positive as the truth.

    ``rows`` (batch_id, row_id, q, p, n). Every row meets its own batch only, and a batch has a fixed
    size; the row maximum is subtracted before exponentials.
    """
    from rankflow.functions.vecmath import dot

    cand = rows.select(
        "batch_id",
        F.explode(
            F.array(
                F.struct(F.col("row_id").alias("c"), F.col("p").alias("v")),
                F.struct(F.lit(None).cast(rows.schema["row_id"].dataType).alias("c"), F.col("n").alias("v")),
            )
        ).alias("x"),
    ).select("batch_id", "x.c", "x.v")
    scored = rows.select("batch_id", "row_id", "q").join(cand, "batch_id").select(
        "batch_id",
        "row_id",
        (dot(F.col("q"), F.col("v")) / temperature).alias("s"),
        F.col("c").eqNullSafe(F.col("row_id")).alias("own"),
    )
    top = scored.groupBy("batch_id", "row_id").agg(
        F.max("s").alias("m"), F.collect_list("s").alias("all"), F.max(F.when(F.col("own"), F.col("s"))).alias("own")
    )
    spread = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))
    per_row = top.select("batch_id", (F.log(spread) + F.col("m") - F.col("own")).alias("loss"))
    return per_row.groupBy("batch_id").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"))
