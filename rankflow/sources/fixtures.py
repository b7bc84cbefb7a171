"""The driver's tables seen as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.vecmath import as_double

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# Fixed value: products of this brand count as unbranded, so that the "unknown" brand occurs.
NO_NAME_BRAND = "Brand#11"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order: the interactions before their product is looked up."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    score = F.ceil(F.col("l_quantity") / 10)
    ids = ["o_custkey", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"]
    rows = line.select(*ids[1:], score.alias("_score")).join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("_score").cast("double").alias("score"),
        F.expr(f"timestampdiff(SECOND, {EPOCH}, CAST(o_orderdate AS TIMESTAMP_NTZ))").alias("timestamp"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )


def _row_key() -> Column:
    score = F.col("score").cast("long")
    ids = ["user_id", "product_id", "l_orderkey", "l_linenumber", "l_suppkey"]
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], score.cast("string")))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reviews: who (customer), what (part), score 1..5, when, and a tie key."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.lower("p_type").alias("summary"))
    rows = _ordered_lines(spark, sf_dir).join(part, F.col("product_id") == F.col("p_partkey"))
    return rows.select("user_id", "product_id", "score", "timestamp", "title", "summary", _row_key().alias("row_key"))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, lines, parts): line items with an order per product, and rows of ``part`` with that key.

    A product has lines * parts interactions. Only keys are joined and counted. Where every line item has exactly one
    order, which is asked of its keys alone, line items are counted as they are.
    """
    line, orders = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL"), table(spark, sf_dir, "orders")
    asked = line.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    known = orders.groupBy(F.col("o_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    one_order_each = asked.join(known, "key", "left").where("coalesce(orders, 0) <> 1").isEmpty()
    line = line.select("l_orderkey", "l_partkey")
    ordered = line if one_order_each else line.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = ordered.groupBy(F.col("l_partkey").alias("product_id")).agg(F.count(F.lit(1)).alias("lines"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("product_id")).agg(F.count(F.lit(1)).alias("parts"))
    return lines.where("product_id IS NOT NULL").join(parts, "product_id", "left").fillna(0, ["parts"])


def narrow_interactions(spark: SparkSession, sf_dir: str, one_part_each: bool) -> DataFrame:
    """The interactions without title, summary and key; ``with_row_key`` adds the key, which is longer than the rest.

    ``one_part_each`` says that every line item has exactly one part: then the product is not looked up.
    """
    rows = _ordered_lines(spark, sf_dir).where("product_id IS NOT NULL")
    if one_part_each:
        return rows
    part = table(spark, sf_dir, "part").select("p_partkey")
    return rows.join(part, F.col("product_id") == F.col("p_partkey")).drop("p_partkey")


def with_row_key(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if not c.startswith("l_")]
    return rows.select(*kept, _row_key().alias("row_key"))


def product_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, title, summary) of every part, the first by title and summary if a key repeats."""
    part = table(spark, sf_dir, "part").where("p_partkey IS NOT NULL")
    first = F.min(F.struct(F.col("p_name").alias("title"), F.lower("p_type").alias("summary"))).alias("_f")
    return part.groupBy(F.col("p_partkey").alias("product_id")).agg(first).select("product_id", "_f.title", "_f.summary")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_brand") != NO_NAME_BRAND).select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand")
    )


def product_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, embedding, label); most products have no vector, on purpose."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("product_id"), as_double(F.col("embedding")).alias("embedding"), "label"
    )


def served_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests with a logged latency."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_key"),
        "user_id",
        F.col("event_type").alias("page"),
        F.col("value").alias("latency_ms"),
    )
