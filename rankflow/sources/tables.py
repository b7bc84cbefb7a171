"""Processed tables, metric reports, stored vectors and stored text indexes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4: a (gzip) CSV table with a header, under a declared schema."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A5: split interactions as Parquet, one folder per split, so readers prune by split."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def metric_report(metrics: DataFrame, model: str, split: str, run_ts: int, meta: dict[str, str] | None = None) -> DataFrame:
    """(metric, value) rows as a versioned report."""
    pairs = [F.lit(x) for kv in (meta or {}).items() for x in kv]
    meta_col = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return metrics.select(
        "metric",
        F.col("value").cast("double").alias("value"),
        F.lit(run_ts).cast("long").alias("run_ts"),
        meta_col.alias("meta"),
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
    )


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").partitionBy("model", "split").parquet(path)


def store_embeddings(df: DataFrame, path: str) -> None:
    """A10: (product_id, embedding); ids travel in the row."""
    df.select("product_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a finished write: a failed one leaves no success mark."""
    try:
        spark.read.format("binaryFile").load(f"{path.rstrip('/')}/_SUCCESS").select("path").first()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def load_or_store_embeddings(spark: SparkSession, path: str, build) -> DataFrame:
    """A10: reuse stored vectors if present and complete, otherwise build and store them first."""
    if not written(spark, path):
        store_embeddings(build(), path)
    return spark.read.parquet(path)
