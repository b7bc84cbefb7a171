"""Impression logs (A7-A9): JSON lines with declared schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.hashing import assign_bucket
from rankflow.schemas import IMPRESSIONS


def build_impressions(requests: DataFrame, served: DataFrame, request_key: str = "request_key") -> DataFrame:
    """One record per request from (request, rank, item_id, score) rows.

    Requests that were served nothing keep empty arrays. A list is as long as one result page.
    """
    pages = served.groupBy(request_key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("page")
    )
    page = F.coalesce("page", F.array().cast("array<struct<rank:int,item_id:string,score:double>>"))
    return requests.join(
        pages.withColumn("page", F.col("page").cast("array<struct<rank:int,item_id:string,score:double>>")),
        request_key,
        "left",
    ).select(
        F.expr("uuid()").alias("request_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "query_text",
        F.transform(page, lambda p: p["item_id"]).alias("candidate_ids"),
        F.transform(page, lambda p: p["score"]).alias("predicted_scores"),
        F.unix_millis(F.current_timestamp()).cast("double").__truediv__(1000.0).alias("timestamp"),
        assign_bucket(F.col("user_id"), 2).alias("experiment_bucket"),
    )


def is_valid() -> F.Column:
    return F.size("candidate_ids") == F.size("predicted_scores")


def validate_impressions(df: DataFrame) -> DataFrame:
    """Fail the job when ids and scores of a record differ in length."""
    message = F.lit("candidate_ids and predicted_scores must have the same length")
    return df.where(F.assert_true(is_valid(), message).isNull())


def quarantine_impressions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) records, for pipelines that must not stop at a bad record."""
    return df.where(is_valid()), df.where(~F.coalesce(is_valid(), F.lit(False)))


def append_impressions(df: DataFrame, path: str) -> None:
    """Append validated records as JSON lines."""
    validate_impressions(df).write.mode("append").json(path)


def read_impressions(spark: SparkSession, path: str) -> DataFrame:
    """All records; a log that was never written reads as empty. Blank lines are skipped."""
    try:
        return spark.read.schema(IMPRESSIONS).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], IMPRESSIONS)
