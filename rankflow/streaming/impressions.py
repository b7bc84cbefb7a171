"""Streaming forms of the impression log (A7) and of the latency and null-result guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankflow.schemas import IMPRESSIONS
from rankflow.sources.logs import is_valid


def stream_impressions(spark: SparkSession, path: str) -> DataFrame:
    """New files of an impression log as a stream."""
    return spark.readStream.schema(IMPRESSIONS).json(path)


def append_stream(impressions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append valid records of a stream to a log; the checkpoint makes restarts safe."""
    return (
        impressions.where(is_valid())
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def null_rate_by_window(impressions: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests and null-result rate per bucket and time window, with bounded state."""
    rows = impressions.withColumn("ts", F.timestamp_seconds("timestamp")).withWatermark("ts", late)
    empty = (F.size("candidate_ids") == 0).cast("double")
    return rows.groupBy(F.window("ts", window).alias("w"), "experiment_bucket").agg(
        F.count(F.lit(1)).alias("n_requests"), F.avg(empty).alias("null_result_rate")
    )
