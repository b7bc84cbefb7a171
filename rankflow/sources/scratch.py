"""Where round-trip queries and long pipelines write tables: the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Application id -> folder, only for local masters without a configured one.
_local_folders: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a temporary folder only for a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        app = spark.sparkContext.applicationId
        base = _local_folders.setdefault(app, "") or tempfile.mkdtemp(prefix="rankflow-")
        _local_folders[app] = base
    return f"{base.rstrip('/')}/rankflow/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a stage's result to the shared folder and read it back, so later stages do not redo it.

    Files there outlive a lost executor, so only the reading task is repeated.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
