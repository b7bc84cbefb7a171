"""Corpus pipeline: documents in, packed training sequences out. Each stage is stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankflow.llm import pipeline
from rankflow.llm.common import materialize, table

STAGES = [
    ("language id", pipeline.language_stage),
    ("simhash near-dedup", pipeline.near_duplicate_stage),
    ("substring dedup", pipeline.substring_stage),
    ("benchmark decontamination", pipeline.benchmark_stage),
    ("packing", pipeline.packing_stage),
]

#: Trained models, fingerprints and a tokenizer decide: SQL cannot say it. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
