"""Experiment buckets, A/B arms and guardrails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions.hashing import assign_bucket, bucket_split, seeded_key
from rankflow.functions.quantiles import exact_quantiles
from rankflow.operators.metrics import discount


def assign_buckets(entities: DataFrame, id_col: str, num_buckets: int = 2) -> DataFrame:
    """R1, bulk form: bucket of every distinct id."""
    return entities.select(id_col).distinct().withColumn("bucket", assign_bucket(F.col(id_col), num_buckets))


def treatment_split(entities: DataFrame, id_col: str, fraction: float = 0.5) -> DataFrame:
    """R2: distinct ids with their treatment flag."""
    return entities.select(id_col).distinct().withColumn("is_treatment", bucket_split(F.col(id_col), fraction))


def sample_requests(eval_queries: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A seeded sample of at most n requests (user_id, query_text, target_product_id)."""
    picked = eval_queries.withColumn("_k", seeded_key(seed, *[F.col(c) for c in keys])).orderBy("_k", *keys).limit(n)
    return picked.select("user_id", "query_text", F.col("product_id").alias("target_product_id"))


def arm_summary(requests: DataFrame, served: DataFrame, k: int = 10, latency_limit_ms: float = 100.0) -> DataFrame:
    """One row per arm that has requests; without any request it is an error.

    ``requests`` (arm, request_key, target_product_id, latency_ms): every request of every arm;
    ``served`` (arm, request_key, rank, item_id). A request without rows is a null result and counts 0.
    """
    keys = ["arm", "request_key"]
    joined = requests.select(*keys, "target_product_id").join(served.where(F.col("rank") <= k), keys)
    hit = F.col("item_id") == F.col("target_product_id")
    per = joined.groupBy(*keys).agg(
        F.sum(F.when(hit, discount(F.col("rank"))).otherwise(0.0)).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.lit(0).alias("is_null"),
    )
    full = requests.join(per, keys, "left").fillna(0.0, ["ndcg", "mrr"]).fillna(1, ["is_null"])
    table = full.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("mrr").alias("mrr"),
        F.avg("is_null").alias("null_result_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    )
    p95 = {a: q[0.95] for a, q in exact_quantiles(requests, "arm", "latency_ms", [0.95]).items() if a is not None}
    if not p95:
        raise ValueError("an A/B report needs requests")
    lookup = F.create_map(*[x for a, v in p95.items() for x in (F.lit(a), F.lit(v).cast("double"))])
    table = table.withColumn("p95_latency_ms", F.coalesce(lookup[F.col("arm")], F.lit(0.0)))
    return table.withColumn("latency_alert", F.col("p95_latency_ms") > latency_limit_ms)


def _pivot(arms: DataFrame, cols: Sequence[str]) -> DataFrame:
    return arms.agg(
        *[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in ("control", "treatment") for c in cols]
    )


def ab_result(arms: DataFrame, expected_min_ndcg_lift: float = 0.01) -> DataFrame:
    """NDCG and MRR lift of treatment over control, and the hypothesis sentence."""
    row = _pivot(arms, ["ndcg", "mrr"]).select(
        (F.col("treatment_ndcg") - F.col("control_ndcg")).alias("ndcg_lift"),
        (F.col("treatment_mrr") - F.col("control_mrr")).alias("mrr_lift"),
    )
    return row.withColumn("hypothesis", hypothesis_statement(F.col("ndcg_lift"), expected_min_ndcg_lift))


def hypothesis_statement(lift: F.Column, expected: float) -> F.Column:
    """The report sentence, lifts with four decimals."""
    # The wording of the report.
    text = (
        "Hypothesis: the two-stage treatment improves ranking quality over TF-IDF by at least "
        "+%.4f NDCG@K while keeping guardrails healthy. Offline estimate: ΔNDCG=%.4f, which %s this bar."
    )
    verdict = F.when(lift >= F.lit(float(expected)), "meets").otherwise("does not meet")
    return F.format_string(text, F.lit(float(expected)), lift, verdict)


def guardrails(arms: DataFrame, max_null_result_rate: float = 0.01) -> DataFrame:
    """Alerts on the null rate and on the latency of either arm."""
    return arms.agg(
        F.coalesce(F.max(F.col("null_result_rate") > max_null_result_rate), F.lit(False)).alias("null_rate_alert"),
        F.coalesce(F.max("latency_alert"), F.lit(False)).alias("latency_alert"),
    ).withColumn("healthy", ~(F.col("null_rate_alert") | F.col("latency_alert")))
