"""Buckets, arms, guardrails and the streaming forms."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rankflow.functions.hashing import assign_bucket, bucket_split
from rankflow.operators import experiment as R
from rankflow.schemas import IMPRESSIONS
from rankflow.sources import logs
from rankflow.sources.scratch import scratch_path
from rankflow.streaming import impressions as S


def ids(spark, n):
    return spark.createDataFrame([(f"user_{i}",) for i in range(n)], "id string")


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 2**31 - 1])
def test_buckets_equal_integer_arithmetic(spark, n):
    for r in ids(spark, 60).select("id", assign_bucket(F.col("id"), n).alias("b")).collect():
        assert r["b"] == int(hashlib.sha256(r["id"].encode()).hexdigest(), 16) % n


def test_bucket_balance_and_errors(spark):
    n0 = ids(spark, 1000).where(assign_bucket(F.col("id"), 2) == 0).count()
    assert 400 <= n0 <= 600
    with pytest.raises(ValueError):
        assign_bucket(F.lit("x"), 0)
    for f in (0.0, 1.0):
        with pytest.raises(ValueError):
            bucket_split(F.lit("x"), f)
    for r in ids(spark, 100).select("id", bucket_split(F.col("id"), 0.3).alias("t")).collect():
        assert r["t"] == (int(hashlib.sha256(r["id"].encode()).hexdigest(), 16) < int(0.3 * 2**256))


def test_arms_lift_and_guardrails(spark):
    arms = ["control", "treatment"]
    req = spark.createDataFrame(
        [(a, i, f"p{i}", lat) for a, lat in zip(arms, (20.0, 30.0)) for i in (1, 2, 3)],
        "arm string, request_key long, target_product_id string, latency_ms double",
    )
    lists = {"control": lambda i: ["x", "y", "z"], "treatment": lambda i: [f"p{i}", "x", "y"]}
    served = spark.createDataFrame(
        [(a, i, r + 1, p) for a in arms for i in (1, 2, 3) for r, p in enumerate(lists[a](i))],
        "arm string, request_key long, rank int, item_id string",
    )
    table = R.arm_summary(req, served, 3, 25.0)
    got = {r["arm"]: r for r in table.collect()}
    assert got["treatment"]["ndcg"] == 1.0 and got["treatment"]["latency_alert"] is True
    assert got["control"]["null_result_rate"] == 0.0 and got["control"]["latency_alert"] is False
    ab = R.ab_result(table, 0.1).collect()[0]
    assert ab["ndcg_lift"] > 0 and ab["mrr_lift"] > 0
    assert "Hypothesis" in ab["hypothesis"] and "which meets this bar" in ab["hypothesis"] and "+0.1000" in ab["hypothesis"]
    assert "does not meet" in R.ab_result(table, 2.0).collect()[0]["hypothesis"]
    g = R.guardrails(table).collect()[0]
    assert g["latency_alert"] and not g["null_rate_alert"] and not g["healthy"]
    # A request without a served row is a null result and scores 0.
    part = R.arm_summary(req, served.where("NOT (arm = 'treatment' AND request_key = 3)"), 3, 25.0)
    t = {r["arm"]: r for r in part.collect()}["treatment"]
    assert t["null_result_rate"] == pytest.approx(1 / 3) and t["ndcg"] == pytest.approx(2 / 3)
    assert R.guardrails(part).collect()[0]["null_rate_alert"]


def test_rank_discount_in_arm(spark):
    req = spark.createDataFrame([("control", 1, "b", 1.0)], "arm string, request_key long, target_product_id string, latency_ms double")
    served = spark.createDataFrame([("control", 1, 1, "a"), ("control", 1, 2, "b")], "arm string, request_key long, rank int, item_id string")
    row = R.arm_summary(req, served, 10, 25.0).collect()[0]
    assert row["ndcg"] == pytest.approx(1 / math.log2(3)) and row["mrr"] == 0.5


def test_request_sample_is_seeded_and_bounded(spark):
    q = spark.createDataFrame([(i, f"t{i}", i) for i in range(50)], "user_id long, query_text string, product_id long")
    a, b = (sorted(map(tuple, R.sample_requests(q, 10, ["user_id"], s).collect())) for s in (1, 1))
    assert a == b and len(a) == 10
    assert a != sorted(map(tuple, R.sample_requests(q, 10, ["user_id"], 2).collect()))


def test_streaming_log_and_windowed_null_rate(spark):
    rows = [(f"r{i}", "u", "q", [] if i % 4 == 0 else ["p"], [] if i % 4 == 0 else [1.0], 60.0 * i, i % 2) for i in range(40)]
    rows.append(("bad", "u", "q", ["p"], [], 0.0, 0))
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    spark.createDataFrame(rows, IMPRESSIONS).write.json(src)
    q = S.append_stream(S.stream_impressions(spark, src), out, scratch_path(spark, "ckpt"))
    q.awaitTermination(120)
    assert logs.read_impressions(spark, out).count() == 40
    stats = S.null_rate_by_window(logs.read_impressions(spark, out)).agg(F.sum("n_requests").alias("n"), F.max("null_result_rate").alias("m")).collect()[0]
    assert stats["n"] == 40 and 0 < stats["m"] <= 1


def test_arms_come_from_the_data(spark):
    req = spark.createDataFrame([(a, i, "a", ms) for a, ms in (("control", 10.0), ("variant_b", 500.0), ("variant_c", 20.0)) for i in range(5)],
                                "arm string, request_key long, target_product_id string, latency_ms double")
    served = req.select("arm", "request_key", F.lit(1).alias("rank"), F.lit("a").alias("item_id"))
    rows = {r["arm"]: r for r in R.arm_summary(req, served, 10, 100.0).collect()}
    assert rows["variant_b"]["p95_latency_ms"] == 500.0 and rows["variant_b"]["latency_alert"]
    assert set(rows) == {"control", "variant_b", "variant_c"} and not rows["variant_c"]["latency_alert"]
    with pytest.raises(ValueError):
        R.arm_summary(req.where(F.lit(False)), served)
