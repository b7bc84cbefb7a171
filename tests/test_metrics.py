"""Known answers of the ranking metrics, and brute force on random lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.functions.quantiles import exact_quantiles
from rankflow.operators import metrics as P


def relations(spark, relevant, retrieved):
    ranked = [(q, r + 1, i) for q, items in enumerate(retrieved) for r, i in enumerate(items)]
    truth = [(q, i) for q, items in enumerate(relevant) for i in items]
    return (
        spark.createDataFrame(ranked, "query_id long, rank int, item_id string"),
        spark.createDataFrame(truth, "query_id long, item_id string"),
        spark.createDataFrame([(q,) for q in range(len(relevant))], "query_id long"),
    )


def value(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_recall_known_answers(spark):
    r = relations(spark, [["fig", "nut", "pea"], [], ["oat"]], [["kale", "pea", "fig", "rye", "nut"], ["oat"], []])
    got = value(P.recall_at_k(*r, ks=[1, 2, 3, 5]))
    # Of three queries one has nothing relevant and one nothing listed; both count 0.
    assert got == pytest.approx({"recall@1": 0.0, "recall@2": 1 / 9, "recall@3": 2 / 9, "recall@5": 1 / 3})


def test_ndcg_mrr_hit_known_answers(spark):
    # First hits at ranks 3, 1 and 4, none for the last; the second query has two relevant items, at 1 and 5.
    lists = [["ivy", "elm", "ash", "oak"], ["fir", "ivy", "elm", "yew", "ash"], ["oak", "elm", "ivy", "yew"], ["elm"]]
    r = relations(spark, [["ash"], ["fir", "ash"], ["yew"], ["oak"]], lists)
    best_two = 1 + 1 / math.log2(3)
    assert value(P.ndcg_at_k(*r, ks=[3]))["ndcg@3"] == pytest.approx((1 / 2 + 1 / best_two) / 4)
    assert value(P.ndcg_at_k(*r, ks=[5]))["ndcg@5"] == pytest.approx((1 / 2 + (1 + 1 / math.log2(6)) / best_two + 1 / math.log2(5)) / 4)
    assert value(P.mean_reciprocal_rank(*r))["mrr"] == pytest.approx((1 / 3 + 1 + 1 / 4) / 4)
    assert value(P.mean_reciprocal_rank(*r, k=3))["mrr"] == pytest.approx((1 / 3 + 1) / 4)
    assert value(P.hit_rate_at_k(*r, ks=[1, 3, 4])) == {"hit_rate@1": 0.25, "hit_rate@3": 0.5, "hit_rate@4": 0.75}


def test_all_metrics_against_brute_force_with_repeats(spark):
    rng = random.Random(3)
    items = [f"i{j}" for j in range(12)]
    relevant = [rng.choices(items, k=rng.randint(0, 5)) for _ in range(40)]
    retrieved = [rng.choices(items, k=rng.randint(0, 15)) for _ in range(40)]

    def ndcg(rel, ret, k):
        s = set(rel)
        if not s:
            return 0.0
        dcg = sum(1 / math.log2(i + 2) for i, x in enumerate(ret[:k]) if x in s)
        return dcg / sum(1 / math.log2(i + 2) for i in range(min(len(s), k)))

    def rr(rel, ret, k):
        return next((1 / (i + 1) for i, x in enumerate(ret[:k]) if x in set(rel)), 0.0)

    want = {f"ndcg@{k}": np.mean([ndcg(a, b, k) for a, b in zip(relevant, retrieved)]) for k in P.NDCG_KS}
    want |= {
        f"recall@{k}": np.mean([len(set(a) & set(b[:k])) / len(set(a)) if a else 0 for a, b in zip(relevant, retrieved)])
        for k in P.RECALL_KS
    }
    want |= {f"hit_rate@{k}": np.mean([bool(set(a) & set(b[:k])) for a, b in zip(relevant, retrieved)]) for k in P.HIT_KS}
    want["mrr"] = np.mean([rr(a, b, 100) for a, b in zip(relevant, retrieved)])
    got = value(P.mean_metrics(P.per_query_metrics(*relations(spark, relevant, retrieved))))
    assert got.keys() == want.keys()
    for name, x in want.items():
        assert got[name] == pytest.approx(x), name


def test_shared_list_equals_one_list_per_query(spark):
    ranked, relevant, queries = relations(spark, [["a", "c"], ["z"], ["b"]], [["a", "b", "c"]] * 3)
    shared = ranked.where("query_id = 0").select("rank", "item_id")
    hits = P.shared_list_hits(shared, relevant, P.NDCG_KS)
    a = value(P.mean_metrics(P.metrics_from_hits(hits, relevant, queries)))
    assert a == pytest.approx(value(P.mean_metrics(P.per_query_metrics(ranked, relevant, queries))))


def test_unequal_query_sets_are_an_error(spark):
    ranked, relevant, _ = relations(spark, [["a"]], [["a"], ["b"]])
    with pytest.raises(ValueError):
        P.check_same_queries(relevant, ranked)


def test_graded_ndcg(spark):
    ranked, _, queries = relations(spark, [["a"]], [["b", "a"]])
    gains = spark.createDataFrame([(0, "a", 3.0), (0, "b", 1.0), (0, "c", 2.0)], "query_id long, item_id string, gain double")
    got = P.graded_ndcg(ranked, gains, queries, 2).collect()[0]["ndcg"]
    assert got == pytest.approx((1 + 3 / math.log2(3)) / (3 + 2 / math.log2(3)))


def test_coverage_long_tail_entropy(spark):
    ranked, _, queries = relations(spark, [[], []], [["a", "b", "c"], ["a", "d", "e"]])
    cat = spark.createDataFrame([(x,) for x in "abcde"], "product_id string")
    pop = spark.createDataFrame([("a", 100), ("b", 1), ("c", 2), ("d", 1), ("e", 100)], "product_id string, n long")
    assert P.coverage_at_k(ranked, cat, 2).collect()[0]["coverage"] == pytest.approx(0.6)
    assert P.long_tail_at_k(ranked, pop, 2, threshold=2.0).collect()[0]["long_tail"] == pytest.approx(0.5)
    cats = spark.createDataFrame([(0, 1, "x"), (0, 2, "x"), (0, 3, "y"), (1, 1, "z")], "query_id long, rank int, category string")
    e = {r["query_id"]: r["entropy"] for r in P.category_entropy_at_k(cats, queries, 3).collect()}
    assert e[0] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3)) and e[1] == 0.0


@pytest.mark.parametrize("bins", [2, 16, 2048])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, bins):
    """Several groups in one pass, among them ends of the double range and very close values."""
    from rankflow.functions import quantiles

    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(1)
    groups = {
        "spread": rng.lognormal(size=3000), "heavy": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)), "constant": np.full(300, 2.5),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 5e-324, 1e-300]), "close": 1e15 + rng.integers(0, 4, 200) / 8, "one": np.array([3.0]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("heavy", None), ("none", None)], "g string, v double")
    got = exact_quantiles(df, "g", "v", [0.0, 0.2, 0.5, 0.95, 0.99, 1.0])
    for g, x in groups.items():
        for p, v in got[g].items():
            at = np.sort(x)[[math.floor((len(x) - 1) * p), math.ceil((len(x) - 1) * p)]]
            assert at[0] <= v <= at[1] and (g == "wide" or v == pytest.approx(np.quantile(x, p), rel=1e-12))
    assert set(got["none"].values()) == {None}
    assert exact_quantiles(df.where(F.lit(False)), "g", "v", [0.5]) == {}


def test_quantiles_with_infinity_and_nan(spark):
    rows = [(float(i % 997),) for i in range(30_000)] + [(math.inf,), (-math.inf,), (math.nan,)]
    df = spark.createDataFrame(rows, "v double").select(F.lit("a").alias("g"), "v")
    got = exact_quantiles(df, "g", "v", [0.0, 0.5, 1.0])["a"]
    assert got[0.0] == -math.inf and got[0.5] == 497.0 and math.isnan(got[1.0])
    summary = P.latency_summary(df.withColumnRenamed("v", "latency_ms")).collect()[0]
    assert summary["p50_ms"] == 497.0


def test_latency_summary_needs_p95(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "latency_ms double")
    with pytest.raises(KeyError):
        P.latency_summary(df, percentiles=(50,))
    row = P.latency_summary(df, max_p95_ms=2.0).collect()[0]
    assert row["p50_ms"] == 2.0 and row["n_queries"] == 2 and row["pass"] is False


def test_diagnostics_read_the_whole_list(spark):
    ranked = spark.range(1, 301).select(F.lit("ring").alias("query_text"), F.col("id").cast("int").alias("rank"), (1000 + F.col("id")).alias("item_id"))
    queries = spark.createDataFrame([(f"q{r}", "ring", 1000 + r) for r in (7, 40, 150, 290, 301)], "query_id string, query_text string, product_id long")
    got = {r["query_id"]: (r["rank"], r["hit@10"], r["hit@50"]) for r in P.query_diagnostics(ranked, queries).collect()}
    assert got == {"q7": (7, True, True), "q40": (40, False, True), "q150": (150, False, False), "q290": (290, False, False), "q301": (None, False, False)}
    assert P.query_diagnostics(ranked, queries, 100).where("rank IS NOT NULL").count() == 2
