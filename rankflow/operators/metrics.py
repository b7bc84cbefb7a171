"""Ranking metrics and evaluation reports over relations.

Common form: ranked (query_id, rank, item_id), relevant (query_id, item_id), queries (query_id).
Every mean starts from ``queries`` with left joins, so a query that missed, or has no list, counts 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.ordering import top_per_group
from rankflow.functions.quantiles import exact_quantiles

# Default cut-offs.
RECALL_KS = [1, 5, 10, 20, 50]
NDCG_KS = [5, 10, 20]
HIT_KS = [5, 10, 20]
MRR_K = 100


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ideal_dcg(n: Column, k: int) -> Column:
    """DCG of min(n, k) unit gains, looked up in a table of k prefix sums."""
    sums, total = [0.0], 0.0
    for i in range(1, k + 1):
        total += 1.0 / log2(i + 1)
        sums.append(total)
    table = F.array(*[F.lit(x) for x in sums])
    return F.element_at(table, F.least(n, F.lit(k)).cast("int") + 1)


def item_hits(ranked: DataFrame, relevant: DataFrame, ndcg_ks: Sequence[int]) -> DataFrame:
    """(query_id, item_id, r, g@k): best rank of each relevant item, and its discounted gain within k.

    An item listed twice is one hit for recall, but gains at every position for NDCG.
    """
    truth = relevant.select("query_id", "item_id").distinct()
    gains = [F.sum(F.when(F.col("rank") <= k, discount(F.col("rank"))).otherwise(0.0)).alias(f"g@{k}") for k in ndcg_ks]
    return (
        ranked.select("query_id", "rank", "item_id")
        .join(truth, ["query_id", "item_id"])
        .groupBy("query_id", "item_id")
        .agg(F.min("rank").alias("r"), *gains)
    )


def shared_list_hits(shared: DataFrame, relevant: DataFrame, ndcg_ks: Sequence[int]) -> DataFrame:
    """As ``item_hits`` when all queries are served one list (rank, item_id): a join on the item only."""
    truth = relevant.select("query_id", "item_id").distinct()
    gains = [F.sum(F.when(F.col("rank") <= k, discount(F.col("rank"))).otherwise(0.0)).alias(f"g@{k}") for k in ndcg_ks]
    best = shared.groupBy("item_id").agg(F.min("rank").alias("r"), *gains)
    return truth.join(best, "item_id").select("query_id", "item_id", "r", *[f"g@{k}" for k in ndcg_ks])


def metrics_from_hits(
    hits: DataFrame,
    relevant: DataFrame,
    queries: DataFrame,
    recall_ks: Sequence[int] = RECALL_KS,
    ndcg_ks: Sequence[int] = NDCG_KS,
    hit_ks: Sequence[int] = HIT_KS,
    mrr_k: int = MRR_K,
) -> DataFrame:
    """One row per query with recall@k, ndcg@k, mrr and hit_rate@k."""
    n_rel = relevant.select("query_id", "item_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    counts = sorted(set(recall_ks) | set(hit_ks))
    sums = [F.sum((F.col("r") <= k).cast("long")).alias(f"h@{k}") for k in counts]
    sums += [F.sum(f"g@{k}").alias(f"d@{k}") for k in ndcg_ks]
    per = hits.groupBy("query_id").agg(F.min("r").alias("first_rank"), *sums)
    base = queries.select("query_id").join(n_rel, "query_id", "left").join(per, "query_id", "left")
    cols = [(F.coalesce(F.col(f"h@{k}"), F.lit(0)) / F.col("n_rel")).alias(f"recall@{k}") for k in recall_ks]
    cols += [(F.coalesce(F.col(f"d@{k}"), F.lit(0.0)) / ideal_dcg(F.col("n_rel"), k)).alias(f"ndcg@{k}") for k in ndcg_ks]
    cols += [F.when(F.col("first_rank") <= mrr_k, F.lit(1.0) / F.col("first_rank")).otherwise(0.0).alias("mrr")]
    cols += [(F.coalesce(F.col(f"h@{k}"), F.lit(0)) > 0).cast("double").alias(f"hit_rate@{k}") for k in hit_ks]
    names = metric_names(recall_ks, ndcg_ks, hit_ks)
    return base.select("query_id", "first_rank", *cols).fillna(0.0, names)


def per_query_metrics(
    ranked: DataFrame, relevant: DataFrame, queries: DataFrame,
    recall_ks: Sequence[int] = RECALL_KS, ndcg_ks: Sequence[int] = NDCG_KS, hit_ks: Sequence[int] = HIT_KS,
    mrr_k: int = MRR_K,
) -> DataFrame:
    return metrics_from_hits(
        item_hits(ranked, relevant, ndcg_ks), relevant, queries, recall_ks, ndcg_ks, hit_ks, mrr_k
    )


def metric_names(recall_ks=RECALL_KS, ndcg_ks=NDCG_KS, hit_ks=HIT_KS) -> list[str]:
    return [f"recall@{k}" for k in recall_ks] + [f"ndcg@{k}" for k in ndcg_ks] + ["mrr"] + [
        f"hit_rate@{k}" for k in hit_ks
    ]


def mean_metrics(per_query: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(metric, value) means over all queries, in one pass; no query at all gives 0."""
    names = list(names or [c for c in per_query.columns if c not in ("query_id", "first_rank")])
    row = per_query.agg(*[F.coalesce(F.avg(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]))
    return row.select(pairs.alias("m")).select("m.metric", "m.value")


def check_same_queries(relevant: DataFrame, ranked: DataFrame) -> None:
    """Raise when one side has a query that the other one lacks."""
    a, b = relevant.select("query_id").distinct(), ranked.select("query_id").distinct()
    if a.join(b, "query_id", "left_anti").limit(1).count() or b.join(a, "query_id", "left_anti").limit(1).count():
        raise ValueError("relevant and ranked lists must cover the same queries")


def recall_at_k(ranked, relevant, queries, ks=RECALL_KS) -> DataFrame:
    """P1."""
    return mean_metrics(per_query_metrics(ranked, relevant, queries, ks, [], []), [f"recall@{k}" for k in ks])


def ndcg_at_k(ranked, relevant, queries, ks=NDCG_KS) -> DataFrame:
    """P2."""
    return mean_metrics(per_query_metrics(ranked, relevant, queries, [], ks, []), [f"ndcg@{k}" for k in ks])


def graded_ndcg(ranked: DataFrame, gains: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per-query NDCG@k with gains (query_id, item_id, gain); ideal = the k largest of all gains."""
    gained = ranked.where(F.col("rank") <= k).join(gains, ["query_id", "item_id"])
    dcg = gained.groupBy("query_id").agg(F.sum(F.col("gain") * discount(F.col("rank"))).alias("dcg"))
    best = top_per_group(gains, ["query_id"], [F.desc("gain"), F.asc("item_id")], k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("gain") * discount(F.col("rank"))).alias("idcg"))
    out = queries.select("query_id").join(ideal, "query_id", "left").join(dcg, "query_id", "left")
    value = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)
    return out.select("query_id", value.alias("ndcg"))


def mean_reciprocal_rank(ranked, relevant, queries, k: int = MRR_K) -> DataFrame:
    """P4."""
    return mean_metrics(per_query_metrics(ranked, relevant, queries, [], [], [], k), ["mrr"])


def hit_rate_at_k(ranked, relevant, queries, ks=HIT_KS) -> DataFrame:
    """P5."""
    return mean_metrics(per_query_metrics(ranked, relevant, queries, [], [], ks), [f"hit_rate@{k}" for k in ks])


def coverage_at_k(ranked: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Distinct items shown within k over the catalog size (0 for an empty catalog)."""
    size = catalog.agg(F.countDistinct("product_id").alias("n")).scalar()
    shown = ranked.where(F.col("rank") <= k).agg(F.countDistinct("item_id").alias("shown"))
    return shown.select("shown", size.alias("catalog_size")).select(
        "shown", "catalog_size",
        F.when(F.col("catalog_size") > 0, F.col("shown") / F.col("catalog_size")).otherwise(0.0).alias("coverage"),
    )


def popularity_threshold(popularity: DataFrame, quantile: float = 0.2) -> DataFrame:
    """One row: interpolated quantile of the counts ``n``, from counts of counts."""
    freq = popularity.groupBy("n").agg(F.count(F.lit(1)).alias("freq"))
    return freq.agg(F.percentile(F.col("n").cast("double"), quantile, F.col("freq")).alias("threshold"))


def long_tail_at_k(ranked: DataFrame, popularity: DataFrame, k: int, quantile: float | None = 0.2, threshold: float | None = None) -> DataFrame:
    """Share of shown items whose known popularity ``n`` is at or under the threshold.

    Items absent from ``popularity`` (product_id, n) are not long tail.
    """
    bound = F.lit(float(threshold)) if threshold is not None else popularity_threshold(popularity, quantile).scalar()
    counts = ranked.where(F.col("rank") <= k).groupBy("item_id").agg(F.count(F.lit(1)).alias("shown"))
    tail = counts.join(popularity.select(F.col("product_id").alias("item_id"), "n"), "item_id", "left")
    hits = F.sum(F.when(F.col("n") <= bound, F.col("shown")).otherwise(0))
    return tail.agg(F.coalesce(hits / F.sum("shown"), F.lit(0.0)).alias("long_tail"))


def category_entropy_at_k(shown: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per-query category entropy (bits) of the first k of (query_id, rank, category)."""
    cells = shown.where(F.col("rank") <= k).groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    per = cells.groupBy("query_id").agg(
        F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0)).alias("entropy")
    )
    return queries.select("query_id").join(per, "query_id", "left").fillna(0.0, ["entropy"])


def user_relevance(interactions: DataFrame) -> DataFrame:
    """P10: (query_id, item_id, n): positives per user in long form; n keeps the repeats."""
    return (
        interactions.where(F.col("label") == 1)
        .groupBy(F.col("user_id").alias("query_id"), F.col("product_id").alias("item_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def report(per_query: DataFrame, extra: dict[str, Column], split: str) -> DataFrame:
    """(split, metric, value): means plus further one-row figures such as n_queries."""
    means = mean_metrics(per_query)
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in extra.items()])
    rest = per_query.agg(pairs.alias("p")).select(F.explode("p").alias("m")).select("m.metric", "m.value")
    return means.unionByName(rest).select(F.lit(split).alias("split"), "metric", "value")


def evaluate_users(ranked: DataFrame, interactions: DataFrame, k: int = 200, split: str = "test", shared: bool = False) -> DataFrame:
    """All metrics over the users with a positive in the split.

    ``ranked`` is (query_id, rank, item_id), or one list (rank, item_id) for all with ``shared``.
    """
    relevant = user_relevance(interactions).select("query_id", "item_id")
    queries = relevant.select("query_id").distinct()
    cut = ranked.where(F.col("rank") <= k)
    hits = shared_list_hits(cut, relevant, NDCG_KS) if shared else item_hits(cut, relevant, NDCG_KS)
    per = metrics_from_hits(hits, relevant, queries)
    return report(per, {"n_queries": F.count(F.lit(1))}, split)


def evaluate_queries(ranked: DataFrame, queries: DataFrame, k: int = 200, split: str = "query_eval") -> DataFrame:
    """All metrics over queries with one true product each.

    ``ranked`` (query_text, rank, item_id) is joined by text, so equal texts share one list.
    """
    per = query_diagnostics(ranked, queries, k)
    rank = F.col("rank")
    found = lambda j: F.coalesce((rank <= j).cast("double"), F.lit(0.0))
    cols = [found(j).alias(f"recall@{j}") for j in RECALL_KS]
    cols += [F.when(rank <= j, discount(rank)).otherwise(0.0).alias(f"ndcg@{j}") for j in NDCG_KS]
    cols += [F.when(rank <= MRR_K, F.lit(1.0) / rank).otherwise(0.0).alias("mrr")]
    cols += [found(j).alias(f"hit_rate@{j}") for j in HIT_KS]
    per_query = per.select("query_id", F.col("gt_product_id").alias("first_rank"), *cols)
    extra = {"n_queries": F.count(F.lit(1)), "n_unique_products": F.countDistinct("first_rank")}
    return report(per_query, extra, split)


def query_diagnostics(ranked: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Rank of the true product (null if it is not in the list), hit@10 and hit@50 per query.

    The lists are read as far as they were retrieved, or up to rank ``k``.
    """
    lists = (ranked if k is None else ranked.where(F.col("rank") <= k)).groupBy("query_text", F.col("item_id").alias("product_id")).agg(
        F.min("rank").alias("rank")
    )
    joined = queries.join(lists, ["query_text", "product_id"], "left")
    return joined.select(
        "query_id",
        "query_text",
        F.col("product_id").alias("gt_product_id"),
        "rank",
        F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("hit@10"),
        F.coalesce(F.col("rank") <= 50, F.lit(False)).alias("hit@50"),
    )


def compare_models(reports: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model, one column per chosen metric; absent values are NaN."""
    wide = reports.where(F.col("metric").isin(list(metrics))).groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))
    models = reports.select("model").distinct()
    filled = [F.coalesce(F.col(f"`{m}`"), F.lit(float("nan"))).alias(m) for m in metrics]
    return models.join(wide, "model", "left").select("model", *filled)


def latency_summary(latencies: DataFrame, col: str = "latency_ms", percentiles: Sequence[int] = (50, 95, 99), max_p95_ms: float = 100.0) -> DataFrame:
    """Exact interpolated percentiles, mean, n and the p95 limit check of a latency column."""
    if 95 not in percentiles:
        raise KeyError("percentiles must contain 95")
    whole = latencies.select(F.lit(0).alias("all"), F.col(col).alias("v"))
    wanted = [p / 100 for p in percentiles]
    q = exact_quantiles(whole, "all", "v", wanted).get(0, dict.fromkeys(wanted))
    cols = [F.lit(q[p / 100]).cast("double").alias(f"p{p}_ms") for p in percentiles]
    row = latencies.agg(F.avg(col).alias("mean_ms"), F.count(col).alias("n_queries"))
    return row.select(*cols, "mean_ms", "n_queries", (F.lit(q[0.95]) <= max_p95_ms).alias("pass"))


def ablation_lift(runs: DataFrame, baseline: str) -> DataFrame:
    """recall@10 lift of every run over the baseline run; best by ndcg@10, the first run wins ties.

    ``runs`` (run, run_order, recall_10, ndcg_10).
    """
    base = runs.where(F.col("run") == baseline).agg(F.max("recall_10").alias("b")).scalar()
    others = runs.where(F.col("run") != baseline)
    best = others.agg(F.min_by("run", F.struct(-F.round("ndcg_10", 12), F.col("run_order"))).alias("r")).scalar()
    return runs.select(
        "run", "recall_10", "ndcg_10", (F.col("recall_10") - base).alias("recall_10_lift"), (F.col("run") == best).alias("is_best")
    )
