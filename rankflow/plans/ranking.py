"""H: click features and reranking. O: exposure, diversity and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.functions.hashing import PRIME, SQUARED, permutation_keys
from rankflow.operators import explore as O
from rankflow.operators import rerank as H
from rankflow.plans import views as V
from rankflow.plans.oracle_views import cluster, sql, words
from rankflow.plans.registry import query
from rankflow.plans.views import r6
from rankflow.sources.scratch import materialize

FRAME = ["query_idx", "user_id", "target_product_id", "candidate_product_id", "retrieval_rank"]
# A fixed linear score stands in for the click model where values are compared with SQL.
RERANK = "0.7*historical_global_ctr + 0.3*category_match_binary"


@query(
    "h1_product_features",
    sql("SELECT product_id, category, round(global_ctr,6) AS global_ctr, round(product_popularity,6) AS product_popularity FROM product_features", "product_features"),
)
def h1(spark, sf):
    out = H.product_features(V.split_rows(spark, sf, "train"), V.rich_catalog(spark, sf))
    return out.select("product_id", "category", r6("global_ctr"), r6("product_popularity"))


@query("h2_user_category_affinity", sql("SELECT user_id, category, round(affinity,6) AS affinity FROM affinity", "affinity"))
def h2(spark, sf):
    out = H.user_category_affinity(V.split_rows(spark, sf, "train"), V.rich_catalog(spark, sf))
    return out.select("user_id", "category", r6("affinity"))


@query(
    "h3_candidate_frame",
    sql(
        """SELECT query_idx, user_id, target_product_id, query_category, candidate_product_id, retrieval_rank, similarity_score,
        CAST(label AS INTEGER) AS label FROM candidates WHERE split='test'""",
        "candidates",
    ),
)
def h3(spark, sf):
    return V.candidates(spark, sf, "test").select(*FRAME, "query_category", "similarity_score", "label")


@query(
    "h4_feature_join",
    sql(
        """SELECT query_idx, user_id, target_product_id, candidate_product_id, retrieval_rank, candidate_category, category_match_binary,
        round(historical_global_ctr,6) AS historical_global_ctr, round(user_category_affinity,6) AS user_category_affinity,
        round(product_popularity,6) AS product_popularity FROM features WHERE split='test'""",
        "features",
    ),
)
def h4(spark, sf):
    return V.features(spark, sf, "test").select(
        *FRAME, "candidate_category", "category_match_binary", r6("historical_global_ctr"), r6("user_category_affinity"), r6("product_popularity")
    )


def _network(spark, sf):
    """The click model fitted on all train candidates, stored as a table of weights and read back."""
    model = H.click_model(V.fit_lists(spark, sf))
    rows = spark.createDataFrame(H.ClickNetwork.of_model(model).weight_rows(), H.ClickNetwork.schema())
    return H.ClickNetwork.load(materialize(rows, "click-weights"))


def _clicked(spark, sf):
    """(network, frame): the fitted click model, and the test candidates."""
    return _network(spark, sf), V.features(spark, sf, "test")


@query("h5_click_model")
def h5(spark, sf):
    network, frame = _clicked(spark, sf)
    p = network.batch_probability([F.col(f) for f in H.FEATURES])
    return frame.select("query_idx", "candidate_product_id", "label", F.round(p, 4).alias("p_click"))


def _fixed_network():
    """A network whose weights follow a rule, so that SQL can compute the same probabilities."""
    hidden = tuple((tuple(((7 * u + 3 * f) % 11 - 5) / 10 for f in range(5)), (u % 5 - 2) / 10) for u in range(32))
    return H.ClickNetwork((0.5, 0.2, 0.6, 0.5, 0.4), (2.0, 1.5, 4.0, 3.0, 2.5), hidden, tuple(((5 * u) % 9 - 4) / 10 for u in range(32)), -0.3)


FIXED_SQL = """list_sum(list_transform(range(0, 32), lambda u: ((5 * u) % 9 - 4) / 10.0 / (1 + exp(-((u % 5 - 2) / 10.0
    + ((7 * u) % 11 - 5) / 10.0 * (similarity_score - 0.5) * 2.0 + ((7 * u + 3) % 11 - 5) / 10.0 * (category_match_binary - 0.2) * 1.5
    + ((7 * u + 6) % 11 - 5) / 10.0 * (historical_global_ctr - 0.6) * 4.0 + ((7 * u + 9) % 11 - 5) / 10.0 * (user_category_affinity - 0.5) * 3.0
    + ((7 * u + 12) % 11 - 5) / 10.0 * (product_popularity - 0.4) * 2.5)))))"""


@query(
    "h5_click_probability",
    sql(f"SELECT query_idx, candidate_product_id, round(1 / (1 + exp(0.3 - {FIXED_SQL})), 6) AS p_click FROM features WHERE split='test'", "features"),
)
def h5_fixed(spark, sf):
    """The forward pass over a stored weight table, for weights that SQL knows too."""
    rows = spark.createDataFrame(_fixed_network().weight_rows(), H.ClickNetwork.schema())
    network = H.ClickNetwork.load(materialize(rows, "click-weights"))
    p = network.batch_probability([F.col(f) for f in H.FEATURES])
    return V.features(spark, sf, "test").select("query_idx", "candidate_product_id", F.round(p, 6).alias("p_click"))


def _rerank(c):
    return F.round(0.7 * c["historical_global_ctr"] + 0.3 * c["category_match_binary"], 9)


@query(
    "h6_ordered_lists",
    sql(
        f"""SELECT query_idx, candidate_product_id, CAST(row_number() OVER (PARTITION BY query_idx ORDER BY round({RERANK},9) DESC, retrieval_rank) AS INTEGER) AS rank
        FROM features WHERE split='test'""",
        "features",
    ),
)
def h6(spark, sf):
    return H.reordered(V.packed_requests(spark, sf, "test"), _rerank)


COMPARE_SQL = f"""SELECT count(*) AS n_queries, round(avg(bn),6) AS baseline_ndcg, round(avg(bm),6) AS baseline_mrr, round(avg(rn),6) AS reranked_ndcg,
      round(avg(rm),6) AS reranked_mrr, round((avg(rn)-avg(bn))/greatest(avg(bn),1e-12)*100,6) AS ndcg_lift_percent,
      round((avg(rm)-avg(bm))/greatest(avg(bm),1e-12)*100,6) AS mrr_lift_percent FROM (
      SELECT query_idx, coalesce(sum(CASE WHEN label=1 AND b<=10 THEN 1/log2(b+1) END),0.0) AS bn, coalesce(sum(CASE WHEN label=1 AND b<=10 THEN 1.0/b END),0.0) AS bm,
        coalesce(sum(CASE WHEN label=1 AND r<=10 THEN 1/log2(r+1) END),0.0) AS rn, coalesce(sum(CASE WHEN label=1 AND r<=10 THEN 1.0/r END),0.0) AS rm
      FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY similarity_score DESC, retrieval_rank) AS b,
        row_number() OVER (PARTITION BY query_idx ORDER BY round({RERANK},9) DESC, retrieval_rank) AS r FROM features WHERE split='test') GROUP BY 1)"""


@query("h7_baseline_vs_reranked", sql(COMPARE_SQL, "features"))
def h7(spark, sf):
    row = H.compare_lists(V.packed_requests(spark, sf, "test"), lambda c: c["similarity_score"], _rerank, 10)
    return row.select("n_queries", *[r6(c) for c in row.columns if c != "n_queries"])


@query("h8_permutation_importance")
def h8(spark, sf):
    network, frame = _clicked(spark, sf)
    return H.permutation_importance(frame, network.batch_probability, repeats=5)


LINEAR = [0.5, 0.3, 0.7, 0.4, 0.2]


def _shuffle_sql(repeats: int, seed: int) -> str:
    """rows(no, features, label), and per repeat the number of the row whose features are taken."""
    values = ", ".join(H.FEATURES)

    def rounds(source: str, key: str) -> str:
        for r, (factor, shift) in enumerate(zip(*permutation_keys(key))):
            other, own, size = ("y", "x", "w") if r % 2 == 0 else ("x", "y", "h")
            hashed = f"({other} * {factor} + {shift}) % {PRIME}"
            if r in SQUARED:
                hashed = f"(({hashed}) * ({hashed})) % {PRIME}"
            source = f"(SELECT * REPLACE (({own} + {hashed}) % {size} AS {own}) FROM {source})"
        return source

    parts = []
    for i in range(repeats):
        key = f"{seed}/{i}"
        walk = "(SELECT no, no AS loc, false AS done FROM rows)"
        for _ in range(6):  # a number is outside with a chance below 1 / sqrt(n) each time
            start = f"(SELECT no, loc, done, loc % w AS x, loc // w AS y, w, h, n FROM {walk}, size)"
            walk = f"(SELECT no, CASE WHEN done THEN loc ELSE y * w + x END AS loc, done OR y * w + x < n AS done FROM {rounds(start, key)})"
        parts.append(f"SELECT {i} AS repeat, no, loc FROM {walk}")
    return f"""rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY query_idx, retrieval_rank) - 1 AS no, {values}, label FROM features WHERE split='test'),
      size AS (SELECT n, w, (n + w - 1) // w AS h FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS w FROM (SELECT count(*) AS n FROM rows))),
      turned AS MATERIALIZED ({' UNION ALL '.join(parts)})"""


def _importance_sql(repeats: int, seed: int) -> str:
    def linear(source: dict) -> str:
        return "round(" + " + ".join(f"{w} * {source.get(f, 'a.' + f)}" for w, f in zip(LINEAR, H.FEATURES)) + ", 9)"

    variants = ["SELECT -1 AS place, -1 AS repeat, label, " + linear({}) + " AS score FROM rows a"]
    variants += [
        f"SELECT {p} AS place, repeat, a.label, {linear({f: 'b.' + f})} AS score FROM rows a JOIN turned t ON t.no = a.no JOIN rows b ON b.no = t.loc"
        for p, f in enumerate(H.FEATURES)
    ]
    names = "[" + ", ".join(f"'{f}'" for f in H.FEATURES) + "]"
    body = f""", {_shuffle_sql(repeats, seed)},
      cells AS (SELECT place, repeat, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM ({' UNION ALL '.join(variants)}) GROUP BY 1,2,3),
      areas AS (SELECT place, repeat, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY place, repeat ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cells) GROUP BY 1,2)
      SELECT {names}[place + 1] AS feature, round(avg(f.auc - a.auc), 6) AS importance_mean, round(stddev_pop(f.auc - a.auc), 6) AS importance_std
      FROM areas a, (SELECT auc FROM areas WHERE place < 0) f WHERE place >= 0 GROUP BY place"""
    return sql("@", "features").replace("\n@", body)


@query("h8_permutation_importance_linear", _importance_sql(2, 42))
def h8_linear(spark, sf):
    """The same shuffles and areas for a fixed linear score, which SQL can follow."""

    def score(x):
        total = F.lit(0.0)
        for w, c in zip(LINEAR, x):
            total = total + F.lit(w) * c
        return F.round(total, 9)

    out = H.permutation_importance(V.features(spark, sf, "test"), score, repeats=2, seed=42)
    return out.select("feature", r6("importance_mean"), r6("importance_std"))


@query(
    "h9_correlation_importance",
    sql(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(CASE WHEN stddev_pop({f}) < 1e-12 THEN 0 ELSE coalesce(abs(corr({f}, label)),0) END,6)::DOUBLE AS importance_mean, 0.0::DOUBLE AS importance_std FROM features WHERE split='test'"
            for f in H.FEATURES
        ),
        "features",
    ),
)
def h9(spark, sf):
    out = H.correlation_importance(V.features(spark, sf, "test"))
    return out.select("feature", r6("importance_mean"), "importance_std")


SERVED = ["train", "val", "test"]
# Base order is retrieval order, so a request shows the first rows of its text's list.
SHOWN_SQL = f""", served AS MATERIALIZED (SELECT r.split, list_position({SERVED}, r.split) AS o, r.query_idx, r.query_text, {cluster('q.query_text')} AS query_cluster_id
    FROM requests r JOIN rich_queries q USING (product_id)),
  seqs AS (SELECT *, row_number() OVER (PARTITION BY query_cluster_id ORDER BY o, query_idx) AS seq FROM served),
  heads AS MATERIALIZED (SELECT query_text, item_id FROM title_candidates WHERE rank <= 10)"""


def _exposure_sql(splits: int, select: str) -> str:
    """The store after the first splits have been served in order."""
    store = f""", stored AS (SELECT * FROM seqs WHERE o <= {splits}),
      expo AS MATERIALIZED (SELECT query_cluster_id, item_id AS product_id, sum(pow(0.99, t - seq)) AS exposure FROM stored
        JOIN (SELECT query_cluster_id, max(seq) AS t FROM stored GROUP BY 1) m USING (query_cluster_id) JOIN heads USING (query_text) GROUP BY 1,2)"""
    return sql("@", "requests", "rich_queries", "title_candidates").replace("\n@", SHOWN_SQL + store + "\n" + select)


def _store(spark, sf, *names):
    """The store after these splits were served in order, each request the first rows of its text's list."""
    asked = V.explore_requests(spark, sf, *SERVED).where(F.col("split").isin(list(names)))
    seq = O.cluster_sequence(asked.select("split", "query_idx", "query_cluster_id", "query_text"), "seq", SERVED)
    heads = O.diversity_cap(O.base_ranked(V.scored_texts(spark, sf, *SERVED), ["query_text"]), 10, 2**31 - 1, ["query_text"])
    last = asked.groupBy("query_cluster_id").agg(F.count(F.lit(1)).alias("last"))
    return O.decayed_sum(seq.join(heads.select("query_text", "candidate_product_id"), "query_text"), last, 0.99)


@query("o1_exposure", _exposure_sql(3, "SELECT query_cluster_id, product_id, round(exposure,6) AS exposure FROM expo"))
def o1(spark, sf):
    """The store after train, val and test have been served in this order."""
    return _store(spark, sf, *SERVED).select("query_cluster_id", "product_id", r6("exposure"))


@query(
    "o2_novelty_bonus",
    _exposure_sql(
        2,
        """SELECT s.query_idx, t.item_id AS candidate_product_id, round(1/sqrt(1+coalesce(exposure,0)),6) AS novelty_bonus
        FROM served s JOIN title_candidates t USING (query_text) LEFT JOIN expo e ON e.query_cluster_id = s.query_cluster_id AND e.product_id = t.item_id WHERE s.o = 3""",
    ),
)
def o2(spark, sf):
    """The test candidates against the store that train and val have left."""
    asked = V.explore_requests(spark, sf, *SERVED).where("split = 'test'")
    # A bonus depends on (cluster, product), so it is looked up once per cluster and text.
    keys = ["query_cluster_id", "query_text"]
    texts = V.scored_texts(spark, sf, *SERVED).select("query_text", "candidate_product_id")
    frame = asked.select(*keys).distinct().join(texts, "query_text")
    known = materialize(O.with_novelty(frame, _store(spark, sf, "train", "val")), "novelty")
    return asked.join(known, keys).select("query_idx", "candidate_product_id", r6("novelty_bonus"))


@query(
    "o3_diversity_cap",
    sql(
        """SELECT query_idx, candidate_product_id, candidate_category, CAST(row_number() OVER (PARTITION BY query_idx ORDER BY skip, base_rank) AS INTEGER) AS final_rank FROM (
          SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_idx, candidate_category ORDER BY base_rank) > 2 THEN 1 ELSE 0 END AS skip FROM base_ranked) QUALIFY final_rank <= 10""",
        "base_ranked",
    ),
)
def o3(spark, sf):
    # Base order is by similarity, which the text alone decides: lists are capped once per text.
    top = O.diversity_cap(O.base_ranked(V.scored_texts(spark, sf, "test"), ["query_text"]), 10, 2, ["query_text"])
    asked = V.explore_requests(spark, sf, "test").select("query_idx", "query_text")
    return asked.join(top, "query_text").select("query_idx", "candidate_product_id", "candidate_category", "final_rank")


EXPLOIT = O.ExploreConfig(epsilon=0.0, alpha=0.05, broad_entropy_threshold=V.BROAD_ENTROPY)


def _exploited(spark, sf):
    asked = V.explore_requests(spark, sf, "test").select("query_idx", "query_text", "rich_text", "query_cluster_entropy", F.col("product_id").alias("target_product_id"))
    return O.exploit_lists(asked, V.scored_texts(spark, sf, "test"), EXPLOIT)


@query("o4_explore_exploit_epsilon0", sql("SELECT query_idx, candidate_product_id, CAST(final_rank AS INTEGER) AS final_rank, 0 AS did_explore FROM capped_topk", "capped_topk"))
def o4_zero(spark, sf):
    return _exploited(spark, sf).select("query_idx", "candidate_product_id", "final_rank", "did_explore")


def _asked(spark, sf, *names):
    """(requests, texts): the base score, min-max of similarity over all of them, depends on the text only."""
    names_of = {"query_text": "list_key", "rich_text": "query_text", "product_id": "target_product_id"}
    columns = ["split", "query_idx", "query_cluster_id", "query_cluster_entropy", *names_of]
    asked = V.explore_requests(spark, sf, *names).select(*[F.col(c).alias(names_of.get(c, c)) for c in columns])
    return asked, O.pack_texts(V.scored_texts(spark, sf, *names))


def _explored(spark, sf, cfg):
    """All three splits served in order with one store; the rows shown for every query."""
    asked, texts = _asked(spark, sf, *SERVED)
    rows = O.shown_rows(O.explore_packed(asked, [cfg], 42, SERVED, texts))
    return rows.select("split", "query_idx", "candidate_product_id", "final_rank", "did_explore")


@query("o4_explore_exploit")
def o4(spark, sf):
    return _explored(spark, sf, O.ExploreConfig(epsilon=0.2, alpha=0.1, top_pool_k=20, broad_entropy_threshold=V.BROAD_ENTROPY))


DRAW_SQL = "CAST('0x' || substr(md5('42:' || CAST(query_idx AS VARCHAR)),1,13) AS BIGINT) / 4503599627370496.0"
# Every query of the three splits with its list capped; the walk only needs the first rows of a category.
CAPPED_SQL = f""", asked AS MATERIALIZED (SELECT r.split, r.query_idx, r.query_text, coalesce(e.entropy, 0.0) >= 2.2 OR len({words('q.query_text')}) < 3 AS broad
    FROM requests r JOIN rich_queries q USING (product_id) LEFT JOIN cluster_entropy e ON e.query_cluster_id = {cluster('q.query_text')}),
  ranked AS (SELECT t.query_text, t.rank, t.item_id, row_number() OVER (PARTITION BY t.query_text, c.category_id ORDER BY t.rank) AS n_cat FROM title_candidates t
    LEFT JOIN catalog c ON c.product_id = t.item_id),
  lists AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY CAST(n_cat > 3 AS INTEGER), rank) AS capped_rank FROM ranked)"""


def _capped_sql(select: str) -> str:
    return sql("@", "requests", "rich_queries", "title_candidates", "cluster_entropy", "catalog").replace("\n@", CAPPED_SQL + "\n" + select)


@query(
    "o4_explore_exploit_alpha0",
    _capped_sql(
        f"""SELECT split, query_idx, item_id AS candidate_product_id, CAST(CASE WHEN broad THEN capped_rank ELSE rank END AS INTEGER) AS final_rank,
        CAST({DRAW_SQL} < 0.3 AS INTEGER) AS did_explore FROM asked JOIN lists USING (query_text) WHERE CASE WHEN broad THEN capped_rank ELSE rank END <= 10"""
    ),
)
def o4_alpha0(spark, sf):
    """Without a bonus an exploring query goes the whole way of the store and must still show the capped list."""
    return _explored(spark, sf, O.ExploreConfig(epsilon=0.3, alpha=0.0, broad_entropy_threshold=V.BROAD_ENTROPY))


@query("o5_base_score", sql("SELECT query_idx, candidate_product_id, round(base_score,6) AS base_score FROM explore_frame", "explore_frame"))
def o5(spark, sf):
    texts = V.scored_texts(spark, sf, "test").select("query_text", "candidate_product_id", r6("base_score"))
    asked = V.explore_requests(spark, sf, "test").select("query_idx", "query_text")
    return asked.join(texts, "query_text").select("query_idx", "candidate_product_id", "base_score")


@query(
    "o6_baseline_topk",
    sql("SELECT query_idx, candidate_product_id, CAST(final_rank AS INTEGER) AS final_rank FROM baseline_topk", "baseline_topk"),
)
def o6(spark, sf):
    top = O.baseline_topk(V.scored_texts(spark, sf, "test"), 10, ["query_text"])
    asked = V.explore_requests(spark, sf, "test").select("query_idx", "query_text")
    return asked.join(top, "query_text").select("query_idx", "candidate_product_id", "final_rank")


def topk_figures(source: str) -> str:
    return f"""SELECT (SELECT count(DISTINCT query_idx) FROM {source}) AS n_queries,
      round((SELECT avg(v) FROM (SELECT query_idx, sum(CASE WHEN candidate_product_id = target_product_id THEN 1/log2(final_rank+1) ELSE 0.0 END) AS v FROM {source} GROUP BY 1)),6) AS ndcg,
      round((SELECT avg(v) FROM (SELECT query_idx, coalesce(1.0/min(CASE WHEN candidate_product_id = target_product_id THEN final_rank END),0.0) AS v FROM {source} GROUP BY 1)),6) AS mrr,
      round((SELECT count(DISTINCT candidate_product_id) FROM {source}) / (SELECT count(*) FROM catalog),6) AS coverage,
      round((SELECT avg(CASE WHEN n <= (SELECT quantile_cont(n,0.2) FROM popularity) THEN 1.0 ELSE 0.0 END) FROM {source} s LEFT JOIN popularity p ON p.product_id = s.candidate_product_id),6) AS long_tail,
      round((SELECT avg(e) FROM (SELECT query_idx, greatest(-sum(p*log2(p)),0) AS e FROM (SELECT query_idx, n / sum(n) OVER (PARTITION BY query_idx) AS p FROM (
         SELECT query_idx, candidate_category, count(*) AS n FROM {source} GROUP BY 1,2)) GROUP BY 1)),6) AS category_entropy"""


def _figures(df, *keys):
    return df.select(*keys, *[r6(c) for c in ("ndcg", "mrr", "coverage", "long_tail", "category_entropy")])


@query("o7_topk_evaluation", sql(topk_figures("capped_topk"), "capped_topk", "catalog", "popularity"))
def o7(spark, sf):
    return _figures(O.evaluate_topk(_exploited(spark, sf), V.rich_catalog(spark, sf), V.popularity(spark, sf), 10), "n_queries")


SWEEP = [
    O.ExploreConfig(epsilon=e, alpha=a, broad_entropy_threshold=V.BROAD_ENTROPY)
    for e in (0.0, 0.01, 0.05, 0.1)
    for a in (0.01, 0.05, 0.1)
]


@query("o8_parameter_sweep")
def o8(spark, sf):
    """The full grid over train, val and test, with click probability as the base score."""
    asked, texts = V.explore_texts(spark, sf, *SERVED)
    score = H.text_scores(_network(spark, sf))
    return O.sweep(asked, SWEEP, V.rich_catalog(spark, sf), V.popularity(spark, sf), texts=texts, score=score)


@query(
    "o8_sweep_epsilon0",
    sql(
        f"""SELECT s.*, round(s.ndcg - b.ndcg,5) AS delta_ndcg FROM (
          SELECT 2 AS max_per_category, * FROM ({topk_figures('cap2')}) UNION ALL SELECT 3, * FROM ({topk_figures('cap3')})) s, ({topk_figures('baseline_topk')}) b""",
        "base_ranked", "baseline_topk", "catalog", "popularity",
    ).replace(
        "\nSELECT s.*",
        ",\n"
        + ",\n".join(
            f"""cap{c} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY skip, base_rank) AS final_rank FROM (
          SELECT *, CASE WHEN query_cluster_entropy >= 2.2 AND row_number() OVER (PARTITION BY query_idx, candidate_category ORDER BY base_rank) > {c}
            THEN 1 ELSE 0 END AS skip FROM base_ranked)) WHERE final_rank <= 10)"""
            for c in (2, 3)
        )
        + "\nSELECT s.*",
    ),
)
def o8_zero(spark, sf):
    """The sweep's epsilon 0 slice for two caps on the test split, through the same code as O8."""
    asked, texts = _asked(spark, sf, "test")
    grid = [O.ExploreConfig(epsilon=0.0, max_per_category=c, broad_entropy_threshold=V.BROAD_ENTROPY) for c in (2, 3)]
    out = O.sweep(asked, grid, V.rich_catalog(spark, sf), V.popularity(spark, sf), split_order=["val", "test"], texts=texts)
    n = V.explore_requests(spark, sf, "test").agg(F.count(F.lit(1)).alias("n")).scalar()
    row = out.withColumn("n_queries", n)
    names = ("ndcg", "mrr", "coverage", "long_tail", "category_entropy")
    # The delta of rounded figures, as the SQL has it.
    delta = F.round(F.round("test_ndcg", 6) - F.round(F.col("test_ndcg") - F.col("delta_ndcg"), 6), 5)
    return row.select("max_per_category", "n_queries", delta.alias("delta_ndcg"), *[r6(f"test_{n}", n) for n in names])
