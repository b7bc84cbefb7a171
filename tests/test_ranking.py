"""Reranking and exploration: known answers and a step-by-step store as brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankflow.operators import explore as O
from rankflow.operators import rerank as H


def test_product_features_and_affinity(spark):
    # Scores 3, 3, 1 of the lamp, 5 of the rug, 2 and 4 of the vase; the shelf was never rated.
    rated = [("ann", "lamp", 0, 3), ("bo", "lamp", 1, 3), ("cy", "lamp", 0, 1), ("ann", "rug", 1, 5), ("bo", "vase", 0, 2), ("dee", "vase", 1, 4)]
    inter = spark.createDataFrame(rated, "user_id string, product_id string, label int, score int")
    cat = spark.createDataFrame([("lamp", "light"), ("rug", "floor"), ("vase", "decor"), ("shelf", None)], "product_id string, category string")
    f = {r["product_id"]: r for r in H.product_features(inter, cat, ctr_smoothing=4.0).collect()}
    means = {"lamp": (0.5 + 0.5 + 0.0) / 3, "rug": 1.0, "vase": (0.25 + 0.75) / 2}
    prior = sum(means.values()) / 3
    for name, n in (("lamp", 3), ("rug", 1), ("vase", 2)):
        assert f[name]["global_ctr"] == pytest.approx((means[name] * n + 4 * prior) / (n + 4))
        assert f[name]["product_popularity"] == pytest.approx(math.log(1 + n) / math.log(4))
    assert f["shelf"]["global_ctr"] == pytest.approx(prior) and f["shelf"]["product_popularity"] == 0.0
    assert f["shelf"]["category"] == "unknown"
    a = {(r["user_id"], r["category"]): r["affinity"] for r in H.user_category_affinity(inter, cat, smoothing=2.0).collect()}
    assert a[("ann", "light")] == pytest.approx((0 + 2 * 0.5) / 3) and a[("dee", "decor")] == pytest.approx((1 + 2 * 0.5) / 3)
    with pytest.raises(ValueError):
        H.product_features(inter.drop("product_id"), cat)


def shop(spark):
    """Three requests over two texts: the wanted tent is third of its list, the wanted boots second, the kayak is not listed."""
    req = spark.createDataFrame(
        [(7, "kim", "tent", "camp", "shelter"), (8, "lou", "boots", "walk", "leather"), (9, "kim", "kayak", "water", "leather")],
        "query_idx long, user_id string, product_id string, category string, query_text string",
    )
    top = [("shelter", 1, "tarp", 0.71), ("shelter", 2, "boots", 0.64), ("shelter", 3, "tent", 0.32), ("leather", 1, "stove", 0.45), ("leather", 2, "boots", 0.41)]
    top = spark.createDataFrame([*top, ("leather", 3, None, 0.4), ("unasked", 1, "tarp", 0.9)], "query_text string, rank int, item_id string, score double")
    feats = spark.createDataFrame(
        [("tent", "camp", 0.62, 0.33), ("tarp", "camp", 0.21, 0.9), ("boots", "walk", 0.55, 0.12)],
        "product_id string, category string, global_ctr double, product_popularity double",
    )
    taste = spark.createDataFrame([("kim", "camp", 0.4), ("kim", "walk", 0.1), ("max", "walk", 0.9)], "user_id string, category string, affinity double")
    return req, top, feats, taste


def test_rerank_beats_similarity(spark):
    req, top, feats, taste = shop(spark)
    frame = H.add_features(H.candidate_frame(req, top), feats, taste)
    frame = frame.withColumn("p", 0.5 * F.col("historical_global_ctr") + 0.2 * F.col("category_match_binary"))
    row = H.compare_rankings(frame, "similarity_score", "p", 3).collect()[0]
    # By similarity the targets come third and second; reranked both are first, and the kayak is never found.
    assert row["n_queries"] == 3 and row["baseline_mrr"] == pytest.approx((1 / 3 + 1 / 2) / 3) and row["reranked_mrr"] == pytest.approx(2 / 3)
    assert row["baseline_ndcg"] == pytest.approx((1 / 2 + 1 / math.log2(3)) / 3) and row["reranked_ndcg"] == pytest.approx(2 / 3)
    assert row["mrr_lift_percent"] == pytest.approx(140.0)
    lists = H.ordered_lists(frame, "p").where("query_idx < 9").orderBy("query_idx", "rank").collect()
    assert [r["candidate_product_id"] for r in lists] == ["tent", "tarp", "boots", "boots", "stove"]
    imp = {r["feature"]: r["importance_mean"] for r in H.correlation_importance(frame).collect()}
    assert 0 <= min(imp.values()) and max(imp.values()) <= 1


def test_packed_requests_equal_joined_rows(spark):
    """One row per request says the same as a row per candidate."""
    req, top, feats, taste = shop(spark)
    rows = H.add_features(H.candidate_frame(req, top), feats, taste)
    packed = H.pack_requests(req, H.candidate_lists(top, feats), taste)
    assert packed.count() == 3
    names = sorted(rows.columns)
    assert sorted(map(str, H.unpack(packed).select(*names).collect())) == sorted(map(str, rows.select(*names).collect()))

    def score(c):
        return 0.5 * c["historical_global_ctr"] + 0.2 * c["category_match_binary"]

    a = H.compare_lists(packed, lambda c: c["similarity_score"], score, 3).collect()[0]
    b = H.compare_rankings(rows.withColumn("p", score(rows)), "similarity_score", "p", 3).collect()[0]
    assert a.asDict() == pytest.approx(b.asDict())


def random_frame(rng, n_queries, n_clusters, n_items, n_candidates, hot=0.5):
    rows = []
    for q in range(n_queries):
        c = "hot" if rng.random() < hot else f"c{rng.randrange(n_clusters)}"
        text = rng.choice(["one two", "one two three"])
        ent = {"hot": 1.5}.get(c, 0.5)
        items = rng.sample(range(n_items), rng.randint(1, n_candidates))
        for r, i in enumerate(items):
            rows.append((q, c, ent, text, i, f"cat{i % 4}", r + 1, round(rng.random(), 2), rng.randrange(n_items)))
    return rows


SCHEMA = (
    "query_idx long, query_cluster_id string, query_cluster_entropy double, query_text string, candidate_product_id long, "
    "candidate_category string, retrieval_rank int, base_score double, target_product_id long"
)


def step_by_step(rows, cfg, draws, store=None):
    """Serve the queries one after the other with a mutable store, as plain Python."""
    store = {} if store is None else store
    by_query = {}
    for r in rows:
        by_query.setdefault(r[0], []).append(r)
    shown = {}
    for q in sorted(by_query):
        cand = sorted(by_query[q], key=lambda r: (-r[7], r[6], r[4]))
        c, ent, text = cand[0][1], cand[0][2], cand[0][3]
        pool, rest = cand[: cfg.top_pool_k], cand[cfg.top_pool_k :]
        if draws[q] < cfg.epsilon:
            pool = sorted(pool, key=lambda r: -(r[7] + cfg.alpha / (1 + store.get((c, r[4]), 0.0)) ** 0.5))
        ranked = pool + rest
        if ent >= cfg.broad_entropy_threshold or len(text.split()) < 3:
            n, kept, skipped = {}, [], []
            for r in ranked:
                n[r[5]] = n.get(r[5], 0) + 1
                (kept if n[r[5]] <= cfg.max_per_category else skipped).append(r)
            ranked = kept + skipped
        top = [r[4] for r in ranked[: cfg.eval_k]]
        for key in [k for k in store if k[0] == c]:
            store[key] *= cfg.exposure_decay
        for i in top:
            store[(c, i)] = store.get((c, i), 0.0) + 1.0
        shown[q] = top
    return shown, store


def served(df, setting=None):
    out = {}
    rows = df.collect()
    for r in sorted(rows, key=lambda r: r["final_rank"]):
        if setting is None or r["setting_id"] == setting:
            out.setdefault(r["query_idx"], []).append(r["candidate_product_id"])
    return out


def draws_of(spark, n, seed):
    from rankflow.functions.hashing import seeded_uniform

    df = spark.range(n).select(F.col("id"), seeded_uniform(seed, F.col("id")).alias("u"))
    return {r["id"]: r["u"] for r in df.collect()}


def test_explore_exploit_equals_step_by_step_store(spark, monkeypatch):
    # Small buckets and chunks, so that every query sequence crosses several of them.
    monkeypatch.setattr(O, "SEQUENCE_BUCKET", 16)
    monkeypatch.setattr(O, "CHUNK", 8)
    rng = random.Random(11)
    rows = random_frame(rng, 160, 3, 25, 12)
    frame = spark.createDataFrame(rows, SCHEMA)
    settings = [
        O.ExploreConfig(epsilon=0.4, alpha=0.8, top_pool_k=6, eval_k=4, max_per_category=1, exposure_decay=0.5),
        O.ExploreConfig(epsilon=0.4, alpha=0.8, top_pool_k=6, eval_k=4, max_per_category=1, exposure_decay=1.0),
        O.ExploreConfig(epsilon=1.0, alpha=0.5, top_pool_k=20, eval_k=3, max_per_category=2, exposure_decay=0.9),
        O.ExploreConfig(epsilon=0.0, alpha=0.5, top_pool_k=5, eval_k=4, max_per_category=1, exposure_decay=0.99),
        O.ExploreConfig(epsilon=0.4, alpha=0.8, top_pool_k=6, eval_k=4, max_per_category=1, exposure_decay=0.0),
        O.ExploreConfig(epsilon=0.4, alpha=0.8, top_pool_k=6, eval_k=4, max_per_category=1, exposure_decay=0.999999),
        O.ExploreConfig(epsilon=0.4, alpha=0.8, top_pool_k=6, eval_k=4, max_per_category=1, exposure_decay=1e-200),
    ]
    with pytest.raises(ValueError):
        O.explore_exploit(frame, [O.ExploreConfig(exposure_decay=1.5)])
    got = O.explore_exploit(frame, settings, seed=7)
    draws = draws_of(spark, 160, 7)
    rows_out = got.select("setting_id", "query_idx", "candidate_product_id", "final_rank").cache()
    for i, cfg in enumerate(settings):
        want, _ = step_by_step(rows, cfg, draws)
        assert served(rows_out, i) == want, cfg
    zero = served(O.exploit_only(frame, settings[3]))
    assert zero == served(rows_out, 3)


def test_lists_made_once_per_text_equal_lists_per_query(spark):
    """Queries that share a text's candidates: the same rows as with a packed list per query; an item may be listed twice."""
    rng = random.Random(21)
    lists = {t: [(r % 9, f"cat{r % 3}", r + 1, round(rng.random(), 2)) for r in rng.sample(range(14), 11)] for t in ("a", "b", "c")}
    texts, rows = [(t, *c) for t, cs in lists.items() for c in cs], []
    for q in range(90):
        t, cluster = rng.choice("abc"), rng.choice(["u", "v"])
        rows.append((q, cluster, {"u": 1.5, "v": 0.2}[cluster], rng.choice(["one", "one two three"]), t, rng.randrange(9)))
    asked = spark.createDataFrame(rows, "query_idx long, query_cluster_id string, query_cluster_entropy double, query_text string, list_key string, target_product_id long")
    fields = "candidate_product_id long, candidate_category string, retrieval_rank int, base_score double"
    scored = spark.createDataFrame(texts, f"list_key string, {fields}")
    settings = [
        O.ExploreConfig(epsilon=0.5, alpha=0.9, top_pool_k=5, eval_k=4, max_per_category=1),
        O.ExploreConfig(epsilon=0.3, alpha=0.4, top_pool_k=7, eval_k=3, max_per_category=2, exposure_decay=0.5),
        O.ExploreConfig(epsilon=0.0, eval_k=4, max_per_category=1),
    ]
    got = O.explore_packed(asked, settings, 3, texts=O.pack_texts(scored, "list_key"))
    want = O.explore_packed(O.pack_candidates(asked.join(scored, "list_key")), settings, 3)
    names = ["query_idx", "query_cluster_id", "target_product_id", "setting_id", "did_explore", "shown"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    assert got.count() == 270 and got.agg(F.sum("did_explore")).first()[0] > 20


def test_store_is_carried_over_splits(spark):
    rng = random.Random(2)
    first, second = random_frame(rng, 30, 2, 15, 8), random_frame(rng, 30, 2, 15, 8)
    cfg = O.ExploreConfig(epsilon=0.5, alpha=1.0, top_pool_k=6, eval_k=3, max_per_category=1, exposure_decay=0.9)
    draws = draws_of(spark, 30, 42)
    want1, store = step_by_step(first, cfg, draws)
    want2, _ = step_by_step(second, cfg, draws, store)
    both = spark.createDataFrame(first, SCHEMA).withColumn("split", F.lit("train")).unionByName(
        spark.createDataFrame(second, SCHEMA).withColumn("split", F.lit("val"))
    )
    got = O.explore_exploit(both, [cfg], 42, ["train", "val"]).cache()
    assert served(got.where("split = 'train'")) == want1
    assert served(got.where("split = 'val'")) == want2


def test_exposure_equals_step_by_step_store(spark, monkeypatch):
    monkeypatch.setattr(O, "SEQUENCE_BUCKET", 8)
    rng = random.Random(4)
    cfg = O.ExploreConfig(epsilon=0.0, eval_k=3, max_per_category=1, exposure_decay=0.9)
    rows = random_frame(rng, 60, 3, 12, 6)
    _, store = step_by_step(rows, cfg, {q: 1.0 for q in range(60)})
    got = O.exposure(O.exploit_only(spark.createDataFrame(rows, SCHEMA), cfg), 0.9, 3)
    have = {(r["query_cluster_id"], r["product_id"]): r["exposure"] for r in got.collect()}
    assert have.keys() == store.keys()
    for k, v in store.items():
        assert have[k] == pytest.approx(v)


def test_known_exploration_case(spark):
    # Three queries of one cluster with the same five items: what was shown falls back until its bonus is back.
    score = {31: 0.9, 32: 0.8, 33: 0.35, 34: 0.3, 35: 0.1}
    rows = [(q, "garden", 0.2, "hose and reel", i, f"kind{i}", r, s, 31) for q in (4, 5, 6) for r, (i, s) in enumerate(score.items(), 1)]
    cfg = O.ExploreConfig(epsilon=1.0, alpha=2.0, top_pool_k=4, eval_k=2, max_per_category=2, exposure_decay=1.0)
    got = served(O.explore_exploit(spark.createDataFrame(rows, SCHEMA), [cfg]))
    # Unseen: score + 2. Shown once: score + 2 / sqrt(2) = score + 1.414. The fifth item is outside the pool.
    assert got == {4: [31, 32], 5: [33, 31], 6: [34, 32]}


def test_sweep_reports_every_setting_and_one_best(spark):
    rng = random.Random(9)
    parts = [
        spark.createDataFrame(random_frame(rng, 25, 2, 15, 8), SCHEMA).withColumn("split", F.lit(s)) for s in ("train", "val", "test")
    ]
    frame = parts[0].unionByName(parts[1]).unionByName(parts[2])
    grid = [O.ExploreConfig(epsilon=e, alpha=0.5, top_pool_k=6, eval_k=4, max_per_category=2) for e in (0.0, 0.5)]
    cat = spark.range(15).select(F.col("id").alias("product_id"))
    pop = cat.withColumn("n", F.col("product_id") + 1)
    rows = O.sweep(O.pack_candidates(frame), grid, cat, pop).collect()
    assert len(rows) == 2 and sum(r["is_best"] for r in rows) == 1
    best = max(rows, key=lambda r: (r["test_coverage"], r["test_ndcg"]))
    assert best["is_best"]
    one = O.evaluate_topk(O.explore_exploit(frame, grid, 42, ["train", "val", "test"]).where("split = 'test' AND setting_id = 1"), cat, pop, 4).collect()[0]
    row = next(r for r in rows if r["setting_id"] == 1)
    for name in ("ndcg", "mrr", "coverage", "long_tail", "category_entropy"):
        assert row[f"test_{name}"] == pytest.approx(one[name])


def click_frame(spark, n=300):
    rng = random.Random(1)
    rows = []
    for q in range(n):
        x = rng.random()
        rows.append((q, 1, 1, x, float(rng.random() < 0.5), rng.random(), 0.25, rng.random(), int(x > 0.5)))
    schema = "query_idx long, candidate_product_id long, retrieval_rank int, " + ", ".join(f"{f} double" for f in H.FEATURES) + ", label int"
    return spark.createDataFrame(rows, schema)


def test_click_model_learns_and_importance_finds_the_feature(spark):
    frame = click_frame(spark)
    model = H.click_model(frame, hidden=8, max_iter=50)
    p = H.click_probability(model, frame)
    r = p.agg(F.min("rerank_probability").alias("a"), F.max("rerank_probability").alias("b"), F.corr("rerank_probability", "label").alias("c")).collect()[0]
    assert 0 <= r["a"] <= r["b"] <= 1 and r["c"] > 0.7
    imp = H.permutation_importance(frame, H.ClickNetwork.of_model(model).batch_probability, repeats=2).collect()
    assert imp[0]["feature"] == "similarity_score" and imp[0]["importance_mean"] > 0.2


def test_click_network_equals_the_fitted_model(spark):
    """The stored weights, as expression, as batches and over packed lists, give the library's own probabilities."""
    from pyspark.ml.functions import vector_to_array

    frame = click_frame(spark, 80)
    model = H.click_model(frame, hidden=5, max_iter=15)
    net = H.ClickNetwork.of_model(model)
    stored = spark.createDataFrame(net.weight_rows(), H.ClickNetwork.schema())
    assert H.ClickNetwork.load(stored) == net
    x = [F.col(f) for f in H.FEATURES]
    want = model.transform(frame).select("query_idx", *H.FEATURES, vector_to_array("probability")[1].alias("p"))
    got = want.select("*", net.probability(x).alias("a"), net.batch_probability(x).alias("b")).collect()
    assert len(got) == 80 and all(abs(r.a - r.p) < 1e-12 and abs(r.b - r.p) < 1e-12 for r in got)
    one = F.struct("candidate_product_id", "candidate_category", "retrieval_rank", *H.FEATURES, "label")
    packed = frame.withColumn("candidate_category", F.lit("c")).groupBy((F.col("query_idx") % 7).alias("query_idx")).agg(F.sort_array(F.collect_list(one)).alias("cands"))
    packed = packed.unionByName(packed.limit(1).select(F.lit(99).cast("long").alias("query_idx"), F.slice("cands", 1, 0).alias("cands")))
    by = {tuple(r[f] for f in H.FEATURES): r.p for r in got}
    rows = H.scored_lists(packed, net).collect()
    assert sum(len(r.cands) for r in rows) == 80 and len(rows) == 8
    assert all(abs(c.p_click - by[tuple(c[f] for f in H.FEATURES)]) < 1e-9 for r in rows for c in r.cands)


def slow_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_grouped_auc(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([round(rng.random(), g), rng.gauss(0, 1)]), int(rng.random() < 0.3)) for g in range(1, 4) for _ in range(120)]
    rows += [(4, 0.5, 1), (4, 0.7, 1), (5, 0.5, 0), (6, 1.0, 1), (6, 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, score double, label int")
    for buckets in (4096, 3):
        got = {r.g: r.auc for r in H.grouped_auc(df, ["g"], buckets=buckets).collect()}
        for g in range(1, 7):
            want = slow_auc([(s, y) for h, s, y in rows if h == g])
            assert got[g] == (None if want is None else pytest.approx(want)), g


def shuffled(n, key):
    from rankflow.functions.hashing import permutation_keys, permuted

    factors, shifts = (F.array(*[F.lit(x).cast("long") for x in part]) for part in permutation_keys(key))
    return permuted(F.col("id"), n, factors, shifts)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 97, 1000, 2503])
def test_keyed_permutation(spark, n):
    rows = spark.range(n).select(shuffled(n, "a").alias("x"), shuffled(n, "b").alias("y")).collect()
    assert sorted(r.x for r in rows) == sorted(r.y for r in rows) == list(range(n))
    if n > 90:
        assert [r.x for r in rows] != [r.y for r in rows] and sum(r.x == i for i, r in enumerate(rows)) < 12
        near = sum(abs(rows[i].x - rows[i + 1].x) < n / 50 for i in range(n - 1))
        assert near < n / 12


def test_importance_equals_shuffling_by_hand(spark):
    frame = click_frame(spark, 60)
    rows = frame.orderBy("query_idx").collect()
    weights = [0.5, 0.3, 0.7, 0.4, 0.2]

    def score(x):
        return F.round(sum((w * c for w, c in zip(weights, x)), F.lit(0.0)), 9)

    def plain(x):
        return round(sum(w * c for w, c in zip(weights, x)), 9)

    got = {r.feature: r for r in H.permutation_importance(frame, score, repeats=3, seed=5).collect()}
    assert set(got) == set(H.FEATURES)
    full = slow_auc([(plain([r[f] for f in H.FEATURES]), r.label) for r in rows])
    for p, f in enumerate(H.FEATURES):
        drops = []
        for i in range(3):
            to = [r.x for r in spark.range(60).select("id", shuffled(60, f"5/{i}").alias("x")).orderBy("id").collect()]
            drops.append(full - slow_auc([(plain([rows[to[j]][f] if q == p else r[g] for q, g in enumerate(H.FEATURES)]), r.label) for j, r in enumerate(rows)]))
        mean = sum(drops) / 3
        assert got[f].importance_mean == pytest.approx(mean, abs=1e-12)
        assert got[f].importance_std == pytest.approx((sum((d - mean) ** 2 for d in drops) / 3) ** 0.5, abs=1e-12)


def test_importance_does_not_depend_on_blocks_and_ranges(spark, monkeypatch):
    """Small blocks, ranges and packs, tied scores and a missing feature give the areas of all pairs; no row is copied per variant."""
    frame = click_frame(spark, 90).withColumn("similarity_score", F.round("similarity_score", 1))
    frame = frame.withColumn("product_popularity", F.when(F.col("query_idx") % 9 != 4, F.col("product_popularity")))
    rows = frame.orderBy("query_idx").collect()

    def score(x):
        return F.round(2 * x[0] + x[1] - 0.5 * x[4], 1)

    def auc(no, p=None, to=None):
        pairs = []
        for j in range(90):
            x = [rows[to[j] if q == p else j][f] for q, f in enumerate(H.FEATURES)]
            if x[4] is not None:
                pairs.append((round(2 * x[0] + x[1] - 0.5 * x[4], 6), rows[j].label))
        return slow_auc([(math.floor(s * 10 + 0.5 + 1e-9) / 10 if s >= 0 else -math.floor(-s * 10 + 0.5 + 1e-9) / 10, y) for s, y in pairs])

    for name, value in {"IMPORTANCE_BLOCK": 16, "ROWS_AT_ONCE": 20, "RANGE_SCORES": 7, "CUT_ROWS": 40}.items():
        monkeypatch.setattr(H, name, value)
    got = {r.feature: r.importance_mean for r in H.permutation_importance(frame, score, repeats=2, seed=7).collect()}
    turns = [[r.x for r in spark.range(90).select("id", shuffled(90, f"7/{i}").alias("x")).orderBy("id").collect()] for i in range(2)]
    for p, f in enumerate(H.FEATURES):
        want = sum(auc(0) - auc(0, p, to) for to in turns) / 2
        assert got[f] == pytest.approx(want, abs=1e-12), f


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 2503])
def test_number_before_undoes_the_permutation(spark, n):
    import numpy as np

    from rankflow.functions.hashing import number_before

    to = [r.x for r in spark.range(n).select("id", shuffled(n, "a").alias("x")).orderBy("id").collect()]
    assert number_before(n, "a")(np.array(to)).tolist() == list(range(n))
