"""Text index, vector search, pairs and personalization: known answers and brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.functions.ordering import bucketed_rank, time_levels
from rankflow.operators import pairs as FP
from rankflow.operators import personalize as G
from rankflow.operators import text_index as D
from rankflow.operators import vectors as E
from rankflow.sources.scratch import scratch_path

TEXTS = ["rain jacket hooded shell", "wool hiking socks pair", "trail map folded print", "steel bottle insulated cap"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(f"p{i + 1}", t) for i, t in enumerate(TEXTS)], "product_id string, cleaned_text string")


def queries(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query_text string")


def test_tfidf_retrieval(spark, docs):
    index = D.fit(docs)
    got = D.retrieve_texts(index, queries(spark, "rain jacket", "", "nothing known"), k=4).collect()
    assert {r["query_text"] for r in got} == {"rain jacket"}
    assert min(got, key=lambda r: r["rank"])["item_id"] == "p1"
    for k in (1, 2):
        assert D.retrieve_texts(index, queries(spark, "rain pair print"), k=k).count() <= k


def test_tfidf_weights_against_formula(spark, docs):
    index = D.fit(docs, high=1)
    got = {(r["product_id"], r["term"]): r["weight"] for r in index.postings.collect()}
    idf = {t: math.log(5 / 2) + 1 for text in TEXTS for t in text.split()}
    for i, text in enumerate(TEXTS):
        w = np.array([idf[t] for t in text.split()])
        for t, x in zip(text.split(), w / np.linalg.norm(w)):
            assert got[(f"p{i + 1}", t)] == pytest.approx(x)
    stats = D.index_statistics(index).collect()[0]
    assert (stats["vocab_size"], stats["n_products"], stats["nonzeros"]) == (16, 4, 16)


def test_score_candidates_and_reload(spark, docs):
    index = D.fit(docs)
    pairs = spark.createDataFrame(
        [("rain jacket", "p1"), ("rain jacket", "p2"), ("rain jacket", "nope"), ("", "p1")],
        "query_text string, product_id string",
    )
    s = {(r["query_text"], r["product_id"]): r["tfidf_score"] for r in D.score_candidates(index, pairs).collect()}
    assert s[("rain jacket", "p1")] > s[("rain jacket", "p2")] == 0.0
    assert s[("rain jacket", "nope")] == 0.0 and s[("", "p1")] == 0.0
    path = scratch_path(spark, "idx")
    index.save(path)
    again = D.TextIndex.load(spark, path)
    q = queries(spark, "jacket socks")
    assert sorted(map(tuple, D.retrieve_texts(again, q).collect())) == sorted(map(tuple, D.retrieve_texts(index, q).collect()))


@pytest.mark.parametrize("dense", [False, True])
def test_user_history_terms_cross_texts(spark, docs, dense):
    """Also for users whose rows are all within a second."""
    rng = random.Random(6)
    rows = [(f"u{rng.randint(1, 3)}", f"p{rng.randint(1, 5)}", rng.randint(5, 5) if dense else rng.randint(0, 400_000), hashlib.md5(b"%d" % i).hexdigest(), rng.randint(0, 1)) for i in range(200)]
    train = spark.createDataFrame(rows, "user_id string, product_id string, timestamp long, row_key string, label int")
    got = {(r["user_id"], r["term"]): r["tf"] for r in D.user_history_terms(train, docs).collect()}
    want = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u and r[4] == 1 and r[1] != "p5"), key=lambda r: (r[2], r[3]))
        t = " ".join(TEXTS[int(r[1][1]) - 1] for r in mine).split()
        for g in t + [f"{a} {b}" for a, b in zip(t, t[1:])]:
            want[(u, g)] = want.get((u, g), 0) + 1
    assert got == want
    ranked = D.retrieve_for_users(D.fit(docs), train, docs, 3)
    assert ranked.where("user_id = 'unknown'").count() == 0 and ranked.count() > 0


def test_user_history_of_a_dense_month(spark, docs):
    """One user with 100,000 rows in a month: no window holds them all."""
    n = 100_000
    train = spark.range(n).select(
        F.lit("u").alias("user_id"), F.concat(F.lit("p"), (F.col("id") % 4 + 1).cast("string")).alias("product_id"),
        (F.col("id") % 2_000_000).alias("timestamp"), F.md5(F.col("id").cast("string")).alias("row_key"), F.lit(1).alias("label"),
    )
    terms = D.user_history_terms(train, docs)
    got = {r["term"]: r["tf"] for r in terms.collect()}
    first, last = [t.split()[0] for t in TEXTS], [t.split()[-1] for t in TEXTS]
    across = {f"{last[i]} {first[(i + 1) % 4]}": n // 4 - (i == 3) for i in range(4)}
    assert {t: c for t, c in got.items() if t in across} == across
    assert sum(got.values()) == n * 7 + n - 1


def vectors(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_block_search_equals_brute_force_with_ties(spark, monkeypatch, metric):
    monkeypatch.setattr(E, "QUERY_ELEMENTS", 7 * 4)
    monkeypatch.setattr(E, "CATALOG_ELEMENTS", 11 * 4)
    rng = np.random.default_rng(0)
    q, c = rng.integers(-2, 3, (25, 4)).astype(float), rng.integers(-2, 3, (60, 4)).astype(float)
    got = E.exact_topk(vectors(spark, q, "query_key"), vectors(spark, c, "item_id"), 8, metric).collect()
    s = q @ c.T if metric == "ip" else -(((q[:, None] - c[None]) ** 2).sum(2))
    for i in range(len(q)):
        want = sorted(range(60), key=lambda j: (-s[i, j], j))[:8]
        mine = sorted((r for r in got if r["query_key"] == i), key=lambda r: r["rank"])
        assert [r["item_id"] for r in mine] == want
    with pytest.raises(ValueError):
        E.exact_topk(vectors(spark, q, "query_key"), vectors(spark, c, "item_id"), 8, "cosine")


def test_ivf_is_exact_when_all_cells_are_probed(spark, monkeypatch):
    monkeypatch.setattr(E, "CATALOG_ELEMENTS", 9 * 5)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 5))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q, c = vectors(spark, m, "query_key"), vectors(spark, m, "item_id")
    cells = E.train_centroids(c, 6)
    exact = E.exact_topk(q, c, 5)
    recalls = [E.recall_against_exact(E.ivf_topk(q, c, cells, 5, n), exact).collect()[0]["recall"] for n in (1, 6)]
    assert 0.2 <= recalls[0] <= recalls[1] == 1.0
    assert E.train_centroids(c, 0).count() == 1
    empty = exact.where("query_key < 0")
    assert E.recall_against_exact(exact, empty).collect()[0]["recall"] == 0.0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_bounded_search_skips_blocks_and_loses_nothing(spark, monkeypatch, metric):
    """Clustered vectors, one of them 150 times: the same rows as brute force, from a part of the pairs of blocks."""
    monkeypatch.setattr(E, "QUERY_ELEMENTS", 20 * 6)
    monkeypatch.setattr(E, "CATALOG_ELEMENTS", 30 * 6)
    rng = np.random.default_rng(7)
    center = 4 * rng.normal(size=(12, 6))
    c = np.round(center[rng.integers(0, 12, 600)] + 0.1 * rng.normal(size=(600, 6)), 3)
    c[:150] = c[0]
    q = np.round(center[rng.integers(0, 12, 90)] + 0.1 * rng.normal(size=(90, 6)), 3)
    found, pairs = E.bounded_topk(vectors(spark, q, "query_key"), vectors(spark, c, "item_id"), 8, metric)
    got = E._best(found, 8, metric).collect()
    s = np.round(q @ c.T if metric == "ip" else -((q[:, None] - c[None]) ** 2).sum(2), 9)
    for i in range(len(q)):
        want = sorted(range(600), key=lambda j: (-s[i, j], j))[:8]
        assert [r["item_id"] for r in sorted((r for r in got if r["query_key"] == i), key=lambda r: r["rank"])] == want
    searched = pairs.collect()
    n_q, n_c = len({p["qblock"] for p in searched}), E.place_in_blocks(vectors(spark, c, "item_id"), "item_id", 30 * 6, "cblock")[1].count()
    assert len(set(searched)) == len(searched)
    assert n_c >= 20 and len(searched) < 0.5 * n_q * n_c, (len(searched), n_q, n_c)


def test_stored_cells_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(E, "CATALOG_ELEMENTS", 40 * 4)
    rng = np.random.default_rng(9)
    m = 3 * rng.normal(size=(10, 4))[rng.integers(0, 10, 500)] + rng.normal(size=(500, 4)) * 0.2
    items = vectors(spark, m, "item_id")
    cells = E.refine_centroids(items, E.sample_centroids(items, 16), 2)
    path = scratch_path(spark, "cells")
    E.store_cells(items, cells, path, "l2")
    queries = vectors(spark, m, "query_key").where("query_key % 100 = 0")
    got = E.stored_ivf_topk(queries, path, cells, 5, 2, "l2")
    want = E.ivf_topk(queries, items, cells, 5, 2, "l2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    exact = E.exact_topk(queries, items, 5, "l2")
    assert E.recall_against_exact(got, exact).collect()[0]["recall"] > 0.9
    read = E.read_cells(spark, path, [r["cell"] for r in cells.limit(2).collect()])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert read.select("cell").distinct().count() == 2 < cells.count()


def test_refined_centroids_are_means(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 3))
    got = {r["cell"]: r["vec"] for r in E.refine_centroids(vectors(spark, m, "item_id"), E.sample_centroids(vectors(spark, m, "item_id"), 5), 1).collect()}
    start = sorted(range(60), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:5]
    own = [min(start, key=lambda j: (round(((m[i] - m[j]) ** 2).sum(), 9), j)) for i in range(60)]
    assert set(got) == set(own)
    for j, v in got.items():
        assert v == pytest.approx(m[[i for i in range(60) if own[i] == j]].mean(0))


def test_trial_choice(spark):
    t = spark.createDataFrame([(64, 20.0, 0.05), (128, 30.0, 0.01), (256, 40.0, 0.005), (512, 60.0, 0.0)], "nlist int, cost double, recall_drop double")
    got = {r["nlist"]: r for r in E.judge_trials(t).collect()}
    assert [n for n, r in got.items() if r["is_best"]] == [128]
    assert not got[512]["meets_cost"] and not got[64]["meets_recall"]


def test_encoders_give_unit_vectors(spark, docs):
    v = E.hash_encode(docs, "product_id", "cleaned_text", 32).collect()
    assert all(np.linalg.norm(r["vec"]) == pytest.approx(1.0) for r in v)
    load = lambda: (lambda texts: np.array([[len(t), 1.0] for t in texts]))
    w = E.encode_corpus(docs, "product_id", "cleaned_text", load, batch_rows=2)
    assert w.count() == 4 and all(np.linalg.norm(r["vec"]) == pytest.approx(1.0) for r in w.collect())
    assert E.encode_corpus(docs.where(F.lit(False)), "product_id", "cleaned_text", load).count() == 0


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(FP, "NUMBER_BUCKET", 2)
    rng = random.Random(8)
    products = [(f"p{i}", f"text {i}", f"c{i % 3}") for i in range(12)]
    # u0 has every product of c0, so it needs the fallback.
    likes = {("u0", f"p{i}") for i in (0, 3, 6, 9)} | {(f"u{rng.randint(1, 4)}", f"p{rng.randint(0, 11)}") for _ in range(25)}
    pairs = [(u, p, f"q {p}") for u, p in sorted(likes)]
    df = spark.createDataFrame(pairs, "user_id string, product_id string, query_text string")
    cat = spark.createDataFrame(products, "product_id string, cleaned_text string, category_id string")
    got = {(r["user_id"], r["product_id"]): r["neg_product_id"] for r in FP.hard_negatives(df, cat, seed=3).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    ring = sorted((p for p, _, _ in products), key=md5)
    of = {p: c for p, _, c in products}
    assert len(got) == len(pairs)
    for u, p, text in pairs:
        h = int(md5(f"3:{u}:{p}:{text}")[:15], 16)
        mine = [x for x in ring if of[x] == of[p]]
        turn = [mine[(h + i) % len(mine)] for i in range(len(mine))]
        free = [x for x in turn if (u, x) not in likes]
        if free:
            assert got[(u, p)] == free[0]
        else:
            x = ring[h % len(ring)]
            assert got[(u, p)] == (x if x != p else ring[(h + 1) % len(ring)])


def test_contrastive_loss_against_numpy(spark):
    rng = np.random.default_rng(5)
    q, p, n = (rng.normal(size=(9, 4)) for _ in range(3))
    rows = [(i // 5, i, *[[float(x) for x in m[i]] for m in (q, p, n)]) for i in range(9)]
    df = spark.createDataFrame(rows, "batch_id long, row_id long, q array<double>, p array<double>, n array<double>")
    got = {r["batch_id"]: r["loss"] for r in FP.contrastive_loss(df, 0.1).collect()}
    for b, idx in ((0, range(5)), (1, range(5, 9))):
        i = list(idx)
        s = q[i] @ np.vstack([p[i], n[i]]).T / 0.1
        want = np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - np.diag(s[:, : len(i)]))
        assert got[b] == pytest.approx(want)


def test_bucketed_rank_equals_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randint(0, 3 * 86400), hashlib.md5(str(i).encode()).hexdigest()) for i in range(200)]
    rows += [("a", 5, hashlib.md5(f"t{i}".encode()).hexdigest()) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, ts long, k string")
    got = bucketed_rank(df, "n", ["g"], time_levels("ts", "k"), [F.col("k")]).collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["ts"], r["k"]))
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))


def test_user_vectors_decay(spark):
    inter = spark.createDataFrame(
        [("u1", "recent", 100.0, 1), ("u1", "old", 50.0, 1), ("u2", "other", 100.0, 1), ("u3", "gone", 100.0, 1), ("u4", "old", 1.0, 0)],
        "user_id string, product_id string, timestamp double, label int",
    )
    pv = spark.createDataFrame([("recent", [1.0, 0.0]), ("old", [0.0, 1.0]), ("other", [0.0, 1.0])], "product_id string, embedding array<double>")
    got = {r["user_id"]: r["embedding"] for r in G.user_embeddings(inter, pv, 0.1).collect()}
    assert set(got) == {"u1", "u2"}
    assert np.linalg.norm(got["u1"]) == pytest.approx(1.0) and got["u1"][0] > got["u1"][1] > 0
    assert got["u1"][1] / got["u1"][0] == pytest.approx(math.exp(-5))
    # Weights that underflow leave a zero vector, which still counts as present.
    zero = G.user_embeddings(inter.where("user_id = 'u1'"), pv, 0.1, reference_time=1e9).collect()
    assert zero[0]["embedding"] == [0.0, 0.0]


def test_alpha_tuning_and_cold_start(spark):
    pv = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0]), ("p3", [0.8, 0.2])], "product_id string, embedding array<double>")
    cat = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "a")], "product_id string, category_id string")
    priors = G.category_priors(cat, pv)
    req = spark.createDataFrame(
        [(0, "repeat", "q0", [0.2, 0.8]), (1, "new", "q1", [0.95, 0.05])], "query_key long, user_id string, query_text string, vec array<double>"
    )
    users = spark.createDataFrame([("repeat", [1.0, 0.0])], "user_id string, embedding array<double>")
    grid = [1.0, 0.8, 0.2]
    ranked = G.personalized_ranking(req, users, priors, pv, grid, 3).cache()
    top = {(r["query_key"], r["alpha"]): r["item_id"] for r in ranked.where("rank = 1").collect()}
    assert top[(0, 1.0)] == "p2" and top[(0, 0.2)] == "p1" and top[(1, 0.2)] in ("p1", "p3")
    truth = spark.createDataFrame([(0, "p1"), (1, "p1")], "query_key long, item_id string")
    best = G.tune_alpha(ranked, truth, grid, 3).where("is_best").collect()
    assert [r["alpha"] for r in best] == [0.2]
    with pytest.raises(ValueError):
        G.category_priors(cat, pv.where("product_id = 'x'"))


def test_segment_lift_with_empty_segment(spark):
    rows = spark.createDataFrame([(5, 0.5, 0.75), (3, 0.5, 0.5)], "n_train long, baseline double, personalized double")
    got = {r["segment"]: r for r in G.segment_lift(rows).collect()}
    assert got["repeat"]["lift_percent"] == pytest.approx(25.0) and got["cold"]["n"] == 0 and got["cold"]["baseline_ndcg"] == 0.0


@pytest.mark.parametrize("name", ["e3_exact_topk_inner_product", "e5_ivf_topk", "g6_personalized_ranking", "d5_user_history_retrieval"])
def test_search_plans_have_no_keyless_join(spark, name):
    import __spark_entry__ as entry

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_vector_sums_of_many_dimensions(spark):
    """One aggregate in the plan whatever the dimension; weights that vanish leave a zero vector."""
    from rankflow.functions.vecmath import sum_vectors

    rng = np.random.default_rng(3)
    rows = [(f"k{i % 5}", rng.normal(size=768).tolist(), float(rng.random())) for i in range(60)] + [("zero", [1.0] * 768, 0.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v array<double>, w double")
    total = sum_vectors(df, ["k"], "v", "s", weight=F.col("w"))
    got = {r.k: np.array(r.s) for r in total.collect()}
    assert set(got) == {"k0", "k1", "k2", "k3", "k4", "zero"} and not got["zero"].any()
    for k in ("k0", "k4"):
        assert np.allclose(got[k], sum(np.array(v) * w for name, v, w in rows if name == k), rtol=0, atol=1e-12)
    whole = sum_vectors(df.where("v is not null"), [], "v", "s", mean=True).collect()
    assert np.allclose(whole[0].s, np.mean([v for _, v, _ in rows if v], axis=0), rtol=0, atol=1e-12)
    plan = total._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and len(plan) < 3000


def test_user_vectors_of_the_size_of_text_encoders(spark):
    rng = np.random.default_rng(4)
    vec = {f"p{i}": rng.normal(size=768) for i in range(6)}
    table = spark.createDataFrame([(p, v.tolist()) for p, v in vec.items()], "product_id string, embedding array<double>")
    seen = [("ann", "p0", 1, 10), ("ann", "p3", 1, 7), ("ann", "p4", 0, 10), ("bo", "p5", 1, 8), ("cy", "gone", 1, 9)]
    inter = spark.createDataFrame(seen, "user_id string, product_id string, label int, timestamp long")
    got = {r.user_id: np.array(r.embedding) for r in G.user_embeddings(inter, table, decay_lambda=0.2).collect()}
    want = vec["p0"] + math.exp(-0.6) * vec["p3"]
    assert set(got) == {"ann", "bo"} and np.allclose(got["ann"], want / np.linalg.norm(want), atol=1e-12)
    assert np.allclose(got["bo"], vec["p5"] / np.linalg.norm(vec["p5"]), atol=1e-12)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_probed_cells_share_groups(spark, monkeypatch, metric):
    """Grouped cells, one of them large, and repeated ids give the lists of a search per cell, from a bounded number of rows."""
    rng = np.random.default_rng(4)
    m = rng.integers(-3, 4, (150, 4)).astype(float)
    m[:70] = m[0]
    items, queries = vectors(spark, m, "item_id"), vectors(spark, m, "query_key").where("query_key % 3 = 0")
    repeated = queries.unionByName(queries.where("query_key = 9"))
    cells = E.sample_centroids(items, 12)
    monkeypatch.setattr(E, "CATALOG_ELEMENTS", 40 * 4)
    monkeypatch.setattr(E, "QUERY_ELEMENTS", 16 * 4)
    for q in (queries, repeated):
        want = E.ivf_lists(E.ivf_partial(q, items, cells, 5, 6, metric), 5, 6, metric)
        got = E.ivf_topk(q, items, cells, 5, 6, metric)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    groups = E._cell_groups(E.assign_cells(items, cells, metric=metric)).collect()
    assert any(g.parts > 1 for g in groups) and len({g.group for g in groups}) < len(groups)
    ranked, moved = E._best, []
    monkeypatch.setattr(E, "_best", lambda rows, *a: (moved.append(rows), ranked(rows, *a))[1])
    E.ivf_topk(queries, items, cells, 5, 6, metric)
    n_groups = sum(g.parts for g in groups if g.parts > 1) + len({g.group for g in groups if g.parts == 1})
    most = moved[-1].groupBy("query_key").count().agg(F.max("count")).first()[0]
    assert n_groups < 6 + 2 and most <= 5 * n_groups


def test_texts_behind_enough_products_are_not_sent_on():
    """Of a text with many products the search sends on what the first k products can come from, ties included."""
    import pyarrow as pa

    queries = pa.table({"user_id": [1, 1, 2], "term": ["red", "ring", "red"], "weight": [0.6, 0.8, 1.0]})
    rows = [(10, "red", 0.9, 4), (11, "red", 0.5, 3), (12, "red", 0.5, 9), (13, "red", 0.1, 2), (14, "ring", 0.1, 5)]
    postings = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("item_id", "term", "weight", "n"))})

    def sent(k, table=postings):
        got = D._sparse_topk("user_id", k)(queries, table).to_pylist()
        return {u: [r["item_id"] for r in got if r["user_id"] == u] for u in (1, 2)}

    assert sent(4) == {1: [10], 2: [10]}
    assert sent(5) == {1: [10, 11, 12], 2: [10, 11, 12]}
    assert sent(16) == sent(15) == {1: [10, 11, 12], 2: [10, 11, 12]}
    assert sent(17) == {1: [10, 11, 12, 14], 2: [10, 11, 12, 13]}
    assert sent(2, postings.drop_columns(["n"])) == {1: [10, 11], 2: [10, 11]}


def test_user_history_of_shared_texts(spark):
    """Postings once per text and once per product give the same lists."""
    rows = [(i, ["red steel ring", "blue ring", "red bolt", "steel"][i * 7 % 4]) for i in range(40)]
    catalog = spark.createDataFrame(rows, "product_id long, cleaned_text string")
    train = spark.createDataFrame([(u, (u * 5 + j * 3) % 40, j * 1000, f"{u:016d}{j:016d}", 1) for u in range(6) for j in range(4)],
                                  "user_id long, product_id long, timestamp long, row_key string, label int")
    for k in (3, 12, 40):
        got, want = (sorted(map(tuple, D.retrieve_for_users(i, train, catalog, k).collect())) for i in (D.fit_texts(catalog), D.fit(catalog)))
        assert got == want and len(got) > 0
