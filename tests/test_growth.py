"""What queries store and shuffle must not grow with the number of candidates or of passes over the inputs."""

import math

import pytest
from pyspark.sql import functions as F

from rankflow.operators import personalize as G
from rankflow.operators import rerank as H
from rankflow.operators import text_index as D
from rankflow.operators import vectors as E
from rankflow.plans import registry
from rankflow.plans import views as V
from rankflow.sources.scratch import materialize

registry.load_all()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """40 products of 8 titles, 12 of them with vectors; 300 orders of 4 lines by 25 customers."""
    sf = str(tmp_path_factory.mktemp("tables"))
    words = F.array(*[F.lit(w) for w in ("red", "ring", "blue", "bolt", "paint", "gear", "paper", "marker")])
    part = spark.range(40).select(
        F.col("id").alias("p_partkey"), F.concat_ws(" ", words[(F.col("id") % 4).cast("int")], words[(4 + F.col("id") % 2).cast("int")]).alias("p_name"),
        F.concat(F.lit("Brand#"), F.col("id") % 3 + 10).alias("p_brand"), F.element_at(F.array(F.lit("LARGE"), F.lit("SMALL TIN")), (F.col("id") % 2 + 1).cast("int")).alias("p_type"),
    )
    orders = spark.range(300).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 25).alias("o_custkey"),
        F.expr("CAST(TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(cast(id * 13 % 200 as int)) AS TIMESTAMP_NTZ)").alias("o_orderdate"),
    )
    line = spark.range(1200).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") * 11 % 40).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") * 17 % 50 + 1).cast("double").alias("l_quantity"),
    )
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i + 1).cast("float"))
    vecs = spark.range(12).select(F.col("id").alias("vec_id"), vector.alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    for name, df in {"part": part, "orders": orders, "lineitem": line, "embeddings": vecs}.items():
        df.coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    V.new_query()
    yield sf
    V.new_query()


def test_the_split_search_does_not_repeat_the_joins(spark, tables):
    rows = V.split_table(spark, tables)
    assert not any(tables in f for f in rows.inputFiles()) and "Join" not in plan(rows)
    assert rows.count() == V.labeled(spark, tables).count()
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    n = sum(sizes.values())
    assert (sizes["train"], sizes["train"] + sizes["val"]) == (n * 70 // 100, n * 85 // 100)


def test_stored_and_moved_requests_hold_no_candidates(spark, tables):
    stored = V.explore_requests(spark, tables, "test")
    assert stored.count() > 0 and not any(t.startswith("array") for _, t in stored.dtypes)
    # Requests get their user's map first: the lists come with the last join, and nothing above it is moved.
    above = plan(V.packed_requests(spark, tables, "test")).split("Join")[0]
    assert "Repartition" not in above and "transform" in above


def test_lists_are_ordered_in_their_rows(spark, tables):
    packed = V.packed_requests(spark, tables, "test")
    score = lambda c: F.round(c["similarity_score"] * 2, 1)
    got = H.reordered(packed, score)
    assert "Window" not in plan(got)
    rows = V.features(spark, tables, "test").withColumn("s", F.round(F.col("similarity_score") * 2, 1))
    want = H.ordered_lists(rows, "s")
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_postings_are_never_broadcast_by_the_size_of_the_catalog_file(spark, tables):
    pairs = spark.createDataFrame([("red paint", 1), ("blue bolt", 2)], "query_text string, product_id long")
    scored = D.score_candidates(V.text_index(spark, tables), pairs)
    assert any("Join" in line and "hints" not in line and "rightHint=(strategy=merge)" in line for line in plan(scored).splitlines())
    assert scored.count() == 2


def test_narrow_rows_equal_the_interactions(spark, tables, tmp_path):
    """With parts and orders that are missing or come twice, and null keys: counts, catalog and labelled rows are the joins'."""
    odd = str(tmp_path / "odd")
    for name in ("part", "orders", "lineitem", "embeddings"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{odd}/{name}.parquet")
    spark.read.parquet(f"{tables}/part.parquet").where("p_partkey < 3").withColumn("p_name", F.lit("a ring")).write.mode("append").parquet(f"{odd}/part.parquet")
    spark.read.parquet(f"{tables}/orders.parquet").where("o_orderkey < 2").write.mode("append").parquet(f"{odd}/orders.parquet")
    line = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_orderkey < 3")
    for change in ({"l_partkey": 900}, {"l_orderkey": 900}, {"l_partkey": None}, {"l_quantity": None}):
        row = line.withColumns({c: F.lit(v).cast(line.schema[c].dataType) for c, v in change.items()})
        row.write.mode("append").parquet(f"{odd}/lineitem.parquet")
    for sf, looked_up in ((tables, False), (odd, True)):
        V.new_query()
        got = V.labeled_table(spark, sf)
        want = V.labeled(spark, sf).select(*got.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
        joined = V.review_counts(spark, sf).where("parts <> 1").count() > 0
        assert joined == looked_up
        wide = V.C.build_rich_catalog(V.fixtures.interactions(spark, sf), V.fixtures.brands(spark, sf))
        assert sorted(map(tuple, V.rich_catalog(spark, sf).collect())) == sorted(map(tuple, wide.collect()))
    # No line item is moved with its texts: the stored rows have none.
    assert not {"title", "summary"} & set(V.labeled_table(spark, tables).columns)
    V.new_query()


def test_texts_are_searched_once_for_all_their_products(spark):
    """Many products of one text: the postings hold the text once, and the lists are those of all products."""
    rows = [(i, ["red steel ring", "blue ring", "red bolt", "steel", ""][i * 7 % 5]) for i in range(60)]
    catalog = spark.createDataFrame(rows, "product_id long, cleaned_text string")
    asked = spark.createDataFrame([(t,) for t in ("red ring", "steel bolt", "ring", "none")], "query_text string")
    once = D.fit_texts(catalog)
    assert once.postings.select("product_id").distinct().count() == 4
    every = D.fit(catalog)
    for k in (1, 5, 13, 30, 60):
        got, want = (sorted(map(tuple, D.retrieve_texts(i, asked, k=k).collect())) for i in (once, every))
        assert got == want and len(got) > 0


def test_only_postings_of_asked_terms_are_dealt(spark):
    catalog = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (None, "red bolt"), (None, "red gear")], "product_id long, cleaned_text string")
    index = D.fit(catalog)
    term = spark.createDataFrame([("red",)], "term string")
    got = {(r["item_id"], round(r["weight"], 9)) for r in D._postings_of(index, term).collect()}
    want = {(r["product_id"], round(r["weight"], 9)) for r in index.postings.where("term = 'red'").collect()}
    assert got == want and len(got) == 2


def test_the_ablation_reads_stored_reports(spark, tables):
    V.new_query()
    text = plan(registry.QUERIES["p16_ablation_lift"](spark, tables))
    assert "MapInArrow" not in text and "FlatMapCoGroups" not in text and len(text) < 20_000


def test_centers_are_not_stored_with_vectors(spark):
    rows = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.sin(F.col("id")), F.cos(F.col("id"))).alias("vec"))
    placed, blocks = E.place_in_blocks(rows, "item_id", 100, "block")
    stored = spark.read.parquet(*placed.inputFiles())
    assert [n for n, t in stored.dtypes if t.startswith("array")] == ["vec"]
    assert placed.count() == 300 and blocks.agg(F.sum("n")).first()[0] == 300
    off = placed.join(blocks, "block").where(E._distance("vec", "center") > F.col("radius") + 1e-9)
    assert off.isEmpty()


def test_blended_vectors_are_not_grouped_again(spark, monkeypatch):
    kept = {}

    def keep(df, name, *rest):
        kept[name] = plan(df)
        return materialize(df, name, *rest)

    monkeypatch.setattr(G, "materialize", keep)
    unit = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    products = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(9)], "product_id long, embedding array<double>")
    priors = spark.createDataFrame([*unit, (None, [0.6, 0.8])], "category string, embedding array<double>")
    users = spark.createDataFrame([(1, [0.0, -1.0])], "user_id long, embedding array<double>")
    asked = [(0, 1, "x", [1.0, 0.0]), (1, 2, "x", [1.0, 0.0]), (2, None, "y", [0.0, 1.0]), (3, 1, "x", [1.0, 0.0])]
    requests = spark.createDataFrame(asked, "query_key long, user_id long, query_text string, vec array<double>")
    got = G.personalized_ranking(requests, users, priors, products, [0.5, 1.0], 3).collect()
    want = set()
    for key, user, text, q in asked:
        for alpha in (0.5, 1.0):
            u = [0.0, -1.0] if user == 1 else {"x": [1.0, 0.0], "y": [0.0, 1.0]}[text]
            m = [alpha * a + (1 - alpha) * b for a, b in zip(q, u)]
            m = [x / math.hypot(*m) for x in m]
            best = sorted((-round(m[0] * math.cos(i) + m[1] * math.sin(i), 9), i) for i in range(9))[:3]
            want |= {(key, alpha, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {(r["query_key"], r["alpha"], r["rank"], r["item_id"], r["score"]) for r in got} == want
    # Nothing is grouped above the joins that bring the vectors.
    assert "Aggregate" not in kept["blended-queries"].split("Join")[0]


def test_the_click_model_is_fitted_on_all_train_candidates(spark, tables):
    """The counted rows are those of all train requests, and give the model that the rows themselves give."""
    V.new_query()
    counted = V.fit_lists(spark, tables)
    rows = V.features(spark, tables, "train")
    requests = V.requests(spark, tables, "train").join(V.candidate_lists(spark, tables), "query_text", "left_semi").count()
    first = counted.groupBy("query_text", "category").agg(F.first("n").alias("n"))
    assert first.agg(F.sum("n")).first()[0] == requests > 100
    assert counted.agg(F.sum(F.col("n") * F.size("candidates"))).first()[0] == rows.count()
    seen = {}
    parts = H._counted_parts(H.FEATURES)
    for x, n, clicks in parts(counted.toArrow().to_batches()):
        for at, times, y in zip(x.tolist(), n, clicks):
            key = tuple(round(v, 9) for v in at)
            a, b = seen.get(key, (0, 0))
            seen[key] = (a + times, b + y)
    want = rows.groupBy(*[F.round(f, 9).alias(f) for f in H.FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()
    assert {k: v for k, v in seen.items() if v != (0, 0)} == {tuple(r[f] for f in H.FEATURES): (r.n, r.y) for r in want}
    one, other = (H.ClickNetwork.of_model(H.click_model(t, hidden=4, max_iter=8)) for t in (counted, rows))
    assert one.mean == pytest.approx(other.mean) and one.scale == pytest.approx(other.scale)
    assert one.out == pytest.approx(other.out, rel=1e-4, abs=1e-4)
    V.new_query()


def test_scores_made_per_text_equal_scores_per_request(spark, tables):
    """The network asked once per text and affinity, and once per request and candidate, give the same lists."""
    from rankflow.operators import explore as O
    from rankflow.plans.ranking import _fixed_network

    V.new_query()
    net = _fixed_network()
    asked, texts = V.explore_texts(spark, tables, "val", "test")
    scored = H.scored_lists(V.packed_explore(spark, tables, "val", "test"), net)
    packed = O.pack_scored(scored, lambda c: c["p_click"], ["split"])
    grid = [O.ExploreConfig(epsilon=e, alpha=0.3, top_pool_k=5, eval_k=4, max_per_category=1) for e in (0.0, 0.6)]
    names = ["split", "query_idx", "query_cluster_id", "target_product_id", "setting_id", "did_explore", "shown"]
    got = O.explore_packed(asked, grid, 42, ["val", "test"], texts, H.text_scores(net)).select(*names)
    want = O.explore_packed(packed, grid, 42, ["val", "test"]).select(*names)
    assert got.count() > 40 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    V.new_query()
