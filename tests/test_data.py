"""Labels, filters, splits, records, logs and catalog: known answers and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from rankflow.functions.text import clean_text, ngram_terms, unaccent, word_tokens
from rankflow.operators import catalog as C
from rankflow.operators import labels as B
from rankflow.sources import logs, records, tables
from rankflow.sources.scratch import scratch_path


def reviews(spark, scores):
    rows = [(f"u{i}", f"p{i}", float(s), i, "t") for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "user_id string, product_id string, score double, timestamp long, title string")


def test_labels(spark):
    got = [r["label"] for r in B.assign_labels(reviews(spark, [1, 2, 3, 4, 5]), keep_neutral=True).orderBy("timestamp").collect()]
    assert got == [0, 0, -1, 1, 1]
    assert B.assign_labels(reviews(spark, [1, 3, 5])).count() == 2
    assert [r["label"] for r in B.assign_labels(reviews(spark, [3, 4]), 3, 1).collect()] == [1, 1]
    with pytest.raises(ValueError):
        B.assign_labels(reviews(spark, [1]), 2, 2)


def test_activity_filter_users_then_products(spark):
    rows = [("u1", "p1"), ("u1", "p2"), ("u2", "p2")]
    df = spark.createDataFrame(rows, "user_id string, product_id string")
    got = {tuple(r) for r in B.filter_active_entities(df, 2, 1).collect()}
    assert got == {("u1", "p1"), ("u1", "p2")}
    # p2 had two rows, but only one is left once u2 is gone.
    assert B.filter_active_entities(df, 2, 2).count() == 0


def split_counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_time_split_sizes_and_order(spark):
    rows = [(f"u{i % 10}", f"p{i % 20}", 1000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, timestamp long")
    out = B.time_split(df)
    assert split_counts(out) == {"train": 140, "val": 30, "test": 30}
    B.check_no_future_leakage(out)
    with pytest.raises(ValueError):
        B.time_split(df, 0.5, 0.3, 0.3)
    swapped = out.withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train"))
    with pytest.raises(ValueError):
        B.check_no_future_leakage(swapped)


@pytest.mark.parametrize("shape", ["one second", "copies", "mixed"])
def test_time_split_is_exact_under_ties_and_copies(spark, monkeypatch, shape):
    monkeypatch.setattr(B, "COPIES_PER_TASK", 7)
    rng = random.Random(5)
    if shape == "one second":
        rows = [(f"u{i}", "p", 86400 * 3) for i in range(101)]
    elif shape == "copies":
        rows = [("u", "p", 50)] * 97
    else:
        rows = [("hot", "p", 86400)] * 40 + [(f"u{rng.randint(0, 9)}", "p", rng.randint(0, 5 * 86400)) for _ in range(63)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, timestamp long")
    out = B.time_split(df)
    n = len(rows)
    want = {"train": n * 70 // 100, "val": n * 85 // 100 - n * 70 // 100, "test": n - n * 85 // 100}
    assert split_counts(out) == want
    assert B.split_ranges(out).collect()[0]["no_leakage"]
    assert sorted(map(tuple, out.drop("split").collect())) == sorted(rows)


@pytest.mark.parametrize("unit", ["long", "double"])
def test_time_split_of_fine_units(spark, unit):
    """Nanoseconds, and fractions of seconds: sizes are exact, order holds."""
    times = [1_700_000_000_000_000_000 + i * 7 for i in range(150)] if unit == "long" else [1.7e9 + i / 64 for i in range(150)]
    out = B.time_split(spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(times)], f"user_id string, timestamp {unit}"))
    assert split_counts(out) == {"train": 105, "val": 22, "test": 23} and B.split_ranges(out).collect()[0]["no_leakage"]


def test_time_split_refuses_null_times(spark):
    with pytest.raises(ValueError, match="no timestamp"):
        B.time_split(spark.createDataFrame([("u", 1), ("u", None)], "user_id string, timestamp long"))


def test_unfinished_embeddings_are_written_again(spark):
    from rankflow.sources.tables import load_or_store_embeddings, written

    path = scratch_path(spark, "vectors")
    df = spark.createDataFrame([(1, [1.0, 2.0])], "product_id long, embedding array<double>")
    assert not written(spark, path)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert not written(spark, path)
    assert load_or_store_embeddings(spark, path, lambda: df.union(df)).count() == 2
    assert written(spark, path) and load_or_store_embeddings(spark, path, lambda: df).count() == 2


def test_record_parser_edge_cases(spark):
    text = (
        "review/userId: u1\nproduct/productId: p1\nreview/score: 5.0\nreview/time: 10\nproduct/title: A: B\n"
        "no separator here\nreview/summary: first\nreview/summary: last\n"
        "   \n\n \t \n"
        "product/productId: p2\nreview/userId: \n\n"
        "review/userId: u3\nproduct/productId: p3\nreview/score: bad\nreview/time: 7"
    )
    path = scratch_path(spark, "rec")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    got = {r["user_id"]: r for r in records.load_reviews(spark, path).collect()}
    assert set(got) == {"u1", "u3"}
    assert got["u1"]["title"] == "A: B" and got["u1"]["summary"] == "last" and got["u1"]["score"] == 5.0
    assert got["u3"]["score"] is None and got["u3"]["timestamp"] == 7 and got["u3"]["summary"] == ""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_parted_by_lines_of_spaces_are_read_by_many_tasks(spark, tmp_path, end):
    """A file whose separators are lines of spaces, with records longer than a split: all are whole, whatever the splits."""
    rng, blocks = random.Random(17), []
    for i in range(400):
        lines = [f"review/userId: u{i}", "product/productId: p", *(f"note/{j}: {'x' * rng.randrange(60)}" for j in range(rng.choice((1, 3, 200))))]
        blocks.append(lines)
    text = (" \t" + end) + "".join(end.join(b) + end + rng.choice((" ", "", "\t")) + end + rng.choice(("", "  " + end)) for b in blocks)
    (tmp_path / "reviews.txt").write_bytes(text.rstrip().encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = [r["block"].split("\n") for r in records.record_blocks(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(blocks)


def test_summary_join_keeps_rows_unless_asked(spark):
    r = spark.createDataFrame([("u", "p", 1), ("u", "q", 2)], "user_id string, product_id string, n int")
    s = spark.createDataFrame([("u", "p", "x"), ("u", "p", "y")], "user_id string, product_id string, summary string")
    assert sorted((x["n"], x["summary"]) for x in records.add_summary(r, s).collect()) == [(1, "x"), (2, "")]
    assert records.add_summary(r, s, dedupe=False).count() == 3


def test_impression_validation(spark):
    schema = "request_id string, user_id string, query_text string, candidate_ids array<string>, predicted_scores array<double>, timestamp double, experiment_bucket int"
    good = ("r1", "u1", "mug", ["p1", "p2"], [0.9, 0.2], 0.0, 1)
    bad = ("r2", "u1", "mug", ["p1"], [0.9, 0.2], 0.0, 1)
    df = spark.createDataFrame([good, bad], schema)
    ok, broken = logs.quarantine_impressions(df)
    assert [r["request_id"] for r in ok.collect()] == ["r1"] and [r["request_id"] for r in broken.collect()] == ["r2"]
    with pytest.raises(Exception, match="same length"):
        logs.validate_impressions(df).collect()
    path = scratch_path(spark, "log")
    assert logs.read_impressions(spark, path).count() == 0
    logs.append_impressions(ok, path)
    logs.append_impressions(ok, path)
    assert logs.read_impressions(spark, path).count() == 2


def test_stored_embeddings_are_reused(spark):
    path = scratch_path(spark, "emb")
    a = spark.createDataFrame([("p", [1.0, 2.0])], "product_id string, embedding array<double>")
    b = a.where(F.lit(False))
    tables.load_or_store_embeddings(spark, path, lambda: a)
    assert tables.load_or_store_embeddings(spark, path, lambda: b).count() == 1


@pytest.fixture
def small_catalog(spark):
    rows = [
        ("u1", "p1", 5.0, 1000, "Acrylic Paint Tubes", "Great paints"),
        ("u2", "p1", 4.0, 1001, "Acrylic Paint Tubes", "Nice colors"),
        ("u3", "p2", 3.0, 1002, "Sketch Pencil Kit", "Good pencils"),
        ("u4", "p3", 5.0, 1003, "Canvas Board", ""),
    ]
    r = spark.createDataFrame(rows, "user_id string, product_id string, score double, timestamp long, title string, summary string")
    b = spark.createDataFrame([("p1", "Winsor"), ("p3", "Strathmore")], "product_id string, brand string")
    return C.build_rich_catalog(r, b)


def test_rich_catalog(small_catalog):
    got = {r["product_id"]: r for r in small_catalog.collect()}
    assert len(got) == 3 and got["p1"]["review_count"] == 2
    assert got["p1"]["brand"] == "Winsor" and got["p2"]["brand"] == "unknown"
    assert got["p1"]["category_id"] == "Paint & Color"
    assert got["p1"]["cleaned_text"] == "acrylic paint tubes winsor great paints"


def test_queries(small_catalog):
    assert C.generate_queries(small_catalog, "title").count() == 3
    grams = C.generate_queries(small_catalog, "ngram", max_queries_per_product=3).collect()
    assert len({r["query_id"] for r in grams}) == len(grams) == 3 + 3 + 1
    assert C.generate_queries(small_catalog.where("false"), "ngram").count() == 0
    with pytest.raises(ValueError):
        C.generate_queries(small_catalog, "invalid")


def test_text_functions(spark):
    df = spark.createDataFrame([("  Héllo, WORLD!  a  b2 ",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(clean_text(F.col("t")), word_tokens(F.col("t")), ngram_terms(word_tokens(F.col("t")))).collect()]
    assert got[0] == ("h llo world a b2", ["hello", "world", "b2"], ["hello", "world", "b2", "hello world", "world b2"])
    assert got[1] == got[2] == ("", [], [])
    odd = spark.createDataFrame([("ﬁne Ａ é",)], "t string").select(unaccent(F.col("t"), full=True)).collect()[0][0]
    assert odd == "fine A e"


def test_cluster_ids(spark):
    df = spark.createDataFrame([(" Big  Red shoe",), ("one",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(C.query_cluster_id(F.col("t"))).collect()] == ["big red", "one", "unknown", "unknown"]
    with pytest.raises(KeyError):
        C.resolve_category_column(df)
