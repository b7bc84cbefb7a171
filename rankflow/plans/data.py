"""A: sources and sinks (round trips through the shared folder). B: labels, splits, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow import schemas
from rankflow.operators import catalog as C
from rankflow.operators import labels as B
from rankflow.plans import views as V
from rankflow.plans.oracle_views import bucket, sql
from rankflow.plans.registry import query
from rankflow.plans.views import r6
from rankflow.sources import fixtures, logs, records, tables
from rankflow.sources.scratch import materialize, scratch_path

REVIEW_COLS = ["user_id", "product_id", "score", "timestamp", "title", "summary"]


def _record_file(spark, sf):
    """The interactions as a file of blank-separated records."""
    path = scratch_path(spark, "records")
    records.render_records(fixtures.interactions(spark, sf).select(*REVIEW_COLS)).write.text(path)
    return path


@query("a1_parse_review_records", sql("SELECT user_id, product_id, score, timestamp, title, summary FROM interactions", "interactions"))
def a1(spark, sf):
    return records.load_reviews(spark, _record_file(spark, sf), id_type="bigint")


@query("a2_load_brand_lookup", sql("SELECT product_id, brand FROM brands", "brands"))
def a2(spark, sf):
    path = scratch_path(spark, "brands")
    b = fixtures.brands(spark, sf)
    b.select(F.concat_ws(" ", F.col("product_id").cast("string"), "brand").alias("value")).write.text(path)
    return records.load_brands(spark, path, "bigint")


@query(
    "a3_attach_summary",
    sql(
        """SELECT i.user_id, i.product_id, i.score, i.timestamp, i.title, coalesce(s.summary,'') AS summary FROM interactions i
        LEFT JOIN (SELECT user_id, product_id, min(summary) AS summary FROM interactions WHERE score >= 3 GROUP BY 1,2) s USING (user_id, product_id)""",
        "interactions",
    ),
)
def a3(spark, sf):
    # Only reviews of 3 or more carry a summary in the record file, so that the null branch occurs.
    path = scratch_path(spark, "summaries")
    rows = fixtures.interactions(spark, sf)
    records.render_records(rows.where(F.col("score") >= 3).select(*REVIEW_COLS)).write.text(path)
    parsed = records.load_reviews(spark, path, id_type="bigint")
    return records.add_summary(rows, parsed).select("user_id", "product_id", "score", "timestamp", "title", "summary")


@query("a4_read_csv_tables", sql("SELECT user_id, product_id, score, timestamp, title, summary, label FROM labeled", "labeled"))
def a4(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_csv_table(V.labeled(spark, sf).select(*schemas.INTERACTIONS.fieldNames()), path)
    return tables.read_csv_table(spark, path, schemas.INTERACTIONS)


@query("a5_write_split_tables", sql("SELECT user_id, product_id, score, timestamp, label, split FROM splits", "splits"))
def a5(spark, sf):
    path = scratch_path(spark, "splits")
    rows = V.split_table(spark, sf).select("user_id", "product_id", "score", "timestamp", "label", "split")
    tables.write_splits(rows, path)
    return tables.read_split(spark, path)


@query(
    "a6_metric_report",
    sql(
        """SELECT 'popularity' AS model, 'all' AS split, 'label_mean' AS metric, round(avg(label),6) AS value, 'labels' AS meta_source FROM labeled
        UNION ALL SELECT 'popularity', 'all', 'rows', count(*), 'labels' FROM labeled""",
        "labeled",
    ),
)
def a6(spark, sf):
    path = scratch_path(spark, "report")
    row = V.labeled(spark, sf).agg(F.avg("label").alias("label_mean"), F.count(F.lit(1)).cast("double").alias("rows"))
    metrics = row.unpivot([], ["label_mean", "rows"], "metric", "value")
    tables.append_report(tables.metric_report(metrics, "popularity", "all", 0, {"source": "labels"}), path)
    back = spark.read.schema(schemas.METRIC_REPORT).parquet(path)
    return back.select("model", "split", "metric", r6("value"), F.col("meta")["source"].alias("meta_source"))


def _served_pages(spark, sf):
    """Every event as a request that is served the ten most popular products of its customer's category.

    One list per category keeps the page a join on a small table.
    """
    train = V.split_rows(spark, sf, "train")
    cat = C.category_lookup(V.rich_catalog(spark, sf))
    counts = train.join(cat, "product_id").groupBy("category", "product_id").agg(F.count(F.lit(1)).alias("n"))
    lists = V.D.top_per_group(counts, ["category"], [F.desc("n"), F.asc("product_id")], 10).select(
        "category", F.col("rank").cast("int").alias("rank"), F.col("product_id").cast("string").alias("item_id"),
        F.col("n").cast("double").alias("score"),
    )
    favourite = (
        train.join(cat, "product_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    )
    ev = fixtures.served_latencies(spark, sf).join(favourite, "user_id", "left").withColumnRenamed("page", "query_text")
    served = ev.select("request_key", "category").join(lists, "category").drop("category")
    return ev.drop("category"), served


SERVED_SQL = """, cat_lists AS (SELECT * FROM (SELECT category_id AS category, product_id, count(*) AS n,
    row_number() OVER (PARTITION BY category_id ORDER BY count(*) DESC, product_id) AS rank
    FROM splits JOIN catalog USING (product_id) WHERE split='train' GROUP BY 1,2) WHERE rank <= 10),
  fav AS (SELECT user_id, category FROM (SELECT user_id, category_id AS category,
    row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category_id) AS rn
    FROM splits JOIN catalog USING (product_id) WHERE split='train' GROUP BY 1,2) WHERE rn = 1)"""


def _impressions_sql(select: str, *needs: str) -> str:
    body = (
        "SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS user_id, event_type AS query_text, "
        "coalesce(string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rank),'') AS candidate_ids, "
        "coalesce(sum(n),0.0) AS score_sum, count(product_id) AS n_items "
        "FROM events e LEFT JOIN fav f ON f.user_id = e.user_id LEFT JOIN cat_lists c ON c.category = f.category GROUP BY 1,2,3"
    )
    base = sql("@", "splits", "catalog")
    return base.replace("\n@", f"{SERVED_SQL}, pages AS ({body})\n{select}")


IMPRESSION_SELECT = f"""SELECT user_id, query_text, candidate_ids, round(score_sum,6)::DOUBLE AS score_sum,
  CAST({bucket('user_id', 2)} AS INTEGER) AS experiment_bucket FROM pages"""


def _flat(df):
    total = F.aggregate("predicted_scores", F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "user_id", "query_text", F.array_join("candidate_ids", ",").alias("candidate_ids"),
        F.round(total, 6).alias("score_sum"), "experiment_bucket",
    )


@query("a7_append_impressions", _impressions_sql(IMPRESSION_SELECT))
def a7(spark, sf):
    # Written in two appends: the log grows, it is not replaced.
    path = scratch_path(spark, "log")
    built = materialize(logs.build_impressions(*_served_pages(spark, sf)), "impressions")
    clicks = F.coalesce(F.col("query_text") == "click", F.lit(False))
    logs.append_impressions(built.where(clicks), path)
    logs.append_impressions(built.where(~clicks), path)
    return _flat(logs.read_impressions(spark, path))


@query(
    "a8_read_impressions",
    _impressions_sql(
        "SELECT query_text, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS n_items, count(DISTINCT user_id) AS users FROM pages GROUP BY 1"
    ),
)
def a8(spark, sf):
    path = scratch_path(spark, "log")
    logs.append_impressions(logs.build_impressions(*_served_pages(spark, sf)), path)
    absent = logs.read_impressions(spark, scratch_path(spark, "absent"))
    both = logs.read_impressions(spark, path).unionByName(absent)
    return both.groupBy("query_text").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("candidate_ids")).alias("n_items"), F.countDistinct("user_id").alias("users")
    )


@query("a9_build_impressions", _impressions_sql(IMPRESSION_SELECT))
def a9(spark, sf):
    return _flat(logs.validate_impressions(logs.build_impressions(*_served_pages(spark, sf))))


@query(
    "a10_embedding_store",
    sql("SELECT product_id, unnest(e) AS x, CAST(generate_subscripts(e,1)-1 AS INTEGER) AS pos FROM pv", "pv"),
)
def a10(spark, sf):
    path = scratch_path(spark, "vectors")
    build = lambda: V.product_vectors(spark, sf)
    tables.load_or_store_embeddings(spark, path, build)
    back = tables.load_or_store_embeddings(spark, path, build)
    return back.select("product_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))


@query("a11_text_index_store", sql("SELECT query_text, rank, item_id, score FROM text_top", "text_top"))
def a11(spark, sf):
    path = scratch_path(spark, "index")
    V.text_index(spark, sf).save(path)
    loaded = V.D.TextIndex.load(spark, path)
    return V.D.retrieve_texts(loaded, V.title_queries(spark, sf), "query_text", 200)


@query(
    "b1_implicit_labels",
    sql(
        """SELECT user_id, product_id, score, timestamp, CAST(CASE WHEN score >= 4 THEN 1 WHEN score <= 2 THEN 0 ELSE -1 END AS INTEGER) AS label
        FROM interactions""",
        "interactions",
    ),
)
def b1(spark, sf):
    rows = B.assign_labels(fixtures.interactions(spark, sf), keep_neutral=True)
    return rows.select("user_id", "product_id", "score", "timestamp", "label")


@query(
    "b2_activity_filter",
    sql(
        """, u AS (SELECT * FROM labeled WHERE user_id IN (SELECT user_id FROM labeled GROUP BY 1 HAVING count(*) >= 30))
        SELECT user_id, product_id, score, timestamp, label FROM u WHERE product_id IN (SELECT product_id FROM u GROUP BY 1 HAVING count(*) >= 18)""",
        "labeled",
    ).replace(")\n,", "),\n"),
)
def b2(spark, sf):
    return B.filter_active_entities(V.labeled(spark, sf), 30, 18).select("user_id", "product_id", "score", "timestamp", "label")


@query("b3_time_split", sql("SELECT split, user_id, product_id, timestamp, row_key FROM splits", "splits"))
def b3(spark, sf):
    return V.split_table(spark, sf).select("split", "user_id", "product_id", "timestamp", "row_key")


@query(
    "b4_leakage_check",
    sql(
        """SELECT *, train_max <= val_min AND val_max <= test_min AS no_leakage FROM (SELECT
        max(timestamp) FILTER (split='train') AS train_max, min(timestamp) FILTER (split='val') AS val_min,
        max(timestamp) FILTER (split='val') AS val_max, min(timestamp) FILTER (split='test') AS test_min FROM splits)""",
        "splits",
    ),
)
def b4(spark, sf):
    return B.split_ranges(V.split_table(spark, sf))


@query(
    "b5_repeat_users",
    sql(
        """SELECT user_id, count(*) AS n_train FROM splits WHERE split='train' AND user_id IN (SELECT user_id FROM splits WHERE split='test')
        GROUP BY 1 HAVING count(*) >= 3""",
        "splits",
    ),
)
def b5(spark, sf):
    s = V.split_table(spark, sf)
    return B.repeat_users(s.where("split = 'train'"), s.where("split = 'test'"))


def _stat_sql(scope: str, where: str) -> str:
    items = {
        "rows": "count(*)", "users": "count(DISTINCT user_id)", "products": "count(DISTINCT product_id)",
        "positives": "count(*) FILTER (label = 1)", "negatives": "count(*) FILTER (label = 0)",
    }
    return " UNION ALL ".join(f"SELECT '{scope}' AS scope, '{n}' AS statistic, {e} AS value FROM splits {where}" for n, e in items.items())


@query(
    "b6_dataset_statistics",
    sql(
        " UNION ALL ".join(
            [_stat_sql("all", "")] + [_stat_sql(s, f"WHERE split='{s}'") for s in ("train", "val", "test")]
            + ["SELECT 'all', 'brands', count(DISTINCT brand) FROM brands"]
            + [f"SELECT '{s}', 'repeat_users', count(DISTINCT user_id) FROM splits WHERE split='{s}' AND user_id IN (SELECT user_id FROM splits WHERE split='train' GROUP BY 1 HAVING count(*) >= 3)" for s in ("val", "test")]
        ),
        "splits", "brands",
    ),
)
def b6(spark, sf):
    return B.dataset_statistics(V.split_table(spark, sf), fixtures.brands(spark, sf))


@query(
    "b7_catalog_statistics",
    sql(
        """SELECT count(*) AS catalog_products, count(DISTINCT category_id) AS catalog_categories, count(*) FILTER (brand <> 'unknown') AS catalog_brands,
        round(avg(length(cleaned_text)),6) AS avg_text_length, (SELECT count(*) FROM title_queries) AS queries_title,
        (SELECT count(*) FROM ngram_queries) AS queries_ngram FROM catalog""",
        "catalog", "title_queries", "ngram_queries",
    ),
)
def b7(spark, sf):
    cat = V.rich_catalog(spark, sf)
    row = B.catalog_statistics(cat, C.generate_queries(cat, "title"), C.generate_queries(cat, "ngram"))
    return row.withColumn("avg_text_length", r6("avg_text_length"))
