"""Declared schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T

INTERACTIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("review_count", T.LongType()),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("query_text", T.StringType()),
    ]
)

IMPRESSIONS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("candidate_ids", T.ArrayType(T.StringType())),
        T.StructField("predicted_scores", T.ArrayType(T.DoubleType())),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("experiment_bucket", T.IntegerType()),
    ]
)

METRIC_REPORT = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("run_ts", T.LongType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("model", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
