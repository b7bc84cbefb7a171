"""Reading and writing `key: value` review records (A1-A3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankflow.sources.scratch import materialize

# The record keys of the review files, and the column each one becomes.
RECORD_FIELDS = {
    "user_id": "review/userId",
    "product_id": "product/productId",
    "score": "review/score",
    "timestamp": "review/time",
    "title": "product/title",
    "summary": "review/summary",
}


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


#: What an empty line may hold.
BLANK = " \t\x0b\f\r"
PIECES_BYTES = 4 << 20


def _record_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order -> (file, at, kind, text): 0 before a split's first empty line or without one, 1
    between two of them, 2 after the last. ``closed`` marks the piece that an empty line ends."""
    out: list[tuple] = []
    size = 0
    split, lines, seen = None, [], False

    def flush() -> pa.RecordBatch:
        nonlocal size
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        size = 0
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "at", "kind", "closed", "text"])

    for batch in batches:
        for file, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, at) != split:
                if lines:
                    out.append((*split, 2 if seen else 0, False, "\n".join(lines)))
                split, lines, seen = (file, at), [], False
            if line.strip(BLANK):
                lines.append(line)
                size += len(line)
            elif lines or not seen:
                out.append((*split, 1 if seen else 0, True, "\n".join(lines)))
                lines, seen = [], True
            if size >= PIECES_BYTES and not lines:
                yield flush()
    if lines:
        out.append((*split, 2 if seen else 0, False, "\n".join(lines)))
    yield flush()


def record_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: text separated by lines that are empty or hold only white space, with any line ends.

    Files are read as lines, so a large plain file is read by many tasks, whatever its separators. A task puts the
    lines of its splits together; only the first and last piece of a split may belong to a record that goes over
    the edge, and these few rows are joined in the order of the file. (A .gz file is always one task.)
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), "value")
    pieces = materialize(lines.mapInArrow(_record_pieces, "file string, at long, kind int, closed boolean, text string"), "records")
    # Pieces of one record have the same number of splits with an empty line before them.
    edges = pieces.where("kind <> 1")
    before = W.partitionBy("file").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)
    numbered = edges.withColumn("record", F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("at", "kind", "text")))
    joined = numbered.where("text <> ''").groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("block"))
    return pieces.where("kind = 1").select(F.col("text").alias("block")).unionByName(joined.select("block"))


def parse_fields(blocks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Split every line at its first ': ', ignore lines without one, keep the last of equal keys."""
    lines = F.filter(F.split("block", "\n"), lambda s: F.instr(s, ": ") > 0)
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            _strip(F.substring_index(s, ": ", 1)).alias("k"),
            _strip(F.substring(s, F.instr(s, ": ") + F.lit(2), F.length(s))).alias("v"),
        ),
    )
    keyed = blocks.select(pairs.alias("kv"))

    def last(name: str) -> Column:
        hits = F.filter("kv", lambda p: p["k"] == F.lit(name))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(""))

    return keyed.select(*[last(key).alias(col) for col, key in fields.items()])


def load_reviews(
    spark: SparkSession, path: str, fields: dict[str, str] | None = None, id_type: str = "string"
) -> DataFrame:
    """A1: typed review records; records without a user are dropped."""
    rows = parse_fields(record_blocks(spark, path), fields or RECORD_FIELDS)
    return rows.where(F.col("user_id") != "").select(
        F.col("user_id").cast(id_type).alias("user_id"),
        F.col("product_id").cast(id_type).alias("product_id"),
        F.expr("try_cast(score AS DOUBLE)").alias("score"),
        F.expr("try_cast(timestamp AS BIGINT)").alias("timestamp"),
        "title",
        "summary",
    )


def load_brands(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """A2: lines of `product brand words` as a lookup with one brand per product."""
    lines = spark.read.text(path).select(F.split(_strip(F.col("value")), r"\s+", 2).alias("p"))
    rows = lines.where(F.size("p") == 2).select(
        F.col("p")[0].cast(id_type).alias("product_id"), F.col("p")[1].alias("brand")
    )
    return rows.groupBy("product_id").agg(F.min("brand").alias("brand"))


def render_records(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """The inverse of A1: one text value per row, ending in a newline so records are blank-separated."""
    fields = fields or RECORD_FIELDS
    lines = [
        F.concat(F.lit(key + ": "), F.coalesce(F.col(col).cast("string"), F.lit(""))) for col, key in fields.items()
    ]
    return df.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def add_summary(reviews: DataFrame, summaries: DataFrame, dedupe: bool = True) -> DataFrame:
    """A3: left join of review summaries on (user, product); null becomes the empty string.

    Repeated (user, product) pairs in the lookup would multiply rows, so one summary per pair is
    kept unless ``dedupe`` is off.
    """
    keys = ["user_id", "product_id"]
    lookup = summaries.select(*keys, "summary")
    if dedupe:
        lookup = lookup.groupBy(*keys).agg(F.min("summary").alias("summary"))
    return reviews.drop("summary").join(lookup, keys, "left").fillna("", ["summary"])
