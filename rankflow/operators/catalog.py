"""Catalog building, synthetic queries and query clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.hashing import seeded_key
from rankflow.functions.text import clean_text, ngram_terms, whitespace_words

# Ordered category rules; the first one whose words occur in the title wins.
CATEGORY_RULES = [
    ("Paint & Color", ["paint", "paints", "watercolor", "acrylic", "dye"]),
    ("Drawing", ["pencil", "pencils", "sketch", "marker", "pastel"]),
    ("Canvas & Paper", ["canvas", "paper", "easel"]),
    ("Fasteners", ["bolt", "rod"]),
    ("Machine Parts", ["gear", "plate"]),
    ("Gadgets", ["gizmo", "widget"]),
    ("Jewelry", ["ring", "bead", "beads"]),
]
DEFAULT_CATEGORY = "Other"


def keyword_category(title: Column, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES) -> Column:
    """C4: category of the first rule with a word in the title."""
    text = F.lower(F.coalesce(title, F.lit("")))
    chain = None
    for name, words in rules:
        hit = text.rlike(r"\b(" + "|".join(words) + r")\b")
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(DEFAULT_CATEGORY)


def _first_rows(interactions: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Per product: its first row by (timestamp, title, ...) and its number of rows."""
    first = F.min(F.struct("timestamp", "title", *extra)).alias("_f")
    per = interactions.groupBy("product_id").agg(first, F.count(F.lit(1)).alias("review_count"))
    return per.select("product_id", "_f.title", *[f"_f.{c}" for c in extra], "review_count")


def _with_brand(products: DataFrame, brands: DataFrame) -> DataFrame:
    lookup = brands.groupBy("product_id").agg(F.min("brand").alias("brand"))
    return products.join(lookup, "product_id", "left").fillna("unknown", ["brand"])


def build_catalog(interactions: DataFrame, brands: DataFrame) -> DataFrame:
    """One row per product with title, brand and number of interactions."""
    return _with_brand(_first_rows(interactions, []), brands).select("product_id", "title", "brand", "review_count")


def build_rich_catalog(reviews: DataFrame, brands: DataFrame, max_summary_words: int = 30) -> DataFrame:
    """One row per product with brand, cleaned text, keyword category and review count."""
    return catalog_of_products(_first_rows(reviews, ["summary"]), brands, max_summary_words)


def catalog_of_products(products: DataFrame, brands: DataFrame, max_summary_words: int = 30) -> DataFrame:
    """C3 where title, summary and review count are known per product: (product_id, title, summary, review_count)."""
    products = _with_brand(products, brands)
    words = F.slice(whitespace_words(F.col("summary")), 1, max_summary_words)
    text = F.concat_ws(" ", F.col("title"), F.col("brand"), F.array_join(words, " "))
    return products.select(
        "product_id",
        "title",
        "brand",
        clean_text(text).alias("cleaned_text"),
        keyword_category(F.col("title")).alias("category_id"),
        "review_count",
    )


def generate_queries(
    catalog: DataFrame,
    strategy: str = "title",
    ngram_sizes: Sequence[int] = (2, 3),
    max_queries_per_product: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Synthetic queries (query_id, product_id, query_text).

    ``title``: one per product. ``ngram``: up to m different n-grams of the title in md5 order; a
    title too short for any n-gram is its own query, so every product has one.
    """
    pid = F.col("product_id").cast("string")
    if strategy == "title":
        return catalog.select(
            F.concat(F.lit("t-"), pid).alias("query_id"), "product_id", clean_text(F.col("title")).alias("query_text")
        )
    if strategy != "ngram":
        raise ValueError(f"unknown query strategy: {strategy}")
    words = whitespace_words(clean_text(F.col("title")))
    grams = F.array_distinct(ngram_terms(words, *ngram_sizes))
    grams = F.when(F.size(grams) > 0, grams).otherwise(F.array(F.array_join(words, " ")))
    keyed = F.array_sort(
        F.transform(grams, lambda g: F.struct(seeded_key(seed, F.col("product_id"), g).alias("k"), g.alias("g")))
    )
    chosen = catalog.select("product_id", F.posexplode(F.slice(keyed, 1, max_queries_per_product)).alias("i", "q"))
    return chosen.select(
        F.concat(F.lit("n-"), pid, F.lit("-"), (F.col("i") + 1).cast("string")).alias("query_id"),
        "product_id",
        F.col("q.g").alias("query_text"),
    )


def query_lookup(queries: DataFrame) -> DataFrame:
    """First query of every product, by query_id."""
    first = F.min_by("query_text", F.col("query_id").cast("string")).alias("query_text")
    return queries.groupBy("product_id").agg(first)


def category_lookup(catalog: DataFrame) -> DataFrame:
    """product_id -> category, whichever category column the catalog carries."""
    column = resolve_category_column(catalog)
    return catalog.groupBy("product_id").agg(F.min(column).alias("category"))


def resolve_category_column(catalog: DataFrame) -> str:
    known = [c for c in ("category", "category_id") if c in catalog.columns]
    if not known:
        raise KeyError(f"none of the catalog's columns {catalog.columns} is a category")
    return known[0]


def eval_queries(interactions: DataFrame, queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Positives with the first query of their product and its category ("unknown" if none).

    All other columns of the interactions are kept, so callers can order the requests.
    """
    positives = interactions.where(F.col("label") == 1)
    return (
        positives.join(query_lookup(queries), "product_id")
        .join(category_lookup(catalog), "product_id", "left")
        .fillna("unknown", ["category"])
    )


def distinct_product_queries(interactions: DataFrame, queries: DataFrame) -> DataFrame:
    """All queries of the products with a positive interaction."""
    positives = interactions.where(F.col("label") == 1).select("product_id").distinct()
    return queries.join(positives, "product_id", "left_semi").select("query_id", "product_id", "query_text")


def query_cluster_id(text: Column) -> Column:
    """First two lower-cased words, "unknown" for blank text."""
    words = whitespace_words(text)
    return F.when(F.size(words) == 0, "unknown").otherwise(F.array_join(F.slice(words, 1, 2), " "))


def cluster_entropy(train: DataFrame, queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Category entropy (bits) of the positive interactions of every query cluster."""
    per_product = (
        train.where(F.col("label") == 1).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
        .join(query_lookup(queries), "product_id", "left")
        .join(category_lookup(catalog), "product_id", "left")
        .fillna({"category": "unknown", "query_text": ""})
    )
    cells = per_product.groupBy(query_cluster_id(F.col("query_text")).alias("query_cluster_id"), "category").agg(
        F.sum("n").alias("n")
    )
    # -sum(p log2 p) = log2(N) - sum(n log2 n) / N, which needs one aggregate and no window.
    total = F.sum("n")
    return cells.groupBy("query_cluster_id").agg(
        F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0)).alias("query_cluster_entropy")
    )


def is_broad_query(entropy: Column, text: Column, entropy_threshold: float = 1.0) -> Column:
    """C11: entropy at or over the threshold, or fewer than three words."""
    return (F.coalesce(entropy, F.lit(0.0)) >= entropy_threshold) | (F.size(whitespace_words(text)) < 3)
