"""TF-IDF text index as tables, and retrieval as block products over its postings."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions.ordering import bucketed_rank, time_levels, top_per_group
from rankflow.functions.text import clean_text, ngram_terms, word_tokens
from rankflow.sources.scratch import materialize

# Rows of a block of query terms and of postings, and the bounds of a task's arrays.
QUERY_ROWS = 200_000
POSTING_ROWS = 500_000
DENSE_CELLS = 4_000_000
PAIRS_AT_ONCE = 4_000_000
SCORE_DIGITS = 9
# Characters of text whose terms are counted in one partition.
TEXT_CHARS = 4_000_000


@dataclass
class TextIndex:
    """``terms`` (term, df, idf) and ``postings`` (product_id, term, weight), L2-normalized.

    ``raw`` (product_id, term, w) are the weights before normalization, if known: a search takes the lengths and the
    postings of its own terms from them, and need not move the others. ``members`` (product_id, item_id) and
    ``sizes`` (product_id, n), if postings are kept once per text: the products of a text, under the first of them.
    """

    terms: DataFrame
    postings: DataFrame
    raw: DataFrame | None = None
    members: DataFrame | None = None
    sizes: DataFrame | None = None

    def save(self, path: str) -> None:
        self.terms.write.parquet(f"{path}/terms")
        self.postings.write.parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/postings"))


def popularity_ranking(train: DataFrame, k: int = 200) -> DataFrame:
    """(item_id, n, rank) of the k products with most positives; ties by id.

    The list is the same for every user, so it is kept once and joined to relevance by item.
    """
    counts = train.where(F.col("label") == 1).groupBy(F.col("product_id").alias("item_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    top = counts.orderBy(F.desc("n"), "item_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "item_id")).cast("int"))


def term_counts(df: DataFrame, key: str, text: Column, low: int = 1, high: int = 2) -> DataFrame:
    """(key, term, tf) of the n-grams of every text."""
    terms = df.select(key, F.explode(ngram_terms(word_tokens(text), *range(low, high + 1))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _raw_weights(counts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Sublinear tf times idf; terms outside the vocabulary drop out."""
    return counts.join(terms.select("term", "idf"), "term").select(
        key, "term", ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")
    )


def _weighted(counts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Sublinear tf times idf, L2-normalized per key; terms outside the vocabulary drop out first."""
    return _normalized(_raw_weights(counts, key, terms), key)


def _normalized(w: DataFrame, key: str) -> DataFrame:
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / length).alias("weight"))


def _by_key(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Texts dealt by key, a bounded length to a partition: their terms are then counted without moving terms."""
    chars = rows.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, chars // TEXT_CHARS), key)


def fit(
    catalog: DataFrame,
    text_col: str = "cleaned_text",
    max_features: int | None = None,
    min_df: int = 1,
    low: int = 1,
    high: int = 2,
    id_col: str = "product_id",
) -> TextIndex:
    """D3: vocabulary, idf and document postings.

    max_features keeps the terms of the largest total count, ties alphabetical; by default all are kept.
    """
    counts = term_counts(_by_key(catalog.select(id_col, text_col), id_col, text_col), id_col, F.col(text_col), low, high)
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    if max_features is not None:
        stats = stats.orderBy(F.desc("total"), "term").limit(max_features)
    n = catalog.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    terms = stats.select("term", "df", _idf(n).alias("idf"))
    raw = _raw_weights(counts, id_col, terms)
    return TextIndex(terms, _normalized(raw, id_col), raw.withColumnRenamed(id_col, "product_id"))


def _idf(n: Column) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def fit_texts(catalog: DataFrame, text_col: str = "cleaned_text", low: int = 1, high: int = 2) -> TextIndex:
    """D3 with the postings of every distinct text once, under the smallest of its products' ids.

    Terms and weights are those of ``fit``: a text counts as often as it has products. Ids have to be unique.
    """
    first = catalog.groupBy(text_col).agg(F.min("product_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first, "distinct-texts")
    grams = F.explode(ngram_terms(word_tokens(F.col(text_col)), *range(low, high + 1))).alias("term")
    dealt = _by_key(first, "first", text_col).select(F.col("first").alias("product_id"), "n", grams)
    counts = materialize(dealt.groupBy("product_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n")), "text-terms")
    n = first.agg(F.sum("n").cast("double").alias("n")).scalar()
    terms = materialize(counts.groupBy("term").agg(F.sum("n").alias("df")).select("term", "df", _idf(n).alias("idf")), "terms")
    raw = _raw_weights(counts, "product_id", terms)
    products = catalog.select(text_col, F.col("product_id").alias("item_id"))
    members = products.join(first.select(text_col, F.col("first").alias("product_id")), text_col).select("product_id", "item_id")
    return TextIndex(terms, _normalized(raw, "product_id"), raw, members, first.select(F.col("first").alias("product_id"), "n"))




def _rank(scores: DataFrame, key: str, k: int) -> DataFrame:
    ranked = top_per_group(scores, [key], [F.desc("score"), F.asc("item_id")], k)
    return ranked.select(key, F.col("rank").cast("int").alias("rank"), "item_id", "score")


def _sparse_topk(key: str, k: int):
    """Top k documents of one block of queries against one block of postings, as a sparse product.

    Where postings tell of how many products a document is the text (``n``), documents with k products of higher scores
    before them are not sent on.
    """
    cells, pairs_at_once, digits = DENSE_CELLS, PAIRS_AT_ONCE, SCORE_DIGITS

    def search(queries: pa.Table, postings: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        q_keys = queries.column(key).combine_chunks().dictionary_encode()
        items, seen, d_row = np.unique(postings.column("item_id").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        sizes = postings.column("n").to_numpy()[seen] if "n" in postings.column_names else None
        terms = postings.column("term").combine_chunks().dictionary_encode()
        d_term, d_weight = terms.indices.to_numpy(), postings.column("weight").to_numpy()
        by_term = np.argsort(d_term, kind="stable")
        d_row, d_weight = d_row[by_term], d_weight[by_term]
        first = np.searchsorted(d_term[by_term], np.arange(len(terms.dictionary) + 1))
        q_term = pc.fill_null(pc.index_in(queries.column("term").combine_chunks(), terms.dictionary), -1).to_numpy()
        q_row, q_weight = q_keys.indices.to_numpy(), queries.column("weight").to_numpy()
        order = np.argsort(q_row, kind="stable")
        order = order[q_term[order] >= 0]
        q_term, q_row, q_weight = q_term[order], q_row[order], q_weight[order]
        out_q, out_d, out_s = [], [], []
        step = max(1, cells // max(1, len(items)))
        for low in range(0, len(q_keys.dictionary) if len(items) else 0, step):
            a, b = np.searchsorted(q_row, [low, low + step])
            n = min(step, len(q_keys.dictionary) - low)
            length = first[q_term[a:b] + 1] - first[q_term[a:b]]
            scores = np.zeros(n * len(items))
            ends = np.cumsum(length)
            at = 0
            while at < b - a:  # a bounded number of products at once, one query term at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs_at_once, "right")))
                size = length[at:to]
                before = np.cumsum(size) - size
                post = np.arange(size.sum()) + np.repeat(first[q_term[a + at : a + to]] - before, size)
                cell = np.repeat((q_row[a + at : a + to] - low) * len(items), size) + d_row[post]
                scores += np.bincount(cell, np.repeat(q_weight[a + at : a + to], size) * d_weight[post], len(scores))
                at = to
            scores = np.round(scores.reshape(n, len(items)), digits)
            for i in np.flatnonzero(scores.max(1) > 0):
                hit = np.flatnonzero(scores[i] > 0)
                if len(hit) > k:
                    cut = np.partition(scores[i][hit], len(hit) - k)[len(hit) - k]
                    hit = hit[scores[i][hit] >= cut]
                hit = hit[np.argsort(-scores[i][hit], kind="stable")[:k]]  # items ascend, so ties go to the smaller
                if sizes is not None:
                    worse = -scores[i][hit]
                    hit = hit[np.r_[0, np.cumsum(sizes[hit])][np.searchsorted(worse, worse)] < k]
                out_q.append(np.full(len(hit), low + i))
                out_d.append(hit)
                out_s.append(scores[i][hit])
        rows, docs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_d))
        return pa.table(
            {
                key: q_keys.dictionary.take(pa.array(rows)),
                "item_id": pa.array(items[docs]),
                "score": pa.array(np.concatenate(out_s) if out_s else np.zeros(0)),
            }
        )

    return search


def retrieve_by_terms(index: TextIndex, counts: DataFrame, key: str, k: int = 200) -> DataFrame:
    """Rank documents for (key, term, tf) queries.

    Queries and postings are cut into blocks by hash of their ids. Every pair of blocks is one sparse
    product in a task, which sends on at most k rows per query; a common term is split with the
    documents, and the scores of all pairs are never rows.
    """
    # Both are stored: their numbers of blocks are counted before they are dealt out.
    q = materialize(_weighted(counts, key, index.terms), "query-terms")
    d = _postings_of(index, q.select("term").distinct())
    if index.sizes is not None:
        d = d.join(index.sizes.withColumnRenamed("product_id", "item_id"), "item_id")
    d = materialize(d, "query-postings")
    zero = F.lit(0).cast("long")
    blocks = [F.ceil(F.count(F.lit(1)) / n).cast("long").alias("n") for n in (QUERY_ROWS, POSTING_ROWS)]
    qb, db = q.agg(blocks[0]).scalar(), d.agg(blocks[1]).scalar()
    q, d = (df.withColumn("qb", qb).withColumn("db", db) for df in (q, d))
    q = q.select(
        key, "term", "weight", F.pmod(F.xxhash64(key), F.col("qb")).alias("qblock"), F.explode(F.sequence(zero, F.col("db") - 1)).alias("dblock")
    )
    d = d.select(
        "item_id", "term", "weight", *[c for c in d.columns if c == "n"], F.explode(F.sequence(zero, F.col("qb") - 1)).alias("qblock"),
        F.pmod(F.xxhash64("item_id"), F.col("db")).alias("dblock"),
    )
    fields = [T.StructField(key, counts.schema[key].dataType), T.StructField("item_id", d.schema["item_id"].dataType), T.StructField("score", T.DoubleType())]
    keys = ["qblock", "dblock"]
    partial = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(_sparse_topk(key, k), T.StructType(fields))
    ranked = _rank(partial, key, k)
    return ranked if index.members is None else _rank(_member_rows(index, ranked, key, k), key, k)


def _postings_of(index: TextIndex, terms: DataFrame) -> DataFrame:
    """(term, item_id, weight) of the given terms only."""
    if index.raw is None:
        return index.postings.join(terms, "term", "left_semi").select("term", F.col("product_id").alias("item_id"), "weight")
    length = index.raw.groupBy("product_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    wanted = index.raw.join(terms, "term", "left_semi").select("term", F.col("product_id").alias("item_id"), "w")
    return wanted.join(length, F.col("item_id").eqNullSafe(F.col("product_id"))).select("term", "item_id", (F.col("w") / F.col("length")).alias("weight"))


def _member_rows(index: TextIndex, ranked: DataFrame, key: str, k: int) -> DataFrame:
    """The products of ranked texts: (key, item_id, score) that hold the first k products by score and id.

    A text that is not among the first k has k products ahead of its own, one in each text before it. Of the texts
    only those stay that have fewer than k products of higher scores before them, and of a text its first k products.
    """
    sizes = index.sizes.withColumnRenamed("product_id", "item_id")
    # By score, so that texts of one score have the same products before them.
    higher = W.partitionBy(key).orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)
    level = W.partitionBy(key, "score")
    placed = ranked.join(sizes, "item_id").withColumn("_before", F.sum("n").over(higher) - F.sum("n").over(level))
    kept = materialize(placed.where(F.col("_before") < k).select(key, F.col("item_id").alias("product_id"), "score"), "ranked-texts")
    asked = index.members.join(kept.select("product_id").distinct(), "product_id", "left_semi")
    first = top_per_group(asked, ["product_id"], [F.asc("item_id")], k).select("product_id", "item_id")
    return kept.join(first, "product_id").select(key, "item_id", "score")


def retrieve_texts(index: TextIndex, texts: DataFrame, text_col: str = "query_text", k: int = 200) -> DataFrame:
    """(text, rank, item_id, score) for every distinct query text.

    Real query logs repeat texts heavily, so each distinct cleaned text is scored once; callers join
    the list back to their queries.
    """
    texts = texts.select(text_col).distinct().withColumn("_clean", clean_text(F.col(text_col)))
    counts = term_counts(texts.select("_clean").distinct(), "_clean", F.col("_clean"))
    ranked = retrieve_by_terms(index, counts, "_clean", k)
    return texts.join(ranked, "_clean").select(text_col, "rank", "item_id", "score")


def user_history_terms(train: DataFrame, catalog: DataFrame, order: tuple[str, str] = ("timestamp", "row_key")) -> DataFrame:
    """(user_id, term, tf) of the joined texts of a user's positives, in row order.

    Terms inside one text are counted per (user, product). Bigrams across two texts need the row before: rows get
    their position among the user's rows (counts per bucket of day, second and digits of the tie key, windows only
    inside a bucket), and meet their neighbour by (user, position). So a very active user is spread over many tasks,
    however close in time the rows are. ``order``: seconds, and a text tie key of even first digits such as an md5.
    """
    tokens = word_tokens(F.col("cleaned_text"))
    docs = catalog.select("product_id", tokens.alias("t")).where(F.size("t") > 0)
    # Merged, as the catalog's file is much smaller than its rows, which must not be broadcast by the file's size.
    docs = docs.select("product_id", ngram_terms(F.col("t")).alias("terms"), F.col("t")[0].alias("head"),
                       F.element_at("t", -1).alias("tail")).hint("merge")
    positives = train.where(F.col("label") == 1).select("user_id", "product_id", *order)
    repeats = positives.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    inside = repeats.join(docs.select("product_id", "terms"), "product_id").select(
        "user_id", "n", F.explode("terms").alias("term")
    )
    rows = positives.join(docs.select("product_id", "head", "tail"), "product_id").select("user_id", *order, "head", "tail")
    # Stored: both sides of the join below must see the same positions, and read them once.
    rows = materialize(bucketed_rank(rows, "at", ["user_id"], time_levels(*order), [F.col(order[1])]).select("user_id", "at", "head", "tail"), "history")
    before = rows.select("user_id", (F.col("at") + 1).alias("at"), F.col("tail").alias("prev"))
    across = rows.join(before, ["user_id", "at"]).select("user_id", F.lit(1).cast("long").alias("n"), F.concat_ws(" ", "prev", "head").alias("term"))
    return inside.unionByName(across).groupBy("user_id", "term").agg(F.sum("n").alias("tf"))


def retrieve_for_users(index: TextIndex, train: DataFrame, catalog: DataFrame, k: int = 200) -> DataFrame:
    """Ranked products per user; a user without positives has no rows."""
    return retrieve_by_terms(index, user_history_terms(train, catalog), "user_id", k)


def score_candidates(index: TextIndex, candidates: DataFrame, text_col: str = "query_text") -> DataFrame:
    """Cosine of every given (query text, product) pair; 0.0 for unknown ids or empty text.

    The postings are sorted and merged: by the size of the well compressed catalog file they would pass for a table
    small enough to broadcast, which is then built whole in the driver.
    """
    pairs = candidates.select(text_col, "product_id").distinct().withColumn("_clean", clean_text(F.col(text_col)))
    counts = term_counts(pairs.select("_clean").distinct(), "_clean", F.col("_clean"))
    q = _weighted(counts, "_clean", index.terms).withColumnRenamed("weight", "wq")
    scores = (
        pairs.join(q, "_clean")
        .join(index.postings.hint("merge"), ["product_id", "term"])
        .groupBy(text_col, "product_id")
        .agg(F.round(F.sum(F.col("wq") * F.col("weight")), 9).alias("tfidf_score"))
    )
    return candidates.join(scores, [text_col, "product_id"], "left").fillna(0.0, ["tfidf_score"])


def index_statistics(index: TextIndex) -> DataFrame:
    """Vocabulary size, documents with at least one term, and stored weights."""
    return index.postings.agg(
        F.countDistinct("term").alias("vocab_size"),
        F.countDistinct("product_id").alias("n_products"),
        F.count(F.lit(1)).alias("nonzeros"),
    )
