"""Stages of the corpus pipeline: each takes a documents table and gives back the rows that go on.

Extra columns go along. Null and repeated ids are allowed: then rows get a stored number to be told apart by.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import automaton_dedup, decontaminate, language_id, packing, simhash
from rankflow.llm.common import crc_mod, materialize, sliced, table
from rankflow.llm.repeats import covered, unpack, unpacked_sizes, word_bounds

KEY = "__row"


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def with_key(docs: DataFrame) -> DataFrame:
    """docs with a key column of its own per row: the id, or a stored number where ids are null or repeated."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if odd:
        return materialize(docs.withColumn(KEY, F.monotonically_increasing_id()), "numbered")
    return docs.withColumn(KEY, F.col("doc_id"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; rejected ones go: no letter, or a calibrated score below the bound.

    If no row has a language to learn from, nothing can be judged and only texts without a letter go.
    """
    model = language_id.fit_language_id(docs.where(crc_mod("doc_id", 4) != 2))
    if not model.classes:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # Under other names, so that no column of docs can be taken for one of the prediction.
    judged = language_id.predict_language(docs, model, keep=[c.alias(f"__{i}") for i, c in enumerate(columns(docs))])
    return judged.where(~F.col("rejected")).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group of operator 1, of its shingle length and bit distance: that of the smallest key."""
    keyed = with_key(docs)
    found = simhash.near_duplicates(keyed, KEY, "text", shingle=3, radius=3)
    drop = materialize(found.where("id <> component").select(F.col("id").alias(KEY)), "near-duplicates")
    return keyed.join(drop, KEY, "left_anti").select(*columns(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 20-word windows that occur earlier; other words keep their white space.

    n_chars of changed texts is set anew. A text that loses all words stays as an empty one.
    """
    keyed = with_key(docs)
    _, texts, spans = automaton_dedup.repeated_word_spans(keyed, 20, KEY, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, sizes=unpacked_sizes):
            out = []
            for packed, parts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = np.frombuffer(unpack(packed), np.uint8)
                start, _ = word_bounds(text)
                gone = covered(parts, len(start))
                # A word goes with the white space up to the next one.
                lost = np.repeat(np.r_[False, gone], np.diff(np.r_[0, start, len(text)]))
                out.append(text[~lost].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "kept"])

    new = texts.join(spans, "row").select("row", "packed", "spans").mapInArrow(cut, "row long, kept binary")
    new = new.select(F.col("row").alias(KEY), F.col("kept").cast("string").alias("__kept"))
    changed = F.col("__kept").isNotNull()
    fresh = {"text": F.coalesce("__kept", "text"), "n_chars": F.when(changed, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return keyed.join(new, KEY, "left").select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)
