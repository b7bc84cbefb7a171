"""The registered queries of the training-data operators, over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import automaton_dedup, decontaminate, kd_search, language_id, packing, pii, simhash, suffix_dedup, token_alignment, token_counts, toxicity, warc, whitening
from rankflow.llm.common import crc_mod, table
from rankflow.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.record_summary(warc.read_chunks(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400).drop("kept")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.fit_language_id(docs.where(~held_out))
    return language_id.predict_language(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])


@query
def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.fit_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op9_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLE["op9_kd_tree_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""


@query
def op5_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_spans(table(spark, sf_dir, "documents")))


def _personal_data_sql() -> str:
    """The contract's own patterns, and the method's proposals with plain word boundaries."""

    def ascii_bounds(pattern: str) -> str:
        return pattern.replace(pii.START, r"\b").replace(pii.END, r"\b")

    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    patterns = {**base, "national": ascii_bounds(pii.PHONE), "iban": ascii_bounds(pii.IBAN), "ssn": ascii_bounds(pii.SSN)}

    def scan(source: str, text: str, pattern: str, keys: str) -> str:
        def upto(a: str, to: str) -> str:
            return f"coalesce(list_sum(list_transform(list_slice({a}, 1, {to}), lambda x: length(x))), 0)"

        return f"""SELECT {keys}, ms[i] AS m, CAST({upto('gaps', 'i')} + {upto('ms', 'i - 1')} AS BIGINT) AS start, right(gaps[i], {pii.NEAR}) AS before, left(gaps[i + 1], {pii.NEAR}) AS after
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gaps FROM {source}))"""

    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    places = f"list_transform(range(1, length({digits}) + 1), lambda i: CAST(substr({digits}, -i, 1) AS INT))"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr('0246813579', {places}[i] + 1, 1) AS INT) ELSE {places}[i] END)) % 10 = 0"
    account = "replace(m, ' ', '')"
    letters = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    mod97 = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({account}, 5) || left({account}, 4), ''), lambda c: CAST(instr({letters}, c) - 1 AS BIGINT))), "
        "lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
    )
    small = r"regexp_matches(m, '^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$')"
    good = {"email": "true", "ip": small, "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15"}

    def has(words: str) -> str:
        return rf"regexp_matches(before || ' \n ' || after, '(?i)\b(?:{words})\b')"

    def bonus(kind: str) -> str:
        return f"(CASE WHEN {has(pii.CONTEXT[kind])} THEN {pii.CONTEXT_GAIN} ELSE 0 END - CASE WHEN {has(pii.AGAINST)} THEN {pii.CONTEXT_LOSS} ELSE 0 END)"

    ctes = ["d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"]
    ctes += [f"s_{k} AS ({scan('d', 'text', p, 'rid')})" for k, p in patterns.items()]
    spans = [f"SELECT rid, {pii.KINDS.index(k)} AS place, start, start + length(m) AS stop, true AS base FROM s_{k} WHERE {good[k]}" for k in base]
    for kind, inner, points in (("card", pii.INNER_CARD, f"CASE WHEN {luhn} THEN CASE WHEN length({digits}) >= 16 AND regexp_matches(m, '^[3-6]') THEN 60 ELSE 40 END END"), ("phone", pii.INNER_PHONE, "80")):
        ctes.append(f"f_{kind} AS (SELECT rid, m AS whole, start AS origin, {bonus(kind)} AS bonus FROM s_{kind} WHERE NOT ({good[kind]}))")
        ctes.append(f"i_{kind} AS ({scan(f'f_{kind}', 'whole', ascii_bounds(inner), 'rid, origin, bonus')})")
        place = pii.KINDS.index(kind)
        spans.append(f"SELECT rid, {place}, origin + start, origin + start + length(m), false FROM i_{kind} WHERE {points} + bonus >= {pii.MIN_SCORE}")
    issued = "NOT regexp_matches(m, '^(?:000|666|9)') AND NOT contains(m, '-00-') AND NOT regexp_matches(m, '-0000$')"
    for source, kind, holds, points in (("national", "phone", "m[1] <> '+'", 40), ("iban", "iban", mod97, 90), ("ssn", "ssn", issued, 40)):
        spans.append(f"SELECT rid, {pii.KINDS.index(kind)}, start, start + length(m), false FROM s_{source} WHERE {holds} AND {points} + {bonus(kind)} >= {pii.MIN_SCORE}")
    ctes.append("spans AS (" + " UNION ALL ".join(spans) + ")")
    kinds = "[" + ", ".join(f"'{k}'" for k in pii.KINDS) + "]"
    ctes.append(f"written AS (SELECT *, {kinds}[place + 1] || ':' || start || ':' || stop AS w FROM spans)")
    counts = ", ".join(f"count(*) FILTER (base AND place = {i}) AS n_{k}" for i, k in enumerate(pii.BASE_KINDS))
    return f"""WITH {", ".join(ctes)}
      SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(w, ',' ORDER BY place, start) FILTER (base), '')) AS base_sha256,
        coalesce(string_agg(w, ',' ORDER BY place, start), '') AS spans
      FROM d LEFT JOIN written USING (rid) GROUP BY rid"""


ORACLE["op11_personal_data"] = _personal_data_sql()


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors, components=16))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), *paths)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM rep),
ws AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT ws.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY ws.i) AS text
  FROM ws LEFT JOIN gone ON gone.doc_id = ws.doc_id AND gone.i = ws.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
