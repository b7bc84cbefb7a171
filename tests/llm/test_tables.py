"""Operators 2 and 9, the registered queries and the pipeline."""

import base64
import glob
import gzip
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import CLASHING, documents, empty_documents, odd_documents, texts, words
from pyspark.sql import functions as F
from test_copies import slow_components, slow_fingerprint, slow_words
from test_texts import slow_overlap

from rankflow.llm import kd_search, pipeline, queries, warc
from rankflow.sources.scratch import scratch_path

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in CLASHING]).repartition(3)


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/ 4\r\n", "<p>one</p>"), (5, "u", "é" * 50_000 + "\r\n" * 40_000),
    (6, "u", "\r\n"), (7, "u", "\r\r\n\n\r"), (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n"), (9, "u", "x" * (1 << 17)), (10, "u", "x" * (1 << 17)),
    (11, "u", "y" * 65535 + "\r\nz"), (12, "u", "y" * 65536 + "\r"), (None, "u", "<p>one</p>"), (None, None, None), (4, "again", "<p>one</p>"), (0, "u", "late\x00zero"),
]


def want_rows(rows, least=0):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if i is not None else None
        revisit = to is not None and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark, PAGES), path, least)
    chunks = warc.read_chunks(spark, path)
    got = warc.record_summary(chunks)
    assert got.where("not intact").count() == 0
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want_rows(PAGES, least)
    assert chunks.agg(F.max("length")).first()[0] <= warc.CHUNK
    for page, _, html in PAGES:
        parts = chunks.where((F.col("page_id") == page) & (F.col("record_type") == "response")).orderBy("chunk_no").collect()
        if page in (5, 7, 8, 9, 11, 12):
            assert b"".join(p.data for p in parts) == html.encode()
            sha = hashlib.sha1()
            for p in parts:
                sha.update(p.data)
                assert p.running_digest == base64.b32encode(sha.digest()).decode()


def test_archives_are_warc(spark):
    """Records are framed by their own Content-Length, and every HTTP chunk by its size."""
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark, PAGES), path)
    n = 0
    for name in glob.glob(f"{path}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            block, data = rest[:size], rest[size:]
            assert data.startswith(b"\r\n\r\n") and block.startswith(b"HTTP/1.1 200 OK\r\n")
            data, n = data[4:], n + 1
    assert n == len(PAGES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text(alphabet="ab\r\n\x000é", max_size=40), st.one_of(st.none(), st.integers(0, 9))), max_size=5))
def test_reader_reads_what_the_writer_writes(records):
    lines = [line for i, text, to in records for line in warc.record_lines(i, "u", text.encode(), to)]
    reader, raw = warc.Reader(), b"".join(line + b"\r\n" for line in lines)
    for line in raw.split(b"\r\n")[:-1]:
        reader.step(line)
    assert reader.step == reader.begin
    whole = [r for r in reader.rows if r[-1]]
    assert [(r[0], r[4], r[9]) for r in whole] == [(i, 0 if to is not None else len(t.encode()), to) for i, t, to in records]


def test_warc_of_empty_and_broken(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark, []), path)
    assert warc.record_summary(warc.read_chunks(spark, path)).count() == 0
    broken = scratch_path(spark, "broken")
    lines = [line.decode() for line in warc.record_lines(1, "u", b"abc", None)][:-6]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option("lineSep", "\r\n").text(broken)
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_chunks(spark, broken).count()


def slow_topk(rows, k, every):
    good = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        vec = min(v for i, v in good if i == q)
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(vec, v, strict=True)))), i) for i, v in good if i != q and len(v) == len(vec))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("shape", ["clusters", "uniform", "one vector", "huge"])
def test_kd_search_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(kd_search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(kd_search, "LEAF_ROWS", 8)
    rng = np.random.default_rng(3)
    n, d = 600, 6
    x = rng.normal(0, 1, (n, d))
    if shape == "clusters":
        x = 0.1 * x + rng.normal(0, 2, (9, d))[rng.integers(0, 9, n)]
    if shape == "one vector":  # a third of all rows
        x[: n // 3] = x[0]
    if shape == "huge":  # some scores are beyond a long
        x *= 3e7
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    odd = [(700, None), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (None, [1.0] * 6), (720, [1.0, 2.0]), (721, [3.0, 1.0]), (740, []), (741, [])]
    df = spark.createDataFrame([*rows, *odd, rows[5], rows[7]], "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = kd_search.exact_topk(df, F.col("vec_id") % 20 == 0, k=7, shard_rows=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = slow_topk([*rows, *odd, rows[5], rows[7]], 7, 20)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_kd_search_of_few_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kd_search.exact_topk(df, F.col("vec_id") % 20 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, kd_search.exact_topk(df, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


def test_queries_are_registered():
    assert {int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    from oracle_check import compare, duck

    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name]) is None


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(11)
    base = [(" ".join(words(rng, 120, lang)), lang) for lang in ("en", "de", "fr") * 25]
    shared = " ".join(words(rng, 30))
    items = [(i, " ".join(words(rng, 25))) for i in range(5)]
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(base)]
    near = base[0][0].split()
    near[60] = "edited"
    extra = [base[3][0], " ".join(near), base[6][0] + " " + shared, base[9][0] + "\n" + shared + " end", " ".join(words(rng, 70)) + " " + items[2][1], "123 456 ...", None, ""]
    rows += [(100 + i, t, "en", "s", 1) for i, t in enumerate(extra)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, rows)
    sf = str(tmp_path)

    one = pipeline.language_stage(spark, docs, sf)
    gone = {r[0] for r in rows} - {r.doc_id for r in one.collect()}
    assert {105, 106, 107} <= gone and len(gone) <= 4 and one.columns == docs.columns

    two = pipeline.near_duplicate_stage(spark, one, sf)
    left = {r.doc_id for r in two.collect()}
    known = sorted((r.doc_id, r.text) for r in one.collect())
    prints = [slow_fingerprint(t, 3) for _, t in known]
    assert left == set(slow_components([i for i, _ in known], prints, 3)) and two.columns == docs.columns
    assert (3 in left) + (100 in left) == 1

    three = pipeline.substring_stage(spark, two, sf)
    before = sorted((r.doc_id, r.text) for r in two.collect())
    after = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and len(after) == len(before)
    for (i, _, removed, sha), (_, text) in zip(slow_words(before, 20), before, strict=True):
        assert hashlib.sha256(b" ".join((after[i].text or "").encode().split())).hexdigest() == sha
        assert removed or after[i].text == text
        assert not removed or after[i].n_chars == len(after[i].text)
    assert sum(x[2] for x in slow_words(before, 20)) >= 30

    four = pipeline.benchmark_stage(spark, three, sf)
    want = {i for i, r in after.items() if not any(slow_overlap(r.text or "", t) for _, t in items)}
    assert {r.doc_id for r in four.collect()} == want and four.columns == docs.columns
    assert after.keys() - want

    five = pipeline.packing_stage(spark, four, sf)
    assert {r.doc_id for r in five.collect()} == want
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_stages_stand_odd_tables(spark, make, tmp_path):
    docs = make(spark)
    spark.createDataFrame([(1, texts()[0][0]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and (name != "substring dedup" or out.count() == docs.count())
    corpus_pipeline.run(spark, str(tmp_path)).count()


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    docs = documents(spark, [(5, "the same words in this text", "en", "s", 1)] * 3 + [(None, "the same words in this text", "en", "s", 1), (6, "other words are in that one", "en", "s", 1)])
    assert sorted(r.text for r in pipeline.near_duplicate_stage(spark, docs, "").collect()) == ["other words are in that one", "the same words in this text"]
