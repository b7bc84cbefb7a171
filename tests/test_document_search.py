"""Retrieval from documents by frequencies that chunks ask for, against the index of all postings."""

import pytest

from rankflow.operators import document_search as DS
from rankflow.operators import text_index as D
from rankflow.plans import registry

registry.load_all()

TEXTS = ["red ring blue bolt", "Blue bolt, blue bolt\nred", None, "", "grün ring a b red ring", "paint paint paint red", "x", "gear red ring", "blue"]
ASKED = ["red ring", "Blue bolt!", "red", "nothing known", "", None, "paint red gear", "ring red"]


@pytest.fixture
def docs(spark):
    """120 rows of 9 texts, some of them a little changed; 6 ids that come twice, some texts null."""
    rows = [(i % 114, TEXTS[i * 7 % 9] and TEXTS[i * 7 % 9] + (" extra" * (i % 3))) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def asked(spark):
    return spark.createDataFrame([(t,) for t in ASKED], "query_text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k", [3, 200])
@pytest.mark.parametrize("blocks", [False, True])
def test_documents_equal_the_whole_index(spark, docs, monkeypatch, k, blocks):
    if blocks:  # several chunks of documents, ranges of keys and blocks of queries
        for name, n in (("CHUNK_CHARS", 200), ("RANGE_CHARS", 100), ("QUERY_ROWS", 4)):
            monkeypatch.setattr(DS, name, n)
    index = D.fit(docs, "text", id_col="doc_id")
    index = D.TextIndex(index.terms, index.postings.withColumnRenamed("doc_id", "product_id"))
    want = rows(D.retrieve_texts(index, asked(spark), k=k))
    got = rows(DS.retrieve_documents(docs, asked(spark), "doc_id", "text", k=k))
    assert got == want and len(got) > 3


def test_ids_may_be_null_or_strings(spark):
    docs = spark.createDataFrame([(None, "red ring"), ("b", "red ring"), ("a", "red bolt"), (None, "ring")], "doc_id string, text string")
    got = DS.retrieve_documents(docs, spark.createDataFrame([("ring",)], "query_text string"), "doc_id", "text")
    assert [r["item_id"] for r in got.orderBy("rank").collect()] == [None, "b"]


def test_terms_that_no_query_asks_for_are_no_rows(spark, docs, tmp_path, monkeypatch):
    bench = spark.createDataFrame([(0, "red ring"), (1, "blue bolt")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stored, keep = [], D.materialize

    def recorded(df, name, *more):
        stored.append((df.inputFiles(), df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, name, *more)

    for module in (D, DS):
        monkeypatch.setattr(module, "materialize", recorded)
    assert registry.QUERIES["d4_text_retrieval_documents"](spark, str(tmp_path)).count() > 0
    plans = [p for files, p in stored if any("documents.parquet" in f for f in files)]
    assert plans and not any("Generate explode" in p for p in plans)
