"""TF-IDF retrieval from long documents whose postings are neither stored nor moved.

A document's length needs the document frequency of each of its terms. Documents are dealt in chunks by id, and a chunk
asks for its distinct terms: it sends their keys, packed and sorted, to ranges of the key space and gets the
frequencies back in the same order. Only terms that a query asks for leave the chunk as postings.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions.text import clean_text, word_tokens
from rankflow.operators.text_index import QUERY_ROWS, _idf, _normalized, _rank, _sparse_topk, term_counts
from rankflow.sources.scratch import materialize

# Characters of the documents of a chunk, and of those whose terms make up one range of the key space.
CHUNK_CHARS = 6_000_000
RANGE_CHARS = 24_000_000


def _codec():
    """Arrays as compressed bytes: the bytes of equal weight of all numbers stand together."""

    def squeeze(x) -> bytes:
        import numpy as np

        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
        return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)

    def expand(data: bytes, n: int, kind: str):
        import numpy as np

        size = np.dtype(kind).itemsize
        planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
        return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()

    return squeeze, expand


def _keys():
    """Terms as keys of 64 bits and checks of 16 more, of the words' digests; a bigram's come from its two words."""

    def digests(words):
        import hashlib

        import numpy as np

        joined = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words)
        return np.frombuffer(joined, "<u8").reshape(-1, 2).T

    def mixed(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def bigrams(a, b):
        import numpy as np

        key = mixed(a[0] ^ mixed(b[0] + np.uint64(0x9E3779B97F4A7C15)))
        return key, mixed(a[1] + mixed(b[1] ^ key))

    def check(x):
        import numpy as np

        return (x >> np.uint64(48)).astype("<u2")

    return digests, bigrams, check


def _pack():
    """Rows (chunk, item_id, words) to one row per chunk and batch, the texts compressed together."""

    def pack(batches):
        import numpy as np

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else []:
                text = "\n".join(batch.column("words").take(pa.array(rows)).to_pylist()).encode()
                ids = batch.column("item_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk[rows[:1]]),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([len(text)], pa.int64()),
                        pa.array([pa.compress(text, codec="zstd", asbytes=True)], pa.binary()),
                    ],
                    names=["chunk", "ids", "size", "texts"],
                )

    return pack


def _reader():
    """The terms of a chunk, in an order that only its texts decide.

    ids of its documents, ascending; key and check of every distinct term, ascending; and (document, term, tf).
    """
    digests, bigrams, check = _keys()

    def read(table: pa.Table):
        import numpy as np
        import pyarrow.compute as pc

        lines = []
        for data, size in zip(table.column("texts").to_pylist(), table.column("size").to_pylist(), strict=True):
            lines += pa.decompress(data, size, codec="zstd", asbytes=True).decode().split("\n")
        ids = pa.concat_arrays([c.flatten() for c in table.column("ids").chunks]).dictionary_encode("encode")
        by_id = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        row_doc = place[ids.indices.to_numpy()]

        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        words, row = split.flatten(), pc.list_parent_indices(split)
        there = pc.not_equal(words, "")
        words, row = words.filter(there).dictionary_encode(), row.filter(there).to_numpy()
        del lines, split, there
        digest = digests(words.dictionary.to_pylist())
        order = np.lexsort((digest[1], digest[0]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        digest, code = digest[:, order], place[words.indices.to_numpy()]
        n = len(order)
        del words

        near = row[1:] == row[:-1]
        pair, at = np.unique(code[:-1][near] * n + code[1:][near], return_inverse=True)
        key, rest = bigrams(digest[:, pair // max(n, 1)], digest[:, pair % max(n, 1)])
        key, checks = np.concatenate([digest[0], key]), check(np.concatenate([digest[1], rest]))
        order = np.argsort(key)
        if (np.diff(key[order]) == 0).any():
            order = np.lexsort((checks, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[np.concatenate([code, n + at])]
        doc = row_doc[np.concatenate([row, row[1:][near]])]
        del pair, at, code, row, near, rest
        doc = doc * max(1, len(order)) + term
        del term
        seen, tf = np.unique(doc, return_counts=True)
        doc, term = np.divmod(seen, max(1, len(order)))
        return ids.dictionary.take(pa.array(by_id)), key[order], checks[order], doc, term, tf

    return read


def _request(bits: int):
    """The distinct terms of a chunk, by range: keys as differences, checks, and documents of the chunk with the term."""
    read, (squeeze, _) = _reader(), _codec()

    def request(chunk, table):
        import numpy as np

        _, key, check, _, term, _ = read(table)
        df = np.bincount(term, minlength=len(key)).astype("<u4")
        part = (key >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]])
        spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                "chunk": pa.array([chunk[0].as_py()] * len(spans), pa.int32()),
                "n": pa.array([b - a for a, b in spans], pa.int64()),
                "keys": pa.array([squeeze(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                "checks": pa.array([squeeze(check[a:b]) for a, b in spans], pa.binary()),
                "dfs": pa.array([squeeze(df[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return request


def _asked(bits: int):
    """(term_id, term) to (part, term_id, key, check)."""
    digests, bigrams, check = _keys()

    def asked(batches):
        import numpy as np

        for batch in batches:
            words = [t.split(" ") for t in batch.column("term").to_pylist()]
            first, last = digests([w[0] for w in words]), digests([w[-1] for w in words])
            key, rest = np.where([len(w) > 1 for w in words], bigrams(first, last), first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((key >> np.uint64(64 - bits)).astype(np.int32)),
                    batch.column("term_id"),
                    pa.array(key.astype("<u8").view("<i8")),
                    pa.array(check(rest).astype(np.int32)),
                ],
                names=["part", "term_id", "key", "check"],
            )

    return asked


def _answer():
    """Document frequencies of a range: to each chunk in the order it asked, and of the queries' terms.

    ``spots`` and ``terms`` tell a chunk which of its terms queries ask for. The frequencies of the queries' own terms
    go to a chunk without documents.
    """
    squeeze, expand = _codec()

    def answer(part, requests, asked):
        import numpy as np

        sizes = requests.column("n").to_pylist()
        column = lambda name, kind: [expand(x, n, kind) for x, n in zip(requests.column(name).to_pylist(), sizes, strict=True)]
        key = np.concatenate([*(np.cumsum(x, dtype=np.uint64) for x in column("keys", "<u8")), asked.column("key").to_numpy().view("<u8")])
        check = np.concatenate([*column("checks", "<u2"), asked.column("check").to_numpy().astype("<u2")])
        df = np.concatenate([*column("dfs", "<u4"), np.zeros(asked.num_rows, "<u4")])
        order = np.lexsort((check, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, df).astype("<u4")
        term = np.full(len(total), -1, np.int64)
        own = group[len(order) - asked.num_rows :]
        term[own] = asked.column("term_id").to_numpy()
        rows, low = [], 0
        for chunk, n in zip(requests.column("chunk").to_pylist(), sizes, strict=True):
            at = group[low : low + n]
            spots = np.flatnonzero(term[at] >= 0)
            rows.append((chunk, n, squeeze(total[at]), spots, term[at][spots]))
            low += n
        own = own[total[own] > 0]
        if len(own):
            rows.append((-1 - part[0].as_py(), len(own), squeeze(total[own]), np.arange(len(own)), term[own]))
        chunk, n, dfs, spots, terms = zip(*rows, strict=True) if rows else [()] * 5
        return pa.table(
            {
                "chunk": pa.array(chunk, pa.int32()),
                "part": pa.array([part[0].as_py()] * len(rows), pa.int32()),
                "n": pa.array(n, pa.int64()),
                "dfs": pa.array(dfs, pa.binary()),
                "spots": pa.array(spots, pa.list_(pa.int32())),
                "terms": pa.array(terms, pa.list_(pa.int64())),
            }
        )

    return answer


def _place(n_docs: float, id_type: pa.DataType):
    """Postings of the asked terms of a chunk, one row per document with its length over all of its terms."""
    read, (_, expand) = _reader(), _codec()

    def lists(ends, values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))

    def place(chunk, docs, answers):
        import numpy as np

        answers = answers.sort_by("part")
        sizes = answers.column("n").to_pylist()
        df = [expand(x, n, "<u4") for x, n in zip(answers.column("dfs").to_pylist(), sizes, strict=True)]
        df = np.concatenate([*df, np.zeros(0, "<u4")]).astype(np.int64)
        starts = np.repeat(np.cumsum([0, *sizes])[:-1], [len(x) for x in answers.column("spots").to_pylist()]).astype(np.int64)
        flat = lambda name: np.concatenate([*(c.flatten().to_numpy() for c in answers.column(name).chunks), np.zeros(0, np.int64)]).astype(np.int64)
        spots, terms = flat("spots") + starts, flat("terms")
        if not docs.num_rows:
            ids, length, ends, terms, tfs = pa.nulls(1, id_type), [None], [0, len(terms)], terms, df
        else:
            ids, key, _, doc, term, tf = read(docs)
            if len(key) != len(df):
                raise ValueError(f"{len(key)} terms in a chunk that asked for {len(df)}")
            idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
            length = np.sqrt(np.bincount(doc, ((1.0 + np.log(tf)) * idf[term]) ** 2, len(ids)))
            wanted = np.full(len(key), -1, np.int64)
            wanted[spots] = terms
            kept = wanted[term] >= 0
            doc, terms, tfs = doc[kept], wanted[term[kept]], tf[kept]
            own = np.unique(doc)
            ids, length = ids.take(pa.array(own)), length[own]
            ends = np.append(np.searchsorted(doc, own), len(doc))
        return pa.table(
            {
                "chunk": pa.array([chunk[0].as_py()] * len(ids), pa.int32()),
                "item_id": ids,
                "length": pa.array(length, pa.float64()),
                "terms": lists(ends, terms),
                "tfs": lists(ends, tfs),
            }
        )

    return place


def _score(k: int):
    """Top k documents of a chunk for each query of a block."""
    search = _sparse_topk("qid", k)

    def rows(table: pa.Table, name: str):
        import numpy as np

        return np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table.column(name).chunks)])

    def score(queries: pa.Table, docs: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        queries = queries.sort_by("qid")
        docs = docs.take(pc.sort_indices(docs.column("item_id"), null_placement="at_start"))
        sizes = lambda t: pc.list_value_length(t.column("terms")).to_numpy()
        q_term, idf = rows(queries, "terms").astype(np.int64), rows(queries, "idfs")
        terms, first = np.unique(q_term, return_index=True)
        d_term, doc = rows(docs, "terms").astype(np.int64), np.repeat(np.arange(docs.num_rows), sizes(docs))
        at = np.minimum(np.searchsorted(terms, d_term), max(0, len(terms) - 1))
        known = terms[at] == d_term if len(terms) else np.zeros(len(d_term), bool)
        tf, length = rows(docs, "tfs"), docs.column("length").to_numpy()
        weight = (1.0 + np.log(tf[known])) * idf[first[at[known]]] / length[doc[known]]
        found = search(
            pa.table({"qid": np.repeat(queries.column("qid").to_numpy(), sizes(queries)), "term": q_term, "weight": rows(queries, "weights")}),
            pa.table({"item_id": doc[known], "term": d_term[known], "weight": weight}),
        )
        return found.set_column(1, "item_id", docs.column("item_id").take(found.column("item_id").cast(pa.int64())))

    return score


def retrieve_documents(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, query_col: str = "query_text", k: int = 200) -> DataFrame:
    """(query text, rank, item_id, score) for every distinct query text, as ``retrieve_texts`` over ``fit(docs)``.

    Rows of one id are one document. Words and word pairs are terms. For queries that are few against the documents'
    terms; the index itself is not kept.
    """
    texts = texts.select(query_col).distinct().withColumn("_clean", clean_text(F.col(query_col)))
    counts = materialize(term_counts(texts.select("_clean").distinct(), "_clean", F.col("_clean")), "query-counts")
    numbered = lambda c, name: counts.select(c).distinct().withColumn(name, F.monotonically_increasing_id())
    asked, keys = materialize(numbered("term", "term_id"), "asked-terms"), materialize(numbered("_clean", "qid"), "query-keys")

    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text_col)).alias("chars")).first()
    n_chunks = math.ceil((total["chars"] or 1) / CHUNK_CHARS)
    bits = max(1, math.ceil(math.log2(max(1, total["chars"] or 1) / RANGE_CHARS)))
    id_field = T.StructField("item_id", docs.schema[id_col].dataType)
    id_type = docs.select(F.col(id_col)).limit(0).toArrow().schema.field(0).type

    # Every use of the packed texts reads the same exchange by chunk, which Spark makes once.
    chunk = F.pmod(F.xxhash64(id_col), F.lit(n_chunks)).cast("int").alias("chunk")
    words = docs.select(chunk, F.col(id_col).alias("item_id"), F.array_join(word_tokens(F.col(text_col)), " ").alias("words"))
    packed = words.mapInArrow(_pack(), T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("size", T.LongType()), T.StructField("texts", T.BinaryType())]))
    requests = packed.groupBy("chunk").applyInArrow(_request(bits), "part int, chunk int, n long, keys binary, checks binary, dfs binary")
    wanted = asked.mapInArrow(_asked(bits), "part int, term_id long, key long, check int")
    answers = requests.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(
        _answer(), "chunk int, part int, n long, dfs binary, spots array<int>, terms array<long>"
    )
    fields = T.StructType([T.StructField("chunk", T.IntegerType()), id_field, T.StructField("length", T.DoubleType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    placed = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_place(float(total["n"]), id_type), fields)
    placed = materialize(placed, "asked-postings")

    n = F.lit(float(total["n"]))
    dfs = placed.where("chunk < 0").select(F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(F.col("t.terms").alias("term_id"), F.col("t.tfs").alias("df"))
    known = asked.join(dfs, "term_id").select("term", "term_id", _idf(n).alias("idf"))
    raw = counts.join(known, "term").join(keys, "_clean").withColumn("w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    weights = _normalized(raw.select("qid", F.col("term_id").alias("term"), "w"), "qid")
    q = raw.select("qid", F.col("term_id").alias("term"), "idf").join(weights, ["qid", "term"]).groupBy("qid")
    q = q.agg(F.array_sort(F.collect_list(F.struct("term", "weight", "idf"))).alias("t"))
    q = materialize(q.select("qid", *[F.col(f"t.{c}").alias(f"{c}s") for c in ("term", "weight", "idf")]), "query-weights")

    qb = q.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("terms")) / QUERY_ROWS)).cast("long").alias("n")).first()["n"] or 1
    blocks = F.sequence(F.lit(0), F.lit(n_chunks - 1))
    q = q.select("*", F.pmod(F.xxhash64("qid"), F.lit(qb)).alias("qblock"), F.explode(blocks).alias("chunk"))
    d = placed.where("chunk >= 0").withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))))
    by = ["qblock", "chunk"]
    found = T.StructType([T.StructField("qid", T.LongType()), id_field, T.StructField("score", T.DoubleType())])
    partial = q.groupBy(*by).cogroup(d.groupBy(*by)).applyInArrow(_score(k), found)
    ranked = _rank(partial, "qid", k).join(keys, "qid")
    return texts.join(ranked, "_clean").select(query_col, "rank", "item_id", "score")
