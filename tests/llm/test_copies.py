"""Operators 1, 3 and 7 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from llm_data import documents, empty_documents, odd_documents, words

from rankflow.llm import automaton_dedup, pipeline, repeats, simhash, suffix_dedup
from rankflow.llm.components import connected_components, star_forest


def slow_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_simhash(spark, make):
    docs = make(spark)
    got = simhash.near_duplicates(docs, shingle=3, radius=3).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [slow_fingerprint(t, 3) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, slow_components([i for i, _ in rows], fps, 3), strict=True), key=str)
    assert sorted([(r.id, r.fp % (1 << 64), r.component) for r in got], key=str) == want
    assert any(c != i for i, _, c in want)


def test_simhash_of_dense_groups(spark, monkeypatch):
    """Many fingerprints close together, more than a block; chains over several links."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    fps, base = set(), [rng.getrandbits(64) for _ in range(4)]
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    rows = [(i, x - ((x >> 63) << 64)) for i, x in enumerate(sorted(fps, key=lambda x: x * 7919 % 1000003))]
    df = spark.createDataFrame(rows, "id long, fp long")
    got = {r.id: r.component for r in simhash.components_of(df, simhash.near_links(df, 3)).collect()}
    want = slow_components([i for i, _ in rows], [f % (1 << 64) for _, f in rows], 3)
    assert [got[i] for i, _ in rows] == want


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5), (3, 2), (3, 2), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for link in links if None not in link for n in link if link[0] != link[1]}
    for _ in range(200):
        for a, b in links:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert star_forest(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_stage_keeps_one_of_each_group(spark):
    """The pipeline's stage against brute force: links of 3 or fewer bits between prints of 3-word shingles."""
    rng = random.Random(8)
    rows = []
    for _ in range(30):
        base = words(rng, 260)
        for edits in (0, 0, 1, 2, 40):
            w = list(base)
            for place in rng.sample(range(260), edits):
                w[place] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    left = {r.doc_id for r in pipeline.near_duplicate_stage(spark, documents(spark, rows), "").collect()}
    want = slow_components([r[0] for r in rows], [slow_fingerprint(r[1], 3) for r in rows], 3)
    assert left == set(want)
    assert 30 < len(left) < 115
    assert pipeline.near_duplicate_stage(spark, empty_documents(spark), "").count() == 0


def slow_bytes(rows, w):
    count = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, t in data:
        for p in range(len(t) - w + 1):
            count[t[p : p + w]] = count.get(t[p : p + w], 0) + 1
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - w + 1):
            if count[t[p : p + w]] > 1:
                gone[p : p + w] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def slow_words(rows, w):
    """rows in order: (id, text)."""
    seen, out = set(), []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for p in range(len(ws) - w + 1):
            key = tuple(ws[p : p + w])
            if key in seen:
                gone[p : p + w] = [True] * w
            seen.add(key)
        out.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("make", [documents, odd_documents])
@pytest.mark.parametrize("split", [False, True])
def test_suffix_array_dedup(spark, monkeypatch, make, split):
    if split:  # every anchor is dealt to many shards, every text taken in stretches
        monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1)
        monkeypatch.setattr(repeats, "STRETCH", 500)
    docs = make(spark)
    for w in (60, 400):
        got = suffix_dedup.remove_repeats(docs, window=w)
        columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        want = slow_bytes([(r.doc_id, r.text) for r in docs.collect()], w)
        assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
        assert any(x[2] for x in want)


@pytest.mark.parametrize(("kind", "width"), [(repeats.Windows(400, 32, words=False), 47), (repeats.Windows(20, 5, words=True), 2), (repeats.Windows(20, 5, words=True), 1)])
def test_narrowed_groups_keep_equal_windows_together(kind, width):
    """Around one common anchor: equal windows meet in one group, and a class gives at most a few stretches."""
    rng = random.Random(5)
    pieces = [[rng.choice(words(rng, 40)).encode() for _ in range(90)] for _ in range(4)]
    contexts, seen = {}, 0
    for i in range(60):
        left, right = rng.choice(pieces), rng.choice(pieces)
        text = b" ".join(left[: rng.randrange(20, 90)] + pieces[0][:25] + right[rng.randrange(60) :])
        for _, first, last, anchor in repeats.runs_of([text], kind):
            for p, q, h in zip(first.tolist(), last.tolist(), anchor.view(np.int64).tolist(), strict=True):
                symbols = text.split() if kind.words else text
                part = symbols[p : q + kind.size]
                contexts.setdefault(h, {})[b" ".join(part) if kind.words else part] = (i, p, q - p + 1)
    assert repeats.narrowing_widths(kind)[-1] == 1 and width in repeats.narrowing_widths(kind)
    for h, found in contexts.items():
        columns = [[h] * len(found), [0] * len(found), [1] * len(found), [i for i, _, _ in found.values()], [i for i, _, _ in found.values()]]
        columns += [[p for _, p, _ in found.values()], [n for _, _, n in found.values()]]
        batch = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(list(found), pa.binary())], names=repeats.CLASS_COLUMNS)
        rows = pa.Table.from_batches(list(repeats._narrow_task(kind, width)(iter([batch])))).to_pylist()
        assert len(rows) <= len(found) * -(-(kind.size - kind.gram + 1) // width)
        assert sum(r["windows"] for r in rows) == sum(n for _, _, n in found.values())
        groups = {}
        for r in rows:
            symbols = r["content"].split() if kind.words else r["content"]
            assert len(symbols) == r["windows"] + kind.size - 1
            for w in range(r["windows"]):
                window = symbols[w : w + kind.size]
                assert groups.setdefault(tuple(window), r["anchor"]) == r["anchor"]
                seen += 1
            if width == 1:
                assert r["windows"] == 1
    assert seen > 1000


@pytest.mark.parametrize("hot", [3, 40])
def test_dedup_around_a_common_passage(spark, monkeypatch, hot):
    """One passage in every text, with other words around it: its anchors have as many classes as there are texts."""
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    monkeypatch.setattr(automaton_dedup, "HOT_CLASSES", hot)
    rng = random.Random(31)
    passage, tails = " ".join(words(rng, 40)), [" ".join(words(rng, 30)) for _ in range(7)]
    rows = [(i, " ".join(words(rng, 25)) + " " + passage + " " + rng.choice(tails) + " " + " ".join(words(rng, 5)), "en", "s", 1) for i in range(70)]
    docs = documents(spark, rows)
    plain = [(i, t) for i, t, *_ in rows]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in suffix_dedup.remove_repeats(docs, window=100).collect()) == slow_bytes(plain, 100)
    got = automaton_dedup.remove_repeats(docs, window=12).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == slow_words(plain, 12)


def test_contexts_of_texts_that_pack_small():
    """17 MiB of text in one slice of 20 KB: places must not run into the hash bits, and no slice may hold all."""
    kind = repeats.Windows(400, 32, words=False)
    texts = [(f"the line of page {i:03d} again and again\n".encode() * 30000)[: repeats.STRETCH] for i in range(17)]
    wanted = [np.unique(np.concatenate([a for *_, a in repeats.runs_of([t], kind)])).view(np.int64) for t in texts]
    rows = pa.array(range(17), pa.int64())
    packed = pa.array(map(zstandard.ZstdCompressor(level=1).compress, texts), pa.binary())
    batch = pa.RecordBatch.from_arrays([rows, rows, packed, pa.array(wanted, pa.list_(pa.int64()))], names=["row", "id", "packed", "anchors"])
    windows = np.zeros(17, np.int64)
    for out in repeats._context_task(kind)(iter([batch])):
        np.add.at(windows, out.column(0).to_numpy(), out.column(5).to_numpy())
    assert windows.tolist() == [repeats.STRETCH - 399] * 17


@pytest.mark.parametrize("split", [False, True])
def test_automaton_dedup(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(automaton_dedup, "HOT_CLASSES", 1)
        monkeypatch.setattr(repeats, "STRETCH", 300)
    docs = documents(spark)
    for w in (7, 20):
        got = automaton_dedup.remove_repeats(docs, window=w).select("doc_id", "n_words", "n_removed", "kept_sha256")
        want = slow_words(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), w)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert sum(x[2] for x in want) > 100


def test_automaton_dedup_of_odd_ids(spark):
    """Which of several rows with one id comes first is open; the number of words that go is not."""
    docs = odd_documents(spark)
    got = automaton_dedup.remove_repeats(docs, window=20).collect()
    assert len(got) == docs.count()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want = slow_words([(i if known else None, t) for known, i, t in order], 20)
    assert sum(r.n_removed for r in got) == sum(x[2] for x in want) and sum(r.n_words for r in got) == sum(x[1] for x in want)


def test_empty_tables(spark):
    docs = empty_documents(spark)
    assert simhash.near_duplicates(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert automaton_dedup.remove_repeats(docs).count() == 0
    nothing = documents(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])
    assert [r.component for r in simhash.near_duplicates(nothing).collect()] == [1, 1]
    assert {r.n_removed for r in suffix_dedup.remove_repeats(nothing).collect()} == {0}
    assert {r.n_words for r in automaton_dedup.remove_repeats(nothing).collect()} == {0}


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for trial in range(25):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 300)))
        t = t + t + t[:30] if trial % 3 == 0 else t
        x = np.frombuffer(t, np.uint8)
        order = suffix_dedup.suffix_array(x)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        got = suffix_dedup.common_prefixes(x, order, 40)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :][:40], t[order[k] :][:40]
            assert got[k] == next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


@pytest.mark.parametrize("text", [b"abc\0\0", b"\0", b"\0" * 40, b"ab\0ab\0\0\0", b"\xff\0\xff\0", b"\xff" * 20 + b"\0" * 9, b"x" * 30 + b"\0"])
def test_suffix_array_of_texts_that_end_in_nuls(text):
    assert suffix_dedup.suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(100):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 6))]
        w = rng.randrange(1, 6)
        automaton, first = automaton_dedup.SuffixAutomaton(), {}
        for i in rng.sample(range(len(sequences)), len(sequences)):
            automaton.add(sequences[i], 1000 * i + 1)
        automaton.finish()
        for i, s in enumerate(sequences):
            for p in range(len(s) - w + 1):
                key = tuple(s[p : p + w])
                first[key] = min(first.get(key, automaton_dedup.NEVER), 1000 * i + p + w)
        for s in [*sequences, [rng.randrange(3) for _ in range(40)]]:
            assert automaton.window_ends(s, w) == [first.get(tuple(s[p : p + w]), automaton_dedup.NEVER) for p in range(len(s) - w + 1)]
