"""Operators 4, 5, 6, 8 and 10: held-out accuracy, brute force and the tokenizers' own results."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_data import documents, empty_documents, odd_documents, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankflow.llm import decontaminate, language_id, packing, token_counts, toxicity
from rankflow.llm.common import crc_mod

SP = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = "abcdefgh  \n\t▁é漢字💥'st'll.!?ÀΣσ́<s></s>  \x85\x1c<|endoftext|>０1"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(n)]
    prose = ["".join(rng.choice("etaoin shrdlu THE") for _ in range(rng.randrange(400))) for _ in range(n // 2)]
    return ["", " ", "   a   b", "a" * 700, "▁▁ x", "\x00a", "<|endoftext|>a<|startoftext|>", "t" * 40 + " e" * 40, *mixed, *prose]


def test_crc_mod_is_that_of_the_id_as_text(spark):
    df = spark.range(50).select("id", crc_mod("id", 4).alias("m"))
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in df.collect())


def test_token_counts_equal_the_library():
    texts = odd_texts(1500)
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=SP).encode(texts, num_threads=1)]
    counts = token_counts.WordCounts(token_counts.PieceMerges(SP))
    assert counts.of(texts) == want
    assert counts.of(texts[:20]) == want[:20]


def test_token_counts_forget_words(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 50)
    counts = token_counts.WordCounts(token_counts.PieceMerges(SP))
    lib = sentencepiece.SentencePieceProcessor(model_file=SP)
    for text in odd_texts(60, 3):
        assert counts.of([text]) == [len(lib.encode(text))]


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_count_tokens(spark, make):
    docs, lib = make(spark), sentencepiece.SentencePieceProcessor(model_file=SP)
    got = token_counts.count_tokens(docs, SP, limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "")), n > 100) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(empty_documents(spark), SP).count() == 0


def test_chunk_tokens_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 300)
    lib, chunks = Tokenizer.from_file(WORDS), packing.ChunkTokens(WORDS)
    texts = odd_texts(1500, 2)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        ids, count = chunks.of(part)
        cut = np.split(ids, np.cumsum(count)[:-1])
        assert [x.tolist() for x in cut] == [lib.encode(t, add_special_tokens=False).ids for t in part]


def slow_cost(cuts, ends, sentence, size):
    cost, last = 0.0, 0
    for c in cuts:
        n = c - last
        assert 0 < n <= size
        cost += 0 if n & (n - 1) == 0 else size - n
        cost += 0 if c in ends else (packing.SENTENCE_PENALTY if c in sentence else packing.INSIDE_PENALTY) * size
        last = c
    return cost


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for size in (16, 64):
        for _ in range(25):
            ends = np.cumsum([rng.randrange(1, 3 * size) for _ in range(rng.randrange(1, 12))])
            n = int(ends[-1])
            sentence = np.array(sorted({rng.randrange(1, n + 1) for _ in range(n // 5)}), np.int64)
            got = packing.choose_cuts(ends, sentence, size)
            assert got[-1] == n
            allowed = sorted(set(ends.tolist()) | set(sentence.tolist()) | {0})
            for a, b in zip(allowed.copy(), allowed[1:], strict=False):
                if b - a > size / 16:
                    allowed += range(a + max(1, size // 64), b, max(1, size // 64))
            best = {0: 0.0}
            for i in sorted(set(allowed))[1:]:
                own = 0 if i in ends else (packing.SENTENCE_PENALTY if i in sentence else packing.INSIDE_PENALTY) * size
                best[i] = own + min(best[j] + (0 if (i - j) & (i - j - 1) == 0 else size - i + j) for j in best if 0 < i - j <= size)
            assert slow_cost(got.tolist(), set(ends.tolist()), set(sentence.tolist()), size) == pytest.approx(best[n])


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_packing_round_trip(spark, make, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    docs, lib = make(spark), Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, WORDS, max_tokens=256, with_ids=True).collect()
    sequences = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.r_[0, np.cumsum([p.length for p in parts])[:-1]].tolist()
        assert sum(p.length for p in parts) == parts[0].sequence_tokens <= 256
    # Pieces of one partition follow each other, so texts can be put together again.
    texts, open_ids = [], []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.start == len(open_ids)
        open_ids += r.ids
        if len(open_ids) == r.doc_tokens:
            texts.append((r.doc_id, tuple(open_ids)))
            open_ids = []
    want = [(r.doc_id, (*lib.encode(r.text or "", add_special_tokens=False).ids, 1)) for r in docs.collect()]
    assert sorted(texts, key=str) == sorted(want, key=str) and not open_ids
    pad = sum(0 if (n := p[0].sequence_tokens) & (n - 1) == 0 else 256 - n for p in sequences.values())
    assert pad < 0.03 * sum(r.length for r in rows)
    assert packing.pack_documents(empty_documents(spark), WORDS).count() == 0


def language_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr"])
        rows.append((i, " ".join(words(rng, rng.randrange(15, 120), lang)).capitalize() + ".", lang, "s", 1))
    return rows


def test_language_id_on_held_out_rows(spark):
    docs = documents(spark, language_rows(500))
    model = language_id.fit_language_id(docs.where(crc_mod("doc_id", 4) != 2))
    got = language_id.predict_language(docs, model, keep=["doc_id", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out")]).toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    again = language_id.predict_language(docs, model, keep=["doc_id"]).toPandas().set_index("doc_id").score
    assert (got.set_index("doc_id").score - again).abs().max() == 0


def test_language_id_of_odd_rows(spark):
    docs = odd_documents(spark)
    model = language_id.fit_language_id(docs)
    got = language_id.predict_language(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        und = r.text is None or not re.search(r"[^\W\d_]", r.text)
        assert (r.lang_pred == "und") == und and (not und or (r.score == 0 and r.rejected))
    assert language_id.predict_language(empty_documents(spark), model).count() == 0
    nothing = language_id.fit_language_id(empty_documents(spark))
    assert {r.lang_pred for r in language_id.predict_language(docs, nothing).collect()} == {"und"}
    assert language_id.fit_language_id(docs.withColumn("lang", F.lit(None).cast("string"))).classes == []
    one = language_id.fit_language_id(documents(spark, [(1, "only one text", "en", "s", 1)]))
    assert [r.lang_pred for r in language_id.predict_language(documents(spark, [(2, "text", None, None, None)]), one).collect()] == ["en"]


def test_language_gradients():
    """One step of training lowers the loss on what it was trained on."""
    texts = ["the thing on the wh", "schung ver ich", "eau oir que ais"] * 20
    labels = ["en", "de", "fr"] * 20
    features = []
    for t in texts:
        ids, count = np.unique(language_id.subwords([t])[0], return_counts=True)
        features.append((ids, count.astype(np.float32)))
    model = language_id.train(features, labels)
    assert [model.classes[i] for i in model.predict(texts[:3])[0]] == labels[:3]


def toxic_rows(n, seed=3):
    """Insults alone are half of the clean texts too; an insult together with a group is toxic."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = words(rng, rng.randrange(10, 60))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["badword"] * insult + ["groupname"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(insult and group)))
    return rows, marks


def test_toxicity_learns_pairs_of_terms(spark):
    rows, marks = toxic_rows(3000)
    docs = documents(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = crc_mod("doc_id", 5) == 0
    model = toxicity.fit_toxicity(docs.where(~held), labels.where(~held))
    got = toxicity.score_toxicity(docs, model, keep=["doc_id", held.alias("held_out")]).toPandas().merge(labels.toPandas(), on="doc_id")
    h = got[got.held_out]
    assert (h.toxic == h.predicted).mean() > 0.95 and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_factorization_machine_is_its_formula():
    rng = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(0.3, rng.normal(0, 1, 8), rng.normal(0, 0.5, (8, 3)))
    ids = np.array([0, 3, 5, 1])
    got = model.score(ids, np.array([3, 0, 1]))
    for s, own in zip(got, ([0, 3, 5], [], [1]), strict=True):
        z = 0.3 + sum(model.weight[i] for i in own) + sum(model.factor[i] @ model.factor[j] for i in own for j in own if i < j)
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(20)] + [(None, 1, 1), (4, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(empty_documents(spark), model).count() == 0
    none = toxicity.fit_toxicity(empty_documents(spark), labels)
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0


def slow_overlap(text, item):
    """By counting in every segment of every alignment: enough equal words, and four in five of the segment."""
    t, w = decontaminate.words_of(text), decontaminate.words_of(item)
    if not w:
        return False
    need = len(w) if len(w) < 8 else min(12, -(-4 * len(w) // 5))
    for shift in range(-len(w) + 1, len(t)):
        equal = [0 <= shift + i < len(t) and t[shift + i] == x for i, x in enumerate(w)]
        if sum(equal) < need:
            continue
        for low in range(len(w)):
            for high in range(low + need, len(w) + 1):
                matched = sum(equal[low:high])
                if matched >= need and 5 * matched >= 4 * (high - low):
                    return True
    return False


def leak_fixture(seed=4):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.randrange(8, 40)))) for i in range(25)] + [(90, None), (91, "too short item"), (92, "")]
    rows, truth = [], set()
    for i in range(80):
        w = words(rng, rng.randrange(5, 120))
        kind = i % 4
        if kind:
            item, text = items[rng.randrange(25)]
            part = text.split()
            if kind == 2:
                for at in range(3, len(part), 6):
                    part[at] = "swapped"
            if kind == 3:
                part = part[: len(part) // 2]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [p.upper() + "!" for p in part] + w[at:]
        rows.append((i, " ".join(w), "en", "s", 1))
    return rows, items


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rows, items = leak_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j) for i, t, *_ in rows for j, text in items if slow_overlap(t, text or "")}
    assert len(want) > 40
    for block in (1 << 20, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        docs = documents(spark, rows)
        got = decontaminate.overlaps(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.similarity >= 0.8 and r.matched_words <= r.run_words for r in got)
        kept = decontaminate.without_overlaps(docs, bench)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in want}


def test_decontamination_of_odd_rows(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, docs.where("doc_id = 9").first().text), (None, None)], "item_id long, text string")
    hits = decontaminate.overlaps(docs, bench)
    assert {r.doc_id for r in hits.collect()} >= {9}
    kept = decontaminate.without_overlaps(docs, bench)
    assert kept.where("text is null").count() == docs.where("text is null").count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, none).count() == 0 and decontaminate.without_overlaps(docs, none).count() == docs.count()
    assert decontaminate.overlaps(empty_documents(spark), bench).count() == 0


def test_every_mask_tolerates_substitutions():
    """Any 12 of 15 aligned words with one substitution in five leave a seed untouched."""
    rng = random.Random(1)
    w = [f"w{i}" for i in range(15)]
    table = decontaminate.seed_table([(1, " ".join(w))])
    for _ in range(300):
        t = list(w)
        for at in rng.sample(range(15), 3):
            t[at] = "other"
        run = decontaminate.best_run(np.array([a == b for a, b in zip(t, w, strict=True)]))
        good = sum(x != "other" for x in t[run[0] : run[1]]) >= 12
        assert bool(table.hits([" ".join(t)])) == good


def test_overlaps_by_plain_hamming_similarity():
    """Whole items of 8 to 20 words with substitutions anywhere: found if four words in five are equal."""
    rng = random.Random(7)
    for n in range(8, 21):
        w = [f"w{i}" for i in range(n)]
        table = decontaminate.seed_table([(1, " ".join(w))])
        for trial in range(120):
            t = list(w)
            off = trial % (n // 5 + 2)
            for at in rng.sample(range(n), off):
                t[at] = f"other{at}"
            hits = table.hits([" ".join(["before"] * 9 + t + ["after"] * 9)])
            if 5 * off <= n:
                assert hits and hits[0][2] == n - off, (n, t)
            elif n <= 15:  # of longer ones, 12 words may still be an overlap
                assert not hits, (n, t)


def test_overlaps_with_short_items_and_unspaced_scripts():
    items = [(1, "Too short, item!"), (2, "one"), (3, "这是一个完整的测试问题"), (4, "हिन्दी में लिखा गया छोटा सवाल"), (5, "どこ"), (6, None), (7, "...")]
    table = decontaminate.seed_table(items)
    texts = ["a too short item here", "too short other item", "none or oneself", "it is One.", "他说：“这是一个完整的考试问题”。", "यह हिन्दी में, लिखा गया छोटा सवाल है", "駅はどこですか", "में लिखा गया छोटा सवाल", "..."]
    found = {(text, table.item_ids[item]) for text, item, *_ in table.hits(texts)}
    assert found == {(0, 1), (3, 2), (4, 3), (5, 4), (6, 5)}
    assert decontaminate.words_of("naïve—Café “x”\u00a0y") == ["naïve".encode(), "café".encode(), b"x", b"y"]
