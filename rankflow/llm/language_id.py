"""Operator 4: language of a text by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of the lower-cased text, with signs and digits as word ends. Each has an
embedding in a hashed table; a text is the mean of its subwords' embeddings. Table and softmax are trained by
stochastic gradient descent (with per-row Adagrad steps) in numpy on a bounded sample of labelled rows. A
held-back part of the sample fits the softmax temperature and the score below which a prediction is rejected.
As the model is linear, table and softmax become one table of class weights per subword for prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import sliced, text_bytes

SIZES = (2, 3, 4)
BITS = 16
DIM = 16
EPOCHS = 6
BATCH = 16
RATE = 0.3
SAMPLE_ROWS = 2000
SEPARATOR = b"     "
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
TO_SPACE = bytes(b if b >= 128 or b in LETTERS else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")
REJECT_SHARE = 0.001
REJECT_AT_MOST = 0.35


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed subwords of all texts, text of each), for each n-gram size one after another."""
    parts = [SEPARATOR + t.lower().encode("utf-8", "replace").translate(TO_SPACE) + SEPARATOR for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    x = np.frombuffer(b"".join(parts), np.uint8)
    if not len(x):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    # The second byte is a letter, so no n-gram reaches over the separators into another text.
    at = np.flatnonzero(x[1:] != 32)
    at = at[at + max(SIZES) <= len(x)]
    byte = x.astype(np.uint32)
    h = byte[at] * np.uint32(0x01000193) + byte[at + 1]
    found, who = [], []
    for n in range(2, max(SIZES) + 1):
        if n > 2:
            h = h * np.uint32(0x01000193) + byte[at + n - 1]
        if n in SIZES:
            found.append(((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
            who.append(owner[at])
    return np.concatenate(found), np.concatenate(who)


@dataclass
class LanguageModel:
    classes: list[str]
    weights: np.ndarray  # subword -> score per class
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        h, who = subwords(texts)
        n = len(texts)
        total = np.bincount(who, minlength=n)
        values = self.weights[h]
        sums = np.stack([np.bincount(who, values[:, c], n) for c in range(len(self.classes))], axis=1)
        return sums / np.maximum(total, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(class index, calibrated probability) per text."""
        p = softmax(self.logits(texts) / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel:
    """features: (distinct subwords, their counts) per text. Every fifth text calibrates."""
    classes = sorted(set(labels))
    y = np.array([classes.index(c) for c in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    calibrate = order[::5] if len(y) >= 50 else order
    fit = np.setdiff1d(order, calibrate) if len(y) >= 50 else order
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(classes)), np.float32)
    table_sq, out_sq = np.full(1 << BITS, 1e-8, np.float32), np.full_like(out, 1e-6)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rows = fit[at : at + BATCH]
            ids = np.concatenate([features[r][0] for r in rows])
            share = np.concatenate([features[r][1] / max(1, features[r][1].sum()) for r in rows]).astype(np.float32)
            who = np.repeat(np.arange(len(rows)), [len(features[r][0]) for r in rows])
            mean = np.zeros((len(rows), DIM), np.float32)
            np.add.at(mean, who, table[ids] * share[:, None])
            g = softmax(mean @ out)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ out.T
            d_out = mean.T @ g
            out_sq += d_out**2
            out -= RATE * d_out / np.sqrt(out_sq)
            if not len(ids):
                continue
            uniq, inverse = np.unique(ids, return_inverse=True)
            d = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(d, inverse, back[who] * share[:, None])
            table_sq[uniq] += (d**2).mean(1)
            table[uniq] -= RATE * d / np.sqrt(table_sq[uniq])[:, None]
    model = LanguageModel(classes, (table @ out).astype(np.float32))
    z = np.zeros((len(calibrate), len(classes)))
    for k, r in enumerate(calibrate):
        ids, count = features[r]
        z[k] = (model.weights[ids] * count[:, None]).sum(0) / max(1, count.sum())
    truth = y[calibrate]

    def loss(t: float) -> float:
        return -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == truth]
    model.reject_below = float(min(REJECT_AT_MOST, np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return model


def fit_language_id(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on about ``sample_rows`` labelled rows, drawn by a hash of their id, or all if there are fewer.

    Rows without id, text or language teach nothing. Without any labelled row the model knows no language, and
    every prediction is ``und``.
    """
    rows = labelled.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    total = rows.count()
    share = min(1.0, sample_rows / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("language id"), F.col(f"`{id_col}`").cast("long")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 1 << 20):
            ids, counts = [], []
            h, who = subwords([t.decode("utf-8", "replace") for t in batch.column(2).to_pylist()])
            order = np.argsort(who, kind="stable")
            cut = np.searchsorted(who[order], np.arange(batch.num_rows + 1))
            for a, b in zip(cut, cut[1:], strict=False):
                found, count = np.unique(h[order[a:b]], return_counts=True)
                ids.append(found.astype(np.uint32).tobytes())
                counts.append(count.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["id", "lang", "ids", "counts"])

    wanted = drawn.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text_bytes(text_col).alias("text"))
    sample = wanted.mapInArrow(run, "id long, lang string, ids binary, counts binary").toPandas().sort_values(["id", "lang"])
    if sample.empty:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    features = [(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32).astype(np.float32)) for a, b in zip(sample.ids, sample.counts, strict=True)]
    return train(features, sample.lang.tolist())


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[Column | str] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score and rejected, for whole texts; each row is judged alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. ``rejected`` is also set where
    the calibrated score is below the model's bound. Repeated rows get equal results.
    """
    kept = docs.select(*keep)
    schema = kept.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.classes, "und"], object)
        for batch in sliced(batches, 0, 1 << 20):
            texts = [t.decode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            has = np.fromiter((LETTER.search(t) is not None for t in texts), bool, len(texts))
            if model.classes:
                best, score = model.predict(texts)
            else:
                best, score, has = np.zeros(len(texts), np.int64), np.zeros(len(texts)), has & False
            score = np.where(has, score, 0.0)
            lang = names[np.where(has, best, len(model.classes))]
            out = [*batch.columns[1:], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(~has | (score < model.reject_below))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    text = text_bytes(text_col)
    return docs.select(text, *keep).mapInArrow(run, schema)
