"""Operator 8: toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the distinct terms of a text: the pair part learns
that two terms together (an insult and the group it is aimed at) say more than their weights add up to.
Trained by stochastic gradient descent with Adagrad steps in numpy, on a bounded sample of labelled rows; a part of
it is kept back to calibrate the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import sliced, text_bytes

BITS = 18
FACTORS = 8
EPOCHS = 8
BATCH = 64
RATE = 0.1
FIRST_SQUARE = 1.0  # of the gradients so far: keeps the first steps small, as a text has hundreds of terms
L1, L2 = 1e-3, 1e-4
MIN_TEXTS = 3
SAMPLE_ROWS = 12_000
#: Signs end a term; letters, digits, apostrophes and all bytes of other scripts belong to it.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))


def term_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed distinct terms of all texts one after another, number per text)."""
    mask, crc = (1 << BITS) - 1, zlib.crc32
    sets = [set(t.lower().encode("utf-8", "replace").translate(TO_SPACE).split()) for t in texts]
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.fromiter((crc(w) & mask for s in sets for w in s), np.int64, int(count.sum())), count


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def score(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Calibrated probability of each text."""
        return sigmoid(self.scale * self.margin(ids, count) + self.shift)

    def margin(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        n = len(count)
        who = np.repeat(np.arange(n), count)
        known = self.weight[ids] != 0
        known |= self.factor[ids, 0] != 0
        ids, who = ids[known], who[known]
        z = self.bias + np.bincount(who, self.weight[ids], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[ids, f]
            z += 0.5 * (np.bincount(who, v, n) ** 2 - np.bincount(who, v**2, n))
        return z

    def calibrate(self, z: np.ndarray, labels: np.ndarray) -> None:
        """Scale and shift of the margins with the largest likelihood, by Newton steps; a slight pull keeps them finite."""
        a = np.array([1.0, 0.0])
        x = np.stack([z, np.ones(len(z))], axis=1)
        for _ in range(50):
            p = sigmoid(x @ a)
            slope = x.T @ (p - labels) + 1e-2 * (a - [1.0, 0.0])
            curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            a -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if a[0] > 0:
            self.scale, self.shift = float(a[0]), float(a[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """texts: distinct term ids of each text. Terms of fewer than MIN_TEXTS texts are not learned.

    Every fifth text of a sample of 50 or more is kept back to calibrate the score.
    """
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(texts))[::5] if len(texts) >= 50 else np.zeros(0, np.int64)
    if len(held):
        rest = np.setdiff1d(np.arange(len(texts)), held)
        model = _fit([texts[i] for i in rest], labels[rest], rng)
        z = model.margin(np.concatenate([texts[i] for i in held]), np.array([len(texts[i]) for i in held]))
        model.calibrate(z, labels[held])
        return model
    return _fit(texts, labels, rng)


def _fit(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> FactorizationMachine:
    size = 1 << BITS
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *texts]), minlength=size)
    texts = [t[seen[t] >= MIN_TEXTS] for t in texts]
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
    b, w = float(np.log(rate / (1 - rate))), np.zeros(size)
    v = np.where((seen >= MIN_TEXTS)[:, None], rng.normal(0, 1e-3, (size, FACTORS)), 0)
    b_sq, w_sq, v_sq = FIRST_SQUARE, np.full(size, FIRST_SQUARE), np.full((size, FACTORS), FIRST_SQUARE)
    order = np.arange(len(texts))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            count = np.array([len(texts[r]) for r in rows])
            ids = np.concatenate([texts[r] for r in rows])
            who = np.repeat(np.arange(len(rows)), count)
            vi = v[ids]
            total = np.zeros((len(rows), FACTORS))
            np.add.at(total, who, vi)
            squares = np.zeros_like(total)
            np.add.at(squares, who, vi**2)
            z = b + np.bincount(who, w[ids], len(rows)) + 0.5 * (total**2 - squares).sum(1)
            g = sigmoid(z) - labels[rows]
            b_sq += g.mean() ** 2
            b -= RATE * g.mean() / np.sqrt(b_sq)
            uniq, inverse = np.unique(ids, return_inverse=True)
            if not len(uniq):
                continue
            dw = np.bincount(inverse, g[who], len(uniq)) / len(rows)
            dv = np.zeros((len(uniq), FACTORS))
            np.add.at(dv, inverse, g[who][:, None] * (total[who] - vi))
            dv = dv / len(rows) + L2 * v[uniq]
            w_sq[uniq] += dw**2
            v_sq[uniq] += dv**2
            step = RATE / np.sqrt(w_sq[uniq])
            new = w[uniq] - step * dw
            w[uniq] = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
            v[uniq] -= RATE * dv / np.sqrt(v_sq[uniq])
    return FactorizationMachine(b, w.astype(np.float32), v.astype(np.float32))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Train on about ``sample_rows`` labelled rows, drawn by a hash of their id, or all if there are fewer.

    Rows without id or label teach nothing; a null text has no term. Without labels every score is near 0.
    """
    key = F.col(f"`{id_col}`").cast("long")
    marks = labels.where(key.isNotNull() & F.col(f"`{label_col}`").isNotNull()).select(key.alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    share = min(1.0, sample_rows / max(1, marks.count()))
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1 << 20)) < int(share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids, count = term_ids([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            parts = np.split(ids.astype(np.int32), np.cumsum(count)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "terms"])

    texts = docs.select(key.alias("id"), text_bytes(text_col).alias("text")).where(drawn).mapInArrow(run, "id long, terms binary")
    sample = texts.join(marks.where(drawn), "id").toPandas().sort_values(["id", "y", "terms"])
    return train([np.frombuffer(t, np.int32).astype(np.int64) for t in sample.terms], sample.y.to_numpy(np.float64))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", keep: list[Column | str] = ("doc_id",)) -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (score >= 0.5), for whole texts.

    A null or empty text has no term and gets the score of the bias. Repeated rows get equal scores.
    """
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            score = model.score(*term_ids([t.decode("utf-8", "replace") for t in batch.column(0).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(text_bytes(text_col), *keep).mapInArrow(run, schema)
