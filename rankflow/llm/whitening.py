"""Operator 12: embedding whitening by pivoted Cholesky and one-sided Jacobi.

Vectors become integers (floor of 64 c, plus a shift), and the distinct ones are the fit list, stored once. Its
sums are exact integers; the scatter is added up from vectors that are centred before they are multiplied. Tasks
send partial rows of the d x d scatter, which are merged in two keyed steps, so only d rows of d numbers reach the
driver, whatever the table's size.

There the scatter V is factored as P V P' = L L' by Cholesky with diagonal pivoting, up to the numerical rank, and
one-sided Jacobi rotates the columns of P' L directly until they are orthogonal: their squared norms are the
eigenvalues of V, the normalised columns its eigenvectors. V itself is never squared or diagonalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
CLIP = float(1 << 61)  # quantized entries beyond it are set to it, so that they stay longs
MERGE_BUCKETS = 512
TOP_LONG = (1 << 63) - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Fitted on the n distinct vectors: exact sums, components as columns by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of rows whose vector is there and has only finite entries."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    good = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform("vec", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-CLIP)), F.lit(CLIP - SHIFT))).cast("long") + SHIFT)
    return rows.where(F.col("vec").isNotNull() & good).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _list_sums(fit: DataFrame) -> DataFrame:
    """(width, place, n, total): rows and exact entry sums of the fit list, for every length of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            width = np.diff(batch.column(0).offsets.to_numpy())
            for w in np.unique(width).tolist():
                rows = matrix(batch.column(0).filter(pa.array(width == w)), w)
                # Two halves of 32 bits each, so that no sum of a batch leaves a long.
                high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
                sums = [(int(h) << 32) + int(x) for h, x in zip(high, low, strict=True)]
                n, old = held.get(w, (0, [0] * w))
                held[w] = (n + len(rows), [a + b for a, b in zip(old, sums, strict=True)])
        out = [(w, i, n, str(s)) for w, (n, sums) in held.items() for i, s in enumerate(sums)]
        if out:
            names = ["width", "place", "n", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    parts = fit.mapInArrow(run, "width long, place long, n long, total string")
    return parts.groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sums of ``line`` per key. A group holds at most the partial lines of its key."""

    def add(table: pa.Table) -> pa.Table:
        lines = table.column("line").combine_chunks()
        total = lines.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).sum(axis=0)
        kept = [table.column(k).slice(0, 1).combine_chunks() for k in keys]
        return pa.table([*kept, pa.array([total.tolist()], pa.list_(pa.float64()))], names=[*keys, "line"])

    types = ", ".join(f"{k} long" for k in keys)
    return parts.groupBy(*keys).applyInArrow(add, f"{types}, line array<double>")


def scatter(fit: DataFrame, width: int, size: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of r r' over the rows r that ``rows_of`` makes of the fit list's vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                r = rows_of(matrix(batch.column(0).slice(at, 4096), width))
                total += r.T @ r
                seen = True
        if seen:
            bucket = TaskContext.get().partitionId() % MERGE_BUCKETS
            lines = pa.array(total.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, bucket)), lines], names=["i", "bucket", "line"])

    parts = fit.where(F.size("x") == width).mapInArrow(run, "i long, bucket long, line array<double>")
    lines = _merged(_merged(parts, ["i", "bucket"]).drop("bucket"), ["i"]).collect()
    out = np.zeros((size, size))
    for line in lines:
        out[line.i] = line.line
    return (out + out.T) / 2


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """F (d x r) with F F' = V up to rounding: rows in V's order, one column per pivot, the largest left diagonal first."""
    d = len(v)
    left = v.diagonal().copy()
    factor = np.zeros((d, d))
    # Below this, what is left of a diagonal is the rounding of what was taken off.
    least = max(left.max(initial=0.0), 0.0) * d * np.finfo(float).eps
    for step in range(d):
        pivot = int(left.argmax())
        if not left[pivot] > least:
            return factor[:, :step]
        root = np.sqrt(left[pivot])
        column = (v[:, pivot] - factor[:, :step] @ factor[pivot, :step]) / root
        # Pivots taken before have nothing left; the factor stays triangular in pivot order.
        column[left == -np.inf] = 0.0
        column[pivot] = root
        factor[:, step] = column
        left -= column**2
        left[pivot] = -np.inf
    return factor


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal.

    Pairs of columns are taken in rounds of a tournament, so a round's pairs share no column and rotate at once.
    """
    a = factor.copy()
    n = a.shape[1]
    if n < 2:
        return a
    ring = np.arange(n + n % 2)
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            ring = np.r_[ring[0], ring[-1], ring[1:-1]]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2.0 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return a


def principal(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, by falling eigenvalue, at most ``count``, within its rank."""
    turned = jacobi_columns(pivoted_cholesky(v))
    norms = np.sqrt((turned**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:count]
    return norms[order] ** 2, turned[:, order] / norms[order]


def centring(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n in doubles: whole part of the mean off in integers first, so nothing large is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - part


def deviations(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], list[int | None]]:
    """Sum over dimensions of (n x - S)^2, exact; None where it does not fit a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)

    def of(x: np.ndarray) -> list[int | None]:
        gap = x - whole
        most = (float(np.abs(gap).max(initial=0)) + 1.0) * n
        if most * most * max(1, x.shape[1]) < 2.0**62:
            return ((n * gap - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * g - r) ** 2 for g, r in zip(row, rest.tolist(), strict=True)) for row in gap.tolist()]
        return [s if s <= TOP_LONG else None for s in exact]

    return of


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> Whitening | None:
    """Fitted on the distinct quantized vectors; None if no usable vector has an entry.

    Vectors of several lengths: the length most distinct vectors have counts (of equals the larger), others take no
    part. The same in all vectors, a dimension adds nothing; without any variance there is no component.
    """
    fit = materialize(quantized(vectors, id_col, vec_col).where(F.size("x") > 0).select("x").distinct(), "fit-list")
    sums = materialize(_list_sums(fit), "list-sums")
    top = sums.groupBy("width").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not top:
        return None
    width, n = top[0].width, top[0].n
    totals = {r.place: int(r.total) for r in sums.where(F.col("width") == width).collect()}
    total = tuple(totals[i] for i in range(width))
    centred = centring(n, total)
    v = scatter(fit, width, width, centred) / n
    eigenvalues, axes = principal(v, components)
    size, worst = len(eigenvalues), 0.0
    if size:
        to_unit = axes / np.sqrt(eigenvalues)
        unit = scatter(fit, width, size, lambda x: centred(x) @ to_unit) / n
        worst = float(np.abs(unit - np.eye(size)).max())
    return Whitening(n, total, axes, eigenvalues, float(np.trace(v)), worst)


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: SCHEMA. Rows without a usable vector of the fitted length give none.

    A null id stays null, repeated rows stay rows; other columns are not read. Nothing is shuffled.
    """
    rows = quantized(vectors, id_col, vec_col)
    if model is None or not len(model.eigenvalues):
        return rows.where("false").select("vec_id").selectExpr("vec_id", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in SCHEMA.split(", ")[1:]])
    width, size = len(model.sums), len(model.eigenvalues)
    centred, exact = centring(model.n, model.sums), deviations(model.n, model.sums)
    to_unit = model.components / np.sqrt(model.eigenvalues)
    n, worst, explained = model.n, model.identity_error, model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1), width)
                each = pa.array(np.repeat(np.arange(len(x)), size))
                dev = pa.array(exact(x), pa.int64())
                arrays = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * size, n)),
                    dev.take(each), pa.array((centred(x) @ to_unit).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * size, worst)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.where(F.size("x") == width).mapInArrow(run, SCHEMA)
