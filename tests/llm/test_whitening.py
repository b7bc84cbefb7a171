"""Operator 12 against numpy's eigenvectors and plain integers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import CLASHING
from pyspark.sql import functions as F

from rankflow.llm import queries, whitening


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in ("n",)], F.lit(1).alias("x"), F.lit(2).alias("component"))


def usable(rows, width):
    return [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]


def check(rows, got, width, count=16):
    kept = usable(rows, width)
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[f - a / n for f, a in zip(row, s, strict=True)] for row in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rank = int(min(count, (e > e[0] * width * 1e-13).sum()))
    assert len(got) == len(kept) * rank
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for (i, _), row in zip(kept, x, strict=True):
        mine = sorted(by[i], key=lambda r: r.component)
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))}
        for r in mine:
            j = r.component - 1
            assert abs(r.explained - e[j] / np.trace(v)) <= 1e-9 * r.explained and r.identity_error <= 1e-9
            gap = min(abs(e[j] - e[k]) for k in range(len(e)) if k != j) / e[0] if len(e) > 1 else 1
            if gap > 1e-6:
                want = (np.array(row) - np.array(s) / n) @ u[:, j] / np.sqrt(e[j])
                assert abs(abs(r.whitened) - abs(want)) < 1e-6 * max(1, abs(want))


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(24, 24)) * np.linspace(2, 0.05, 24)
    rows = [(i, (rng.normal(size=24) @ mix).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows is one vector
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23), (2003, [float("inf")] + [0.0] * 23), (2004, [1.0, 2.0]), (2005, []), (2006, [0.0] * 24)]
    df = vectors(spark, rows)
    got = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    check(rows, got, 24)


def test_rank_below_dimension_and_ids(spark):
    """Dependent and constant dimensions; null and repeated ids keep their rows."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(80, 3))
    full = np.c_[base, base[:, 0] + 0, np.ones(80), base[:, 1]]
    rows = [(i, v.tolist()) for i, v in enumerate(full)]
    model = whitening.fit_whitening(vectors(spark, rows))
    check(rows, whitening.whiten(vectors(spark, rows), model).collect(), 6)
    odd = [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1])]
    got = whitening.whiten(vectors(spark, odd), model).collect()
    assert len(got) == 3 * len(model.eigenvalues) == 9 and sorted(str(r.vec_id) for r in got).count("None") == 3


def test_tables_without_variance(spark):
    none = whitening.whiten(vectors(spark, []), whitening.fit_whitening(vectors(spark, [])))
    assert none.count() == 0 and none.dtypes[3] == ("deviation", "bigint")
    same = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(same, whitening.fit_whitening(same)).count() == 0
    big = vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    got = whitening.whiten(big, whitening.fit_whitening(big)).collect()
    # The second dimension is below the rounding of the first, so there is one component.
    assert [r.deviation for r in got if r.vec_id in (1, 2)] == [None, None] and len(got) == 3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.integers(0, 2**31), st.booleans())
def test_factor_and_rotation(d, n, seed, coarse):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 10.0 ** rng.uniform(-4, 4, size=d)
    if coarse:
        x = np.round(x / np.abs(x).max() * 2)
    v = x.T @ x / n
    f = whitening.pivoted_cholesky(v)
    assert np.allclose(f @ f.T, v, rtol=0, atol=1e-12 * max(v.diagonal().max(initial=0), 1e-300) * d * d)
    e, u = whitening.principal(v, d)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-10) and (np.diff(e) <= 0).all()
    if len(e):
        want = np.linalg.eigvalsh(v)[::-1][: len(e)]
        assert np.allclose(e, want, rtol=1e-9, atol=1e-12 * want[0] * d)


def test_exact_deviation_in_both_ways():
    small = whitening.deviations(3, (10, -4))
    assert small(np.array([[1, 2], [5, -7]])) == [(3 - 10) ** 2 + (6 + 4) ** 2, 5**2 + 17**2]
    assert whitening.deviations(1 << 31, (0, 0))(np.array([[1, 0], [2, 0], [0, 1 << 40]])) == [1 << 62, None, None]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    got = queries.QUERIES["op12_embedding_whitening"](spark, sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    width = max({len(v) for _, v in rows if v}, key=lambda w: sum(len(v or ()) == w for _, v in rows))
    check(rows, got.collect(), width)
