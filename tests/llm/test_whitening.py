"""Whitening against fractions, other routines and plain integers."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import whitening
from tracelake.llm.whitening import Root

SCHEMA = "vec_id long, embedding array<float>, label int"


def _polynomial(m: list[list[int]]) -> list[int]:
    """Faddeev and LeVerrier's method in fractions, lowest coefficient first."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(x) for x in reversed(c)]


def _scatter(rows: list[list[int]]) -> list[list[int]]:
    d = len(rows[0])
    return [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d, n, size", [(1, 3, 10), (2, 2, 4), (5, 3, 1000), (6, 9, 10**9), (7, 7, 1)])
def test_characteristic_polynomial(spark, d, n, size):
    r = random.Random(d)
    m = _scatter([[r.randint(-size, size) for _ in range(d)] for _ in range(n)])
    assert whitening.characteristic(spark, m) == _polynomial(m)


def test_roots_isolated_repeated_and_zero():
    def product(roots):
        c = [1]
        for r in roots:
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        return c

    roots = [10**12 + 1, 10**12, 10**12, 77, 77, 77, 5, 3, 0, 0]
    found = whitening.largest_roots(product(roots), 8)
    assert [x.times for x in found] == [1, 2, 3, 1, 1]
    for x, value in zip(found, (10**12 + 1, 10**12, 77, 5, 3)):
        assert abs(Fraction(x.low + x.high, 2 << x.bits) - value) * 2**100 < value
    assert [x.times for x in whitening.largest_roots(product(roots), 1)] == [1]
    assert sum(x.times for x in whitening.largest_roots(product([2]), 4)) == 1
    assert whitening.largest_roots([0, 0, 1], 3) == []
    irrational = whitening.largest_roots([1, -4, 1], 2)  # 2 +- sqrt(3)
    assert [float(Fraction(x.low, 1 << x.bits)) for x in irrational] == pytest.approx([2 + 3**0.5, 2 - 3**0.5], rel=1e-15)


def test_null_space_of_a_repeated_root():
    m = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]]
    u, v = (whitening.unit(x) for x in whitening.null_space(m, Root(5, 5, 0, 2)))
    assert abs(np.dot(u, v)) < 1e-15 and np.allclose(np.array(m) @ np.array([u, v]).T, 5 * np.array([u, v]).T, atol=1e-14)
    assert np.allclose(whitening.unit(whitening.null_space(m, Root(3, 3, 0, 1))[0]), [0, 0, 2**-0.5, 2**-0.5], atol=1e-16)


def test_limbs_are_exact():
    r = np.random.default_rng(1)
    for size in (3, 2**19, 2**40, 2**60):
        x = r.integers(-size, size, (300, 3))
        whole = x.astype(object)
        assert (whitening.products(x) == whole.T @ whole).all()


def _check(rows, got):
    """``got`` of op12 against numpy's eigenvectors and exact integers."""
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    diff = (x - s / n).astype(np.longdouble)
    v = (diff.T @ diff / n).astype(float)
    e, q = np.linalg.eigh(v)
    rank = min(8, int((e > e.max() * 1e-9).sum()))
    order = np.argsort(-e)[:rank]
    assert len(got) == n * rank and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, rank + 1))
    exact = sorted((i, int(sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, s)))) for (i, _), row in zip(kept, x))
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == exact
    whitened = diff.astype(float) @ q[:, order] / np.sqrt(e[order])
    for k in range(rank):
        assert {round(r.explained, 12) for r in got if r.component == k + 1} == {round(e[order[k]] / e.sum(), 12)}
        mine = np.array([w for _, w in sorted((r.vec_id, r.whitened) for r in got if r.component == k + 1)])
        theirs = np.array([w for _, w in sorted(zip((i for i, _ in kept), whitened[:, k]))])
        assert np.allclose(mine, theirs, atol=1e-7) or np.allclose(mine, -theirs, atol=1e-7)
    assert all(r.identity_error < 1e-10 for r in got)


def _op(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return whitening.op12_whitening(spark, str(folder)).collect()


def test_query_against_eigenvectors(spark, sf, tmp_path):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _check(rows, whitening.op12_whitening(spark, sf).collect())
    r = random.Random(3)
    few = [(i, [r.gauss(0, 3**k) for k in range(4)], None) for i in range(40)]
    few += [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [float("nan"), 0.0, 0.0, 0.0], 1), (103, [0.0, float("-inf"), 0.0, 0.0], 1)]
    _check(few, _op(spark, few, tmp_path))
    low_rank = [(i, [float(i % 7), float(2 * (i % 7)), float(i % 3), 1.0], 0) for i in range(30)]
    _check(low_rank, _op(spark, low_rank, tmp_path))


def test_rows_without_an_answer(spark, tmp_path):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)], [(1, [], 0)]):
        assert _op(spark, rows, tmp_path) == []
    rows = [(None, [1.0, 2.0], 0), (None, [3.0, 1.0], 0), (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (4, [1.0], 0), (5, [1.0, 2.0, 3.0], 0), (6, [], 0), (7, [1e30, 0.0], 0)]
    got = _op(spark, rows, tmp_path)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 3)] * 2 + [(True, 0)] * 2  # one line, so one component
    assert {r.n for r in got} == {4}


def test_equal_eigenvalues_large_values_and_further_columns(spark):
    square = [(i, [a, b, 0.0]) for i, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)] * 5)]
    vectors = spark.createDataFrame(square, "vec_id long, embedding array<double>")
    rows, model, error = whitening.whiten(vectors.withColumns({c: F.lit(1) for c in ("id", "vector", "n", "deviation", "whitened")}))
    assert rows.columns == ["vec_id", "deviation", "whitened"] and rows.count() == 20
    assert len(model.components) == 2 and model.variance[0] == model.variance[1] and error < 1e-12
    large = spark.createDataFrame([(i, [2.0**40 * i, -(2.0**30) * i * i]) for i in range(9)], "vec_id long, embedding array<double>")
    rows, model, error = whitening.whiten(large)
    x = [[2**50 * i, -(2**40) * i * i] for i in range(9)]
    s = [sum(r[k] for r in x) for k in range(2)]
    assert {r.vec_id: int(r.deviation) for r in rows.collect()} == {i: sum((9 * r[k] - s[k]) ** 2 for k in range(2)) for i, r in enumerate(x)}
    assert error < 1e-9
