"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Vectors become integers, so the scatter ``n * sum(x x') - S S'`` is an integer matrix and is summed without an
error, in tasks and then by cell.  Its characteristic polynomial is found modulo many primes, by reduction to
Hessenberg form, a task a group of primes, and put together by Chinese remainders.  A symmetric matrix has real
roots only, so sign variations of the shifted polynomial count those above a point exactly: the largest roots
are isolated, told from repeated ones and refined to over a hundred bits.  Each root's null space is found by
inverse iteration in integers of fixed point.  What the driver holds depends on the dimension, not on the rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import materialize

#: Fixed values of the integer form: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries whose integer form would not be a long.
_TOO_LARGE = float(2**62 // SCALE)
#: Bits of a limb of x and rows summed at once: 2 * (bits - 1) + 14 stay below the 53 of a double.
_LIMB, _ROWS = 20, 1 << 14
#: Bits of a limb of a sum.
_PART = 40
#: Relative bits of a root.
ROOT_BITS = 110


# ---------------------------------------------------------------- integers and their sums
def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, not finite or beyond a long."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _TOO_LARGE)
    return vector.isNotNull() & F.forall(vector, entry)


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """Rows of x - SHIFT."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k times 2 ** (_LIMB * k), each a double of at most _LIMB - 1 bits and a sign."""
    out, half = [], 1 << (_LIMB - 1)
    while not out or x.any():
        low = ((x + half) & ((1 << _LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> _LIMB
    return out


def products(x: np.ndarray) -> np.ndarray:
    """sum(x x') as exact Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), _ROWS):
        limbs = _limbs(x[at : at + _ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def sums(vectors: DataFrame, column: str, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the integer scatter n * sum(x x') - S S' of x - SHIFT, which is that of x, over all rows."""
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(batch.column(0), d)
            n += len(x)
            total += x.astype(object).sum(axis=0) if len(x) else 0
            square += products(x)
        if n:
            values = [n, *total, *square[upper]]
            parts = [pa.array([(v >> (_PART * k)) & ((1 << _PART) - 1) if k < 3 else v >> (_PART * 3) for v in values], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), *parts], names=["cell", "p0", "p1", "p2", "p3"])

    cells = vectors.select(column).mapInArrow(partial, "cell long, p0 long, p1 long, p2 long, p3 long")
    found = cells.groupBy("cell").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)]).collect()
    values = {r.cell: r.p0 + (r.p1 << _PART) + (r.p2 << 2 * _PART) + (r.p3 << 3 * _PART) for r in found}
    if not values:
        return 0, [0] * d, [[0] * d for _ in range(d)]
    n, total = values[0], [values[1 + i] for i in range(d)]
    scatter = [[0] * d for _ in range(d)]
    for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper)), 1 + d):
        scatter[i][j] = scatter[j][i] = n * values[k] - total[i] * total[j]
    return n, total, scatter


# ---------------------------------------------------------------- characteristic polynomial
def _is_prime(p: int) -> bool:
    """Miller and Rabin's test with bases that are enough below 2 ** 32."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        y = pow(base, odd, p)
        if y not in (1, p - 1) and all((y := y * y % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product exceeds ``bound``."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo p < 2 ** 31, lowest first; ``matrix`` has residues."""
    h, d = matrix.astype(np.int64) % p, len(matrix)
    for m in range(d - 2):
        below = np.flatnonzero(h[m + 1 :, m])
        if not below.size:
            continue
        if (i := m + 1 + int(below[0])) != m + 1:
            h[[m + 1, i]] = h[[i, m + 1]]
            h[:, [m + 1, i]] = h[:, [i, m + 1]]
        factor = h[m + 2 :, m] * pow(int(h[m + 1, m]), -1, p) % p
        h[m + 2 :] = (h[m + 2 :] - factor[:, None] * h[m + 1] % p) % p
        h[:, m + 1] = (h[:, m + 1] + (h[:, m + 2 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for k in range(d):
        row = np.roll(polys[k], 1)
        factors, product = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            factors[i] = int(h[i, k]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        polys[k + 1] = (row - (factors[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix), lowest first, of a positive semidefinite integer matrix."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # elementary symmetric functions of roots that are not negative, by Maclaurin's inequality
    largest = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * largest)
    shared = spark.sparkContext.broadcast(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, object)
        for batch in batches:
            found = batch.column("p").to_pylist()
            coefficients = [polynomial_modulo((whole % p).astype(np.int64), p).tolist() for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(coefficients, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    jobs = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    residues = {r.p: r.c for r in jobs.mapInArrow(reduce, "p long, c array<long>").collect()}
    product = 1
    for p in primes:
        product *= p
    weights = [(q := product // p) * pow(q % p, -1, p) for p in primes]
    out = []
    for k in range(d + 1):
        c = sum(w * residues[p][k] for w, p in zip(weights, primes)) % product
        out.append(c - product if 2 * c > product else c)
    return out


# ---------------------------------------------------------------- real roots
@dataclass
class Root:
    """``times`` roots between low and high, over 2 ** bits."""

    low: int
    high: int
    bits: int
    times: int


def _scaled(coefficients: list[int], bits: int) -> list[int]:
    d = len(coefficients) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(coefficients)]


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """How many roots lie above at / 2 ** bits, for a polynomial of real roots only: variations of sign."""
    c = _scaled(coefficients, bits)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign_at(coefficients: list[int], at: int, bits: int) -> int:
    value = 0
    for c in reversed(_scaled(coefficients, bits)):
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], wanted: int) -> list[Root]:
    """The ``wanted`` largest positive roots, falling, all of them where there are fewer.

    All roots are real and none is negative.  A root counts as repeated if no other is told from it at ROOT_BITS.
    """
    while len(coefficients) > 1 and not coefficients[0]:
        coefficients = coefficients[1:]  # roots of zero
    d = len(coefficients) - 1
    if not d or not wanted:
        return []
    high = -coefficients[d - 1] + 1  # more than the sum of all
    out, open_ = [], [(0, high, 0, d, 0)]  # low, high, bits, roots above low, above high
    while open_:
        low, high, bits, above_low, above = open_.pop()
        if above >= wanted or above_low == above:
            continue
        if above_low - above == 1:
            out.append(_refined(coefficients, low, high, bits, above))
            continue
        if low >= (high - low) << ROOT_BITS:
            out.append(Root(low, high, bits, above_low - above))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        between = roots_above(coefficients, middle, bits)
        open_ += [(low, middle, bits, above_low, between), (middle, high, bits, between, above)]
    return out


def _refined(coefficients: list[int], low: int, high: int, bits: int, above: int) -> Root:
    """The one root in (low, high], by halving; ``above`` lie beyond."""
    beyond = -1 if above % 2 else 1
    while low < (high - low) << ROOT_BITS:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = _sign_at(coefficients, middle, bits)
        if not sign:
            return Root(middle, middle, bits, 1)
        low, high = (low, middle) if sign == beyond else (middle, high)
    return Root(low, high, bits, 1)


# ---------------------------------------------------------------- null spaces
def null_space(matrix: list[list[int]], root: Root) -> list[list[int]]:
    """``root.times`` orthogonal vectors, in integers of any scale, by inverse iteration on matrix - root.

    The shifted matrix is factored with row exchanges in fixed point, so fine that a root's error of ROOT_BITS
    is far above that of the arithmetic; two solutions lift the null space by twice those bits.
    """
    d = len(matrix)
    fine = 3 * ROOT_BITS + max(0, root.bits - root.high.bit_length())
    a = np.array(matrix, object) << fine
    a[np.diag_indices(d)] -= ((root.low + root.high) << fine) >> (root.bits + 1)
    order = list(range(d))
    for m in range(d):
        k = m + max(range(d - m), key=lambda i: abs(a[m + i, m]))
        if k != m:
            a[[m, k]] = a[[k, m]]
            order[m], order[k] = order[k], order[m]
        if not a[m, m]:
            a[m, m] = 1
        if m + 1 < d:
            a[m + 1 :, m] = (a[m + 1 :, m] << fine) // a[m, m]
            a[m + 1 :, m + 1 :] -= (a[m + 1 :, m : m + 1] * a[m, m + 1 :]) >> fine

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for m in range(d):
            x[m + 1 :] -= (a[m + 1 :, m] * x[m]) >> fine
        for m in range(d - 1, -1, -1):
            x[m] = (x[m] << fine) // a[m, m]
            x[:m] -= (a[:m, m] * x[m]) >> fine
        return _leveled(x, fine)

    start, out = random.Random(d), []
    for _ in range(root.times):
        v = np.array([start.randrange(-1 << 30, 1 << 30) << (fine - 30) for _ in range(d)], object)
        for _ in range(2):
            v = solved(v)
            for _ in range(2):
                for u in out:
                    v = v - u * int(v @ u) // int(u @ u)
        out.append(_leveled(v, fine))
    return [v.tolist() for v in out]


def _leveled(x: np.ndarray, bits: int) -> np.ndarray:
    """x times a power of two, its largest entry of ``bits`` bits."""
    surplus = max((int(abs(v)).bit_length() for v in x), default=0) - bits
    return x >> surplus if surplus > 0 else x << -surplus


def unit(v: list[int]) -> list[float]:
    """The vector over its length, each entry rounded once; its largest entry is positive."""
    length = isqrt(sum(x * x for x in v))
    first = max(range(len(v)), key=lambda i: abs(v[i]))
    return [(x if v[first] > 0 else -x) / length for x in v]


# ---------------------------------------------------------------- Spark
@dataclass
class Whitening:
    """n rows, S of x - SHIFT, unit components, their eigenvalues e of x's covariance, and e over its trace."""

    n: int
    total: list[int]
    components: list[list[float]]
    variance: list[float]
    explained: list[float]


def common_length(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have, the larger of those as frequent."""
    found = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def fit(vectors: DataFrame, column: str, d: int, components: int = COMPONENTS) -> Whitening:
    """``vectors`` are usable and of d entries; components without variance are left out."""
    spark = vectors.sparkSession
    n, total, scatter = sums(vectors, column, d)
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return Whitening(n, total, [], [], [])
    roots = largest_roots(characteristic(spark, scatter), components)
    shared = spark.sparkContext.broadcast((scatter, roots))

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, found = shared.value
        for batch in batches:
            at = batch.column("k").to_pylist()
            vectors = [[unit(v) for v in null_space(matrix, found[k])] for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(vectors, pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    jobs = spark.createDataFrame([(k,) for k in range(len(roots))], "k long").repartition(len(roots), "k")
    found = {r.k: r.v for r in jobs.mapInArrow(spaces, "k long, v array<array<double>>").collect()}
    out = Whitening(n, total, [], [], [])
    for k, root in enumerate(roots):
        for v in found[k]:
            out.components.append(list(v))
            out.variance.append((root.low + root.high) / (n * n << (root.bits + 1)))
            out.explained.append((root.low + root.high) / (trace << (root.bits + 1)))
    return Whitening(n, total, *(x[:components] for x in (out.components, out.variance, out.explained)))


def centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """n * x - S as doubles, and each row's sum of squares, exact."""
    size = max(map(abs, total), default=0) + n * max(int(np.abs(x).max(initial=0)), 1)
    small = size < 1 << 62
    diff = n * x - np.array(total, np.int64) if small else n * x.astype(object) - np.array(total, object)
    if size * size * max(1, x.shape[1]) < 1 << 63:
        return diff.astype(np.float64), (diff * diff).sum(axis=1).tolist()
    squares = diff.astype(object)
    return diff.astype(np.float64), [int(r @ r) for r in squares]


def project(vectors: DataFrame, column: str, d: int, model: Whitening) -> DataFrame:
    """The other columns of ``vectors`` with deviation (sum of (n x - S) ** 2) and whitened, one entry a component."""
    others = [c for c in vectors.columns if c != column]
    weights = np.array(model.components).reshape(-1, d).T / (model.n * np.sqrt(np.array(model.variance)))

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diff, squares = centred(integers(batch.column(column), d), model.n, model.total)
            values = pa.FixedSizeListArray.from_arrays(pa.array((diff @ weights).ravel()), weights.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(squares, pa.decimal128(38, 0)), values], names=[*others, "deviation", "whitened"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != column]
    return vectors.mapInArrow(map_, ", ".join([*fields, "deviation decimal(38,0)", "whitened array<double>"]))


def whiten(vectors: DataFrame, *, id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """(rows of id, deviation, whitened), the model, and the largest error of the whitened covariance.

    Rows are left out whose vector is null, has an entry that is null, not finite or beyond a long, or another
    length than most vectors.  Rows may repeat and ids may be null: each row counts.  Components without variance
    are left out: without rows, with one row or with equal ones there are none, and ``whitened`` is empty.  Ties
    of eigenvalues are any orthonormal basis of their space, the same for all rows.  Other columns are not read.
    """
    kept = vectors.select(F.col(id).alias("id"), F.col(column).alias("vector")).where(usable(F.col("vector")))
    d = common_length(kept, "vector")
    kept = kept.where(F.size("vector") == d)
    model = fit(kept, "vector", d, components) if d else Whitening(kept.count(), [], [], [], [])
    if not model.components:
        none = kept.select(F.col("id").alias(id), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return none, model, 0.0
    out = materialize(project(kept, "vector", d, model).withColumnRenamed("id", id), "whitened")
    each = [F.col("whitened")[k] for k in range(len(model.components))]
    pairs = [(i, j) for i in range(len(each)) for j in range(i, len(each))]
    found = out.agg(*[F.covar_pop(each[i], each[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return out, model, max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    rows, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shares = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return rows.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
