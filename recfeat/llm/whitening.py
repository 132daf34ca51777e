"""Whitening of embeddings along the principal components of their integer-scaled values.

An entry c counts as the whole number x = floor(64 c) + 1000000.  Spark sums the products of the entries, exactly, by
task; the scatter n * sum(x x') - S S' is n^2 times the covariance and holds whole numbers.  Its characteristic
polynomial is found modulo one prime a task (Hessenberg form and its recurrence) and put together by Chinese
remaindering; the largest roots are isolated with exact sign counts and refined, one component a task, and each root's
null space is found by inverse iteration with exact residuals.  What reaches the driver is of the size of the scatter.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

SCALE, OFFSET = 64, 1_000_000
#: Scaled entries beyond this count as this much: x stays within a long.
LARGEST = float(1 << 62)
#: Whole sums travel as so many parts of 32 bits.
LIMBS = 8
#: Roots are told apart down to 2**-GRID of the scatter's unit, and refined by REFINE bits of the trace more.
GRID, REFINE = 32, 90


@dataclass
class Model:
    """Rows and sums of the fit list (the sums without OFFSET), and what its covariance gives for each component."""

    dim: int
    n: int
    sums: list[int]
    vectors: np.ndarray  # dim x components
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) of each entry, as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as exact whole numbers: matrix products of doubles, none of whose sums passes 2**53."""
    if not len(y):
        return np.zeros((y.shape[1],) * 2, object)
    if float(np.abs(y.astype(np.float64)).max()) ** 2 * len(y) < 2.0**52:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), 512):
        part = y[at : at + 512]
        limbs = [((part >> (21 * k)) & ((1 << 21) - 1)).astype(np.float64) for k in range(2)] + [(part >> 42).astype(np.float64)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (21 * (i + j))
    return total


def _limbs(value: int) -> list[int]:
    return [(value >> (32 * k)) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> (32 * (LIMBS - 1))]


def scatter(vectors: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, scatter matrix) of the one-column ``vectors``, exactly."""

    def work(batches):
        n, s, g = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            y = _matrix(batch.column(0), dim)
            n, s, g = n + len(y), s + y.astype(object).sum(0), g + gram(y)
        if n:
            cells = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(s)), *((i, j, g[i, j]) for i in range(dim) for j in range(i, dim))]
            i, j, value = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([_limbs(int(v)) for v in value], pa.list_(pa.int64()))], names=["i", "j", "limbs"])

    parts = vectors.mapInArrow(work, "i int, j int, limbs array<long>")
    summed = parts.groupBy("i", "j").agg(*[F.sum(F.col("limbs")[k]).alias(f"l{k}") for k in range(LIMBS)])
    n, s, g = 0, [0] * dim, np.zeros((dim, dim), object)
    for i, j, *limbs in summed.collect():
        value = sum(v << (32 * k) for k, v in enumerate(limbs))
        if i < 0:
            n = value
        elif j < 0:
            s[i] = value
        else:
            g[i, j] = g[j, i] = value
    return n, s, n * g - np.outer(np.array(s, object), np.array(s, object))


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31, so many that their product passes 2**bits."""
    small = [p for p in range(2, 1 << 16) if all(p % q for q in range(2, int(p**0.5) + 1))]
    table = np.array(small, np.int64)
    out, p = [], (1 << 31) + 1
    while bits >= 0:
        p -= 2
        if (p % table != 0).all():
            out.append(p)
            bits -= 30
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(x I - m) modulo the prime ``p``."""
    h = (m % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the leading k x k block
    polys[0, 0] = 1
    for k in range(d):
        row = np.zeros(d + 1, np.int64)
        row[1:] = polys[k, :-1]
        chain, factor = 1, np.zeros(k + 1, np.int64)
        for i in range(k, -1, -1):
            factor[i] = int(h[i, k]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else chain
        polys[k + 1] = (row - (polys[: k + 1] * factor[:, None] % p).sum(0)) % p
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of det(x I - m) of a whole, symmetric matrix without negative eigenvalues."""
    d = len(m)
    # The coefficients' sizes are the elementary symmetric functions of the eigenvalues, all below (1 + trace / d)^d.
    chosen = primes(d * ((int(np.trace(m)) // d + 2).bit_length()) + 1)
    shared = spark.sparkContext.broadcast(m)

    def work(batches):
        for batch in batches:
            found = [polynomial_modulo(shared.value, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(min(len(chosen), 4 * spark.sparkContext.defaultParallelism))
    rows = tasks.mapInArrow(work, "p long, residues array<long>").collect()
    product = 1
    for p in chosen:
        product *= p
    sizes = [0] * (d + 1)
    for p, residues in rows:
        rest = product // p
        unit = rest * pow(rest, -1, p)
        for k, r in enumerate(residues):
            sizes[k] += unit * (r if (d - k) % 2 == 0 else -r)
    return [v % product * (1 if (d - k) % 2 == 0 else -1) for k, v in enumerate(sizes)]


def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times as large."""
    d = len(poly) - 1
    return [c << (bits * (d - k)) for k, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots alone are larger than ``a``: the sign changes of p(x + a)."""
    c = list(poly)
    d = len(c) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * a + c
    return (v > 0) - (v < 0)


def isolate(poly: list[int], k: int, most: int) -> tuple[int, int, int, int]:
    """The ``k``-th largest root (from 1) of a polynomial with real roots in [0, most].

    Gives the root in parts of 2**-bits, bits, how many roots are larger, and how many can't be told apart from it.
    """
    grid = _scaled(poly, GRID)
    lo, hi = -1, (most + 1) << GRID
    above_lo, above_hi = len(poly) - 1, 0
    while above_lo - above_hi > 1 and hi - lo > 1:
        mid = (lo + hi) // 2
        above = roots_above(grid, mid)
        if above >= k:
            lo, above_lo = mid, above
        else:
            hi, above_hi = mid, above
    bits = GRID + REFINE
    if above_lo - above_hi > 1:
        return hi << REFINE, bits, above_hi, above_lo - above_hi
    fine = _scaled(poly, bits)
    lo, hi = lo << REFINE, hi << REFINE
    end = _sign(fine, hi)
    while end and hi - lo > 1:
        mid = (lo + hi) // 2
        sign = _sign(fine, mid)
        if sign == 0:
            hi = mid
            break
        lo, hi = (lo, mid) if sign == end else (mid, hi)
    return hi, bits, above_hi, 1


def null_space(m: np.ndarray, root: int, bits: int, size: int) -> np.ndarray:
    """``size`` unit eigenvectors (columns, by falling eigenvalue) of the whole symmetric matrix ``m`` next to ``root`` / 2**bits.

    Inverse iteration from a fixed start; then corrections from residuals that are worked out exactly.
    """
    d = len(m)
    a = m * (1 << bits) - np.diag(np.array([root] * d, object))
    unit = 1 << max(0, max(int(abs(v)).bit_length() for v in a.ravel()))
    near = np.array([[int(v) / unit for v in row] for row in a])
    x = np.random.default_rng(d).standard_normal((d, size))
    for _ in range(4):
        x = np.linalg.qr(np.linalg.solve(near + 1e-14 * np.eye(d), x))[0]
    fixed = 1 << 90
    whole = np.array([[int(v * fixed) for v in row] for row in x], object)
    border = np.zeros((size, size))
    for _ in range(6):
        residual = np.array([[int(v) / (fixed * unit) for v in row] for row in a.dot(whole)])
        residual -= x @ (x.T @ residual)
        step = np.linalg.lstsq(np.block([[near, x], [x.T, border]]), np.concatenate([-residual, np.zeros((size, size))]), rcond=None)[0][:d]
        whole = whole + np.array([[int(v * fixed) for v in row] for row in step], object)
        x = np.linalg.qr(np.array([[int(v) / fixed for v in row] for row in whole]))[0] if size > 1 else np.array([[int(v) / fixed for v in row] for row in whole])
        if size > 1:
            whole = np.array([[int(v * fixed) for v in row] for row in x], object)
        if np.abs(step).max() < 1e-18:
            break
    if size > 1:
        inside = x.T @ np.array([[int(v) / (fixed * unit) for v in row] for row in a.dot(whole)])
        x = x @ np.linalg.eigh((inside + inside.T) / 2)[1][:, ::-1]
    x = x / np.sqrt((x * x).sum(0))
    return x * np.where(x[np.abs(x).argmax(0), np.arange(size)] < 0, -1.0, 1.0)


def components(spark: SparkSession, m: np.ndarray, most: int) -> tuple[np.ndarray, list[Fraction]]:
    """Unit eigenvectors (columns) and eigenvalues of the scatter, the ``most`` largest that aren't 0."""
    poly = characteristic_polynomial(spark, m)
    rank = len(poly) - 1 - next(k for k, c in enumerate(poly) if c)
    shared = spark.sparkContext.broadcast((m, poly, int(np.trace(m))))

    def work(batches):
        scattered, p, trace = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root, bits, above, size = isolate(p, k, trace)
                vector = null_space(scattered, root, bits, size)[:, k - 1 - above]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([str(root)]), pa.array([bits], pa.int64()), pa.array([vector.tolist()], pa.list_(pa.float64()))], names=["k", "root", "bits", "vector"])

    count = min(most, rank)
    if not count:
        return np.zeros((len(m), 0)), []
    tasks = spark.createDataFrame([(k,) for k in range(1, count + 1)], "k long").repartition(count)
    rows = sorted(tasks.mapInArrow(work, "k long, root string, bits long, vector array<double>").collect())
    return np.array([r.vector for r in rows]).T, [Fraction(int(r.root), 1 << r.bits) for r in rows]


def _centred(y: np.ndarray, model: Model) -> np.ndarray:
    """n x - S of each entry: whole numbers, of the kind that holds them."""
    if float(model.n) * float(np.abs(y.astype(np.float64)).max(initial=0)) + max(map(abs, map(float, model.sums)), default=0) < 2.0**62:
        return model.n * y - np.array(model.sums, np.int64)
    return model.n * y.astype(object) - np.array(model.sums, object)


def _whitened(d: np.ndarray, model: Model) -> np.ndarray:
    return d.astype(np.float64) @ model.vectors / model.n / np.sqrt(model.values)


def _deviations(d: np.ndarray) -> list[int | None]:
    if (np.square(d.astype(np.float64)).sum(1) < 2.0**62).all():
        return np.square(d.astype(np.int64)).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def _clean(vectors: DataFrame, dim: int, vec_col: str) -> DataFrame:
    return vectors.filter(usable(F.col(vec_col)) & (F.size(vec_col) == dim))


def fit(vectors: DataFrame, most: int = 32, vec_col: str = "embedding") -> Model:
    """The model of all usable vectors: those that are neither null nor hold null or non-finite entries.

    If lengths differ, the commonest counts (the longer of a tie), and vectors of another length are left out like
    those that hold nulls.  Components of eigenvalue 0 don't exist; without rows, or with one, there are none.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    sizes = vectors.filter(usable(F.col(vec_col))).groupBy(F.size(vec_col).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim = first[0].dim if first else 0
    none = Model(dim, first[0].n if first else 0, [0] * dim, np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    if not dim:
        return none
    n, sums, m = scatter(_clean(vectors, dim, vec_col).select(vec_col), dim)
    found, values = components(spark, m, most)
    trace = int(np.trace(m))
    model = Model(dim, n, sums, found, np.array([float(v / (n * n)) for v in values]), np.array([float(v / trace) for v in values]))
    model.identity_error = _identity_error(vectors, model, vec_col)
    return model


def _identity_error(vectors: DataFrame, model: Model, vec_col: str) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            if len(batch):
                w = _whitened(_centred(_matrix(batch.column(0), shared.value.dim), shared.value), shared.value)
                mean = w.mean(0)
                cross = (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
                i, j = np.indices((k, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(i.ravel(), np.arange(k)), pa.int64()), pa.array(np.append(j.ravel(), np.full(k, -1)), pa.int64()), pa.array(np.append(cross.ravel(), len(w) * mean))],
                    names=["i", "j", "v"],
                )

    parts = _clean(vectors, model.dim, vec_col).select(vec_col).mapInArrow(work, "i long, j long, v double")
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        if j < 0:
            mean[i] = v / model.n
        else:
            cov[i, j] = v / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, deviation and whitened (an array, one entry a component) of each usable vector.

    Every usable row of the model's length gives one, repeated rows and null ids included; other columns are not
    read.  A deviation that a long can't hold is null.  An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            d = _centred(_matrix(batch.column(1), shared.value.dim), shared.value)
            w = _whitened(d, shared.value)
            k = w.shape[1]
            offsets = pa.array(np.arange(len(w) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(d), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    rows = _clean(vectors, model.dim, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col))
    return rows.mapInArrow(work, "vec_id long, deviation long, whitened array<double>")


def whitened_rows(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component, with the model's figures beside it."""
    model = fit(vectors, most, vec_col)
    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    each = whiten(vectors, model, id_col, vec_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
