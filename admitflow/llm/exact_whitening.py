"""Operator 13, embedding whitening: residue-number scatter.

Vectors become integers, x = floor(64 c) + 1000000. With n vectors and their sums S, the centred
entries n x - S are integers too, and their scatter is found exactly: each task reduces blocks of
centred entries modulo several primes below 2^21 and multiplies them as float64 matrices
(``BLOCK`` products of two residues stay below 2^53, so nothing is rounded); residues of the
sums are added per (prime, cell), and the Chinese remainder theorem gives the scatter as whole
numbers. The number of primes follows from the largest centred entry and n, so the result is exact
for any input. Divided by n^3 it is the covariance, correctly rounded to double, whose
eigenvectors (double eigh) whiten the rows.

Only sums go to the driver: one per dimension, then one per prime and pair of dimensions, whatever
the number of rows. ``identity_error`` is measured on the whitened rows themselves, by centred
partial covariances (count, mean, scatter) that merge pairwise.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are dropped.
If vectors differ in length, those of the most frequent length (the longer, if equally frequent)
are kept. A null vec_id is kept as such; rows that repeat are rows of their own, and so
are equal vectors. 64 c is held within +-2^61. Components whose eigenvalue is nothing beside the
largest (fewer distinct vectors than dimensions, a constant dimension) have a null ``whitened``,
and ``identity_error`` leaves them out. ``deviation`` is null where a long can't hold it;
``deviation_exact``, a decimal, still does up to 38 digits. Other columns are passed over, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import prepare, take

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
PRIME_BELOW = 1 << 21
#: Rows of one modular product: BLOCK * PRIME_BELOW ** 2 <= 2 ** 53.
BLOCK = 1 << 11
_FAR = 1 << 61


def primes(product_over: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds the bound."""
    sieve = np.ones(PRIME_BELOW, bool)
    sieve[:2] = False
    for k in range(2, int(PRIME_BELOW**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > product_over:
            break
        out.append(p)
        product *= p
    return out


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """prime -> array of residues; the signed integers of least magnitude with those residues (an object array)."""
    value, product = None, 1
    for p, r in residues.items():
        r = r.astype(object)
        if value is None:
            value, product = r % p, p
            continue
        step = (r - value) * pow(product, -1, p) % p
        value, product = value + product * step, product * p
    return np.where(value * 2 > product, value - product, value)


@dataclass(frozen=True)
class Moments:
    """What centring needs: the number of rows, the sum of every dimension, the largest |n x - S|."""

    n: int
    sums: tuple[int, ...]
    reach: int


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (longs): the usable rows."""
    rows = take(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    fine = F.forall("c", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = rows.where((F.size("c") > 0) & fine)
    top = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("c") == (top.d if top else 0))
    held = lambda v: F.greatest(F.least(v * SCALE, F.lit(float(_FAR))), F.lit(-float(_FAR)))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(held(v)).cast("long") + SHIFT).alias("x"))


def moments(rows: DataFrame) -> Moments | None:
    """Exact sums by dimension; None for an empty table."""
    cells = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    found = sorted(cells.collect())
    if not found:
        return None
    n = found[0].n
    reach = max(max(abs(n * c.lo - int(c.s)), abs(n * c.hi - int(c.s))) for c in found)
    return Moments(n, tuple(int(c.s) for c in found), reach)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _scattered(m: Moments, moduli: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(m.sums)
        totals = {p: np.zeros((d, d), np.int64) for p in moduli}
        shifts = {p: np.array([s % p for s in m.sums], np.int64) for p in moduli}
        seen = False
        for batch in batches:
            whole = _matrix(batch.column(0), d)
            for a in range(0, len(whole), BLOCK):
                x, seen = whole[a : a + BLOCK], True
                for p in moduli:
                    r = ((x % p) * (m.n % p) - shifts[p]) % p
                    r = r.astype(np.float64)
                    totals[p] = (totals[p] + (r.T @ r).astype(np.int64)) % p
        if seen:
            i, j = np.triu_indices(d)
            for p in moduli:
                yield pa.RecordBatch.from_pydict({"prime": pa.array(np.full(len(i), p)), "cell": pa.array(i * d + j), "v": pa.array(totals[p][i, j])})

    return run


def exact_scatter(rows: DataFrame, m: Moments) -> np.ndarray:
    """The sum of (n x - S)(n x - S)' over all rows, as Python integers."""
    d = len(m.sums)
    moduli = primes(2 * m.n * m.reach**2 + 1)
    sums = rows.select("x").mapInArrow(_scattered(m, moduli), "prime long, cell long, v long").groupBy("prime", "cell").agg(F.sum("v").alias("v"))
    residues = {p: np.zeros(d * d, np.int64) for p in moduli}
    for batch in sums.toArrow().to_batches():
        prime, cell, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for p in moduli:
            at = prime == p
            residues[p][cell[at]] = v[at] % p
    upper = np.triu(remaindered(residues).reshape(d, d))
    return upper + np.triu(upper, 1).T


@dataclass(frozen=True)
class Whitener:
    """x -> (x - S/n) projected on the columns of ``basis``; basis is scaled by 1/sqrt(eigenvalue), NaN for null components."""

    m: Moments
    basis: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double: whole parts first, so that large means cost no digits."""
        whole = np.array([s // self.m.n for s in self.m.sums], np.int64)
        part = np.array([(s % self.m.n) / self.m.n for s in self.m.sums])
        return (x - whole).astype(np.float64) - part

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) @ self.basis


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    m = moments(rows)
    if m is None:
        return None
    scatter = exact_scatter(rows, m)
    cube = m.n**3
    v = np.array([[float(Fraction(int(e), cube)) for e in line] for line in scatter])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(Fraction(int(sum(scatter.diagonal())), cube))
    fine = values > max(values[0], 0) * len(v) * np.finfo(float).eps
    scaled = np.where(fine, axes / np.sqrt(np.where(fine, values, 1.0)), np.nan)
    explained = np.maximum(values, 0) / trace if trace > 0 else np.zeros(len(values))
    return Whitener(m, scaled, explained)


def _merge(a: tuple | None, n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
    """Two (count, mean, centred scatter) become one."""
    if a is None:
        return n, mean, scatter
    total, step = a[0] + n, mean - a[1]
    return total, a[1] + step * (n / total), a[2] + scatter + np.outer(step, step) * (a[0] * n / total)


_PARTIAL = "n long, mean array<double>, scatter array<double>"


def _row(state: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": pa.array([state[0]], pa.int64()), "mean": pa.array([state[1]], pa.list_(pa.float64())), "scatter": pa.array([state[2].ravel()], pa.list_(pa.float64()))})


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    fine = ~np.isnan(w.basis[0])
    k, d = int(fine.sum()), len(w.m.sums)
    if not k:
        return 0.0
    live = Whitener(w.m, w.basis[:, fine], w.explained[fine])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                z = live(_matrix(batch.column(0), d))
                mean = z.mean(axis=0)
                state = _merge(state, len(z), mean, (z - mean).T @ (z - mean))
        if state:
            yield _row(state)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for n, mean, scatter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = _merge(state, n, np.array(mean), np.array(scatter).reshape(k, k))
        if state:
            yield _row(state)

    parts = rows.select("x").mapInArrow(partial, _PARTIAL)
    parts = parts.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(merged, _PARTIAL)
    state = None
    for r in parts.toLocalIterator():
        state = _merge(state, r.n, np.array(r.mean), np.array(r.scatter).reshape(k, k))
    return float(np.abs(state[2] / state[0] - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitener, error: float) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    n, d, k = w.m.n, len(w.m.sums), len(w.explained)
    small = d * w.m.reach**2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ids = _matrix(batch.column(1), d), batch.column(0)
            for a in range(0, len(whole), BLOCK):
                x = whole[a : a + BLOCK]
                if small:
                    floors = np.array([s // n for s in w.m.sums], np.int64)
                    rests = np.array([s % n for s in w.m.sums], np.int64)
                    exact = (((x - floors) * n - rests) ** 2).sum(axis=1).tolist()
                else:
                    exact = ((x.astype(object) * n - np.array(w.m.sums, object)) ** 2).sum(axis=1).tolist()
                z = w(x).ravel()
                fits = [e if e < 1 << 63 else None for e in exact]
                decimals = [Decimal(e) if e < 10**38 else None for e in exact]
                take_ids = np.repeat(np.arange(a, a + len(x)), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(take_ids)),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(z), n)),
                        "deviation": pa.array(fits, pa.int64()).take(pa.array(take_ids - a)),
                        "whitened": pa.array(z, pa.float64(), mask=np.isnan(z)),
                        "explained": pa.array(np.tile(w.explained, len(x))),
                        "identity_error": pa.array(np.full(len(z), error)),
                        "deviation_exact": pa.array(decimals, pa.decimal128(38, 0)).take(pa.array(take_ids - a)),
                    }
                )

    return rows.select("vec_id", "x").mapInArrow(run, RESULT)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    spark = embeddings.sparkSession
    prepare(spark)
    rows = vectors(embeddings)
    w = fit(rows, components)
    if w is None:
        return spark.createDataFrame([], RESULT)
    return whiten(rows, w, identity_error(rows, w))
