"""Embedding whitening: the leading principal components by spectrum slicing, and every row projected on them.

Spark makes the list of distinct scaled vectors, sums it exactly (whole numbers), and projects all rows; the d by d
covariance alone comes to the driver, where its leading eigenvalues are sliced apart: the inertia of V - s I, from a
symmetric indefinite factorisation L D L', counts the eigenvalues above s, bisection on these counts isolates each, and
Rayleigh quotient iteration converges to it cubically. Counts just below and above the result certify its number. What
counts can't separate in double precision is a multiple eigenvalue, whose subspace is iterated as a block.

Defined results: rows whose vector is null or holds null or non-finite components go, and so do rows of another length
than most; a null vec_id is kept; repeated rows each give their rows, and count once in the fit; components whose
eigenvalue is zero in double precision have no whitened values and aren't returned, so that a fit list of one vector
gives none; extra columns, whatever they are called, aren't read; an empty table gives an empty result. Scaled
components beyond 2^26 count as 2^26. A deviation beyond 64 bits is null.
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

from .common import stored
from .vectors import matrix, scaled

FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
_TOTAL = "i int, j int, v decimal(38,0)"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Bunch and Parlett's bound for taking a single pivot instead of a pair.
_ALPHA = (1 + 17**0.5) / 8


def above(a: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of the symmetric matrix a above shift, by the signs of D in P (a - shift I) P' = L D L'."""
    a = a - shift * np.eye(len(a))
    count = 0
    while len(a):
        size = np.abs(a)
        single = int(np.argmax(np.diagonal(size)))
        r, s = divmod(int(np.argmax(size)), len(a))
        if size[r, s] == 0:
            break
        take = [single] if size[single, single] >= _ALPHA * size[r, s] else [r, s]
        rest = np.delete(np.arange(len(a)), take)
        pivot, side = a[np.ix_(take, take)], a[np.ix_(rest, take)]
        if len(take) == 1:
            count += int(pivot[0, 0] > 0)
            a = a[np.ix_(rest, rest)] - np.outer(side[:, 0], side[:, 0] / pivot[0, 0])
        else:
            count += 1  # the determinant of such a pair is negative: one eigenvalue of each sign
            half = np.linalg.solve(pivot, side.T)
            a = a[np.ix_(rest, rest)] - side @ half
            a = (a + a.T) / 2
    return count


class Slices:
    """Counts of eigenvalues above shifts, each computed once."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.scale = float(np.abs(a).sum(1).max())  # no eigenvalue is larger
        self.tolerance = 8 * len(a) * np.finfo(float).eps * self.scale
        self.known = {-self.scale - 2 * self.tolerance: len(a), self.scale + 2 * self.tolerance: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.a, shift)
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest known shifts with at least k eigenvalues above the lower, fewer above the upper."""
        return max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k)

    def halve(self, k: int) -> tuple[float, float]:
        self.count(sum(self.around(k)) / 2)
        return self.around(k)


def _solved(a: np.ndarray, shift: float, b: np.ndarray, tolerance: float) -> np.ndarray:
    try:
        return np.linalg.solve(a - shift * np.eye(len(a)), b)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a - (shift + tolerance) * np.eye(len(a)), b)


def _without(q: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            q = q - np.outer(v, v @ q).reshape(q.shape) if q.ndim == 2 else q - v * (v @ q)
    return q


def _one(slices: Slices, k: int, found: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Eigenvalue number k and its vector, from an interval that holds no other; None if it can't be certified."""
    a = slices.a
    low, high = slices.around(k)
    while high - low > slices.tolerance:
        q, at = start, (low + high) / 2
        for step in range(12):
            q = _without(_solved(a, at, q, slices.tolerance), found)
            q = q / np.linalg.norm(q)
            value = float(q @ a @ q)
            if step and not low <= value <= high:
                break
            if step and np.linalg.norm(a @ q - value * q) <= slices.tolerance / 2:
                q = _solved(a, value, q, slices.tolerance)  # one more step costs little and takes the vector to full precision
                q = _without(q / np.linalg.norm(q), found)
                q = q / np.linalg.norm(q)
                value = float(q @ a @ q)
                if slices.count(value - slices.tolerance) == k and slices.count(value + slices.tolerance) == k - 1:
                    return value, q
                return None
            at = value if step else at
        low, high = slices.halve(k)
    return None


def _block(slices: Slices, m: int, at: float, found: list[np.ndarray], rng: np.random.Generator) -> list[tuple[float, np.ndarray]]:
    """m eigenvalues that counts don't separate: block inverse iteration, then the block's own rotation."""
    q = np.linalg.qr(_without(rng.standard_normal((len(slices.a), m)), found))[0]
    for _ in range(6):
        q = np.linalg.qr(_without(_solved(slices.a, at, q, slices.tolerance), found))[0]
    values, turn = np.linalg.eigh(q.T @ slices.a @ q)
    return [(float(values[i]), (q @ turn)[:, i]) for i in reversed(range(m))]


def leading(a: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """The k largest eigenvalues of a symmetric matrix with unit vectors, falling; zero and smaller ones are left out."""
    slices, rng, out = Slices(a), np.random.default_rng(13), []
    k = min(k, len(a)) if slices.scale else 0
    while len(out) < k:
        number, found = len(out) + 1, [v for _, v in out]
        low, high = slices.around(number)
        while high - low > slices.tolerance and (slices.count(low) != number or slices.count(high) != number - 1):
            low, high = slices.halve(number)
        one = _one(slices, number, found, rng.standard_normal(len(a))) if slices.count(low) == number else None
        if one is None:
            while high - low > 2 * slices.tolerance:
                low, high = slices.halve(number)
            below, over = (low + high) / 2 - 4 * slices.tolerance, (low + high) / 2 + 4 * slices.tolerance
            many = _block(slices, max(1, slices.count(below) - slices.count(over)), (low + high) / 2, found, rng)
        else:
            many = [one]
        out += many
    return [(value, vector) for value, vector in out[:k] if value > slices.tolerance]


def _products(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exact."""
    if len(x) * float(np.abs(x).max(initial=0)) ** 2 < 2.0**53:
        return (x.astype(float).T @ x.astype(float)).astype(np.int64).astype(object)
    return x.astype(object).T @ x.astype(object)


def _totals(rows: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(rows)
    v = pa.array([Decimal(int(rows[key])) for key in keys], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), v], names=["i", "j", "v"])


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors x and their sum in each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = matrix(batch, "x", d)
            n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield _totals({(-1, 0): n} | {(0, j): total[j] for j in range(d)})

    got = {(r.i, r.j): int(r.v) for r in fit.mapInArrow(run, _TOTAL).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return got.get((-1, 0), 0), [got.get((0, j), 0) for j in range(d)]


def products(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """The sums of products of x - centre (whole numbers), exact: each task sends one triangle, Spark adds them."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((d, d), object), False
        for batch in batches:
            total, any_rows = total + _products(matrix(batch, "x", d) - centre), True
        if any_rows:
            yield _totals({(i, j): total[i, j] for i in range(d) for j in range(i, d)})

    out = np.zeros((d, d), object)
    for r in fit.mapInArrow(run, _TOTAL).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = int(r.v)
    return out


@dataclass
class Whitening:
    """What a fit knows: components are rows of `axes`."""

    n: int
    centre: np.ndarray  # whole numbers near the mean
    rest: list[int]  # sum of x - centre
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole vectors: the mean goes in two steps, neither of which loses digits."""
        return ((x - self.centre).astype(float) - np.array(self.rest, float) / self.n) @ self.axes.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y, top = x - self.centre, 2**63 - 1
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest))
        kind = np.int64 if len(self.rest) * most * most <= top else object
        gone = self.n * y.astype(kind) - np.array(self.rest, kind)
        return [int(v) if v <= top else None for v in (gone * gone).sum(1)]


def fit_whitening(fit: DataFrame, d: int, k: int) -> Whitening | None:
    """fit: distinct x (array<long>) of length d. None where no component is left."""
    n, total = sums(fit, d)
    if not n:
        return None
    centre = np.array([round(Fraction(s, n)) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    p = products(fit, centre)
    v = np.array([[float(Fraction(n * p[i, j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    pairs = leading(v, k) if np.trace(v) > 0 else []
    if not pairs:
        return None
    values = np.array([value for value, _ in pairs])
    model = Whitening(n, centre, rest, np.array([q for _, q in pairs]), values, values / np.trace(v))
    model.identity_error = identity_error(fit, model)
    return model


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from the list itself."""
    d, k = len(model.centre), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(matrix(batch, "x", d))
            first, second = first + w.sum(0), second + w.T @ w
        i, j = np.divmod(np.arange(k * (k + 1)), k)
        yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["i", "j", "v"])

    got = {(r.i, r.j): r.v for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[-1, j] for j in range(k)]) / model.n
    cov = np.array([[got[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and embedding of every row: a row for each component (from 1, by falling variance) with n (vectors in the
    fit list), deviation (squared distance of n x from the sum), whitened, explained and identity_error."""
    spark = embeddings.sparkSession
    rows, d = scaled(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")), "embedding", FACTOR)
    rows = rows.select("vec_id", F.transform("x", lambda c: c + OFFSET).alias("x"))
    model = fit_whitening(stored(rows.select("x").distinct(), "fit")[0], d, components) if d else None
    if model is None:
        return spark.createDataFrame([], _OUT)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = matrix(part, "x", d)
                m = len(x)
                times = np.repeat(np.arange(m), k)
                columns = [
                    part.column("vec_id").take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(times)),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
