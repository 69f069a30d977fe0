"""Operator 11: whitening of embeddings through the polarisation identity.

The covariance of two dimensions is a difference of variances,
``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``, so sums of squares of
centred values are all that has to be gathered: one for every dimension and
one for every sum of two dimensions.

1. ``totals``: the number of vectors n and the sum S of every dimension.
2. ``squares``: tasks centre each entry by the integer mean, u = x - floor(S/n),
   and add up u_a^2 and (u_a + u_b)^2 in integers. With r = S - n*floor(S/n),
   n*x - S = n*u - r, so the square sum of the contract's centred values
   n*x - S (and of their pair sums) is n * (n*sum(u^2) - r^2), exactly. Centring
   by the integer mean keeps the summands small whatever n is: they are 64-bit
   integers in a task and decimals between tasks.
3. ``fit``: differences give every covariance as an exact integer over 2*n^2,
   rounded once to a double; d x d of them go to the driver for ``eigh``. What the
   driver holds is bounded by the dimension, not by the rows.
4. ``whitened``: rows are centred and projected where they lie, and one more
   pass measures the covariance of the whitened values.

Nothing is shuffled but one row of sums per task and dimension pair; no key
can be hot.

Defined results: vectors that are null, shorter than the table's longest or
hold a null or non-finite entry are dropped; entries of 131,072 or more are an
error (``vectors.py``); repeated rows and rows of one id are rows of their
own, a null id stays; an empty table gives no rows. A component without variance (its
eigenvalue below d * 2^-50 of the largest: constant or dependent dimensions, a
single row) has ``whitened`` NULL and takes no part in ``identity_error``, which is
NULL when no component has variance. ``deviation`` is NULL where it does not
fit a long; ``deviation_exact`` always holds it. Other columns pass through; those
named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import shared, vectors
from clusterlens.sources.tables import table

OFFSET = 100_000
COMPONENTS = 8
_ROWS = 1 << 12  # rows squared at a time


def totals(rows: DataFrame, col: str, dim: int) -> tuple[int, list[int]]:
    """(n, sum of every dimension of x) over usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            x = vectors.matrix(batch.column(0), dim)
            n, sums = n + len(x), sums + x.sum(0).astype(object)
        at = pa.array(range(-1, dim), pa.int32())
        yield pa.RecordBatch.from_arrays([at, _decimals([n, *sums])], names=["at", "total"])

    parts = rows.select(F.col(f"`{col}`")).mapInArrow(run, "at int, total decimal(38,0)")
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    n = found.get(-1, 0)
    return n, [found.get(k, 0) + n * OFFSET for k in range(dim)]


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def squares(rows: DataFrame, col: str, dim: int, means: list[int]) -> dict[tuple[int, int], int]:
    """Sums over the rows of u_a^2, keyed (a, a), and of (u_a + u_b)^2, keyed
    (a, b) for a < b, where u is x less the integer ``means``."""
    shift = np.array(means, np.int64) - OFFSET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(dim - a, dtype=object) for a in range(dim)]
        for batch in batches:
            u = vectors.matrix(batch.column(0), dim) - shift
            for at in range(0, len(u), _ROWS):
                part = np.ascontiguousarray(u[at:at + _ROWS].T)
                # exact: below 2^25 each, 2^12 squares of pair sums stay below 2^63
                part = part.astype(object) if np.abs(part).max() >= 1 << 24 else part
                for a in range(dim):
                    pair = part[a:] + part[a]
                    pair[0] = part[a]
                    sums[a] = sums[a] + (pair * pair).sum(1).astype(object)
        for a in range(dim):
            b = pa.array(range(a, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(b), pa.int32()), b, _decimals(sums[a])],
                                             names=["a", "b", "total"])

    parts = rows.select(F.col(f"`{col}`")).mapInArrow(run, "a int, b int, total decimal(38,0)")
    return {(r["a"], r["b"]): int(r["total"]) for r in parts.groupBy("a", "b").agg(F.sum("total").alias("total"))
            .toLocalIterator()}


class Whitening:
    """A fitted transform: integer means, remainders, eigenpairs."""

    def __init__(self, n: int, sums: list[int], square: dict[tuple[int, int], int], components: int):
        dim = len(sums)
        self.n, self.means = n, [s // n for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.means, strict=True)]
        var = {(a, b): n * q - (self.rest[a] + (self.rest[b] if a != b else 0)) ** 2 for (a, b), q in square.items()}
        cov = np.empty((dim, dim))
        for a in range(dim):
            cov[a, a] = Fraction(var[a, a], n * n)
            for b in range(a + 1, dim):
                cov[a, b] = cov[b, a] = Fraction(var[a, b] - var[a, a] - var[b, b], 2 * n * n)
        self.covariance = cov
        values, axes = np.linalg.eigh(cov)
        self.values = values[::-1][:components]
        self.axes = axes[:, ::-1][:, :components]
        self.trace = float(Fraction(sum(var[a, a] for a in range(dim)), n * n))
        self.live = self.values > max(values[-1], 0.0) * dim * 2.0 ** -50

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def project(self, u: np.ndarray) -> np.ndarray:
        """Whitened values of rows already less the integer means; NaN where a
        component has no variance."""
        centred = u - np.array([float(Fraction(r, self.n)) for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return (centred @ self.axes) / np.where(self.live, np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, u: np.ndarray) -> list[int]:
        """Exact sum over the dimensions of (n*x - S)^2 = (n*u - r)^2 per row."""
        n, rest = self.n, self.rest
        wide = u.astype(object) if len(u) and np.abs(u).max() >= 1 << 24 or n >= 1 << 31 else u
        own = (wide * wide).sum(1)
        cross = (wide * np.array(rest, dtype=wide.dtype)).sum(1)
        fixed = sum(r * r for r in rest)
        return [n * n * int(a) - 2 * n * int(b) + fixed for a, b in zip(own, cross, strict=True)]


def fit(rows: DataFrame, col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of ``rows``; None when there is none."""
    dim = vectors.dimension(rows, col)
    rows = rows.where(vectors.usable(col, dim))
    n, sums = totals(rows, col, dim)
    if not n:
        return None
    return Whitening(n, sums, squares(rows, col, dim, [s // n for s in sums]), components)


_ADDED = [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
          T.StructField("deviation_exact", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
          T.StructField("explained", T.DoubleType())]


def whitened(rows: DataFrame, model: Whitening, col: str = "embedding") -> DataFrame:
    """One row per usable vector and component."""
    dim, components = len(model.means), len(model.values)
    rows = shared.without(rows, "deviation", "identity_error", *[f.name for f in _ADDED])
    own = rows.columns
    kept = rows.where(vectors.usable(col, dim))
    kept = shared.packed(kept, vector=F.col(f"`{col}`"))
    shift = np.array(model.means, np.int64) - OFFSET
    explained, n = model.explained(), model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = vectors.matrix(batch.column(1), dim) - shift
            size = len(u)
            values = model.project(u).reshape(-1)
            at = pa.array(np.repeat(np.arange(size), components))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), size)),
                 pa.array([n] * (size * components), pa.int64()), _decimals(model.deviations(u)).take(at),
                 pa.array(values, mask=np.isnan(values)), pa.array(explained * size, pa.float64())],
                names=["row", *[f.name for f in _ADDED]])

    out = kept.mapInArrow(run, T.StructType([kept.schema["row"], *_ADDED]))
    return out.select(*[F.col(f"row.`{c}`") for c in own], *[f.name for f in _ADDED])


def identity_error(rows: DataFrame, model: Whitening, col: str = "embedding") -> float | None:
    """Largest entry of |covariance of the whitened values - identity|, measured
    on the values themselves (components with variance only)."""
    dim, live = len(model.means), np.flatnonzero(model.live)
    if not len(live):
        return None
    shift = np.array(model.means, np.int64) - OFFSET
    size = len(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = model.project(vectors.matrix(batch.column(0), dim) - shift)[:, live]
            one, two = one + w.sum(0), two + w.T @ w
        flat = np.concatenate([one, two.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    parts = rows.where(vectors.usable(col, dim)).select(F.col(f"`{col}`")).mapInArrow(run, "at int, v double")
    found = {r["at"]: r["v"] / model.n for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([found[k] for k in range(size)])
    second = np.array([found[size + k] for k in range(size * size)]).reshape(size, size)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(size)).max())


def op11_polar_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector of ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double, deviation_exact decimal(38,0)")
    return whitened(rows, model).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"), "whitened",
        "explained", F.lit(identity_error(rows, model)).cast("double").alias("identity_error"), "deviation_exact")
