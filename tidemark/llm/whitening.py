"""Embedding whitening: projections on principal components, each with unit variance.

Entries become the integers floor(64 * c) + 1000000, and the covariance is that of the distinct
integer vectors (the fit list), divisor n. Its sums are exact: vectors are centred on the rounded
mean before they are multiplied, products are added as integers, and what rounding the mean left
over is taken off in rationals. Tasks reduce their rows to one matrix of sums; Spark adds those up.

The eigenvectors start as a float32 solution of the covariance and are corrected by Ogita-Aishima
iterations, which are matrix products in extended precision. Eigenvalues too close for that to
part them form a cluster; within the span of its vectors the covariance, shifted by the cluster's
mean, is solved again. The result is rounded to double precision.

Only sums of the size of the covariance reach the driver (``MAX_DIMS`` bounds it), where the
eigenvectors are found; all work on rows is done by tasks, in batches of bounded size.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped.
Vectors of another length than the most frequent one among the distinct vectors (of equally
frequent lengths the larger) cannot be projected and are dropped too. Components without variance
are left out, so a table of equal vectors gives no rows, as does an empty one. Repeated rows count
once in the fit, and each gets its rows of the result. An entry of 2^54 or more, or a deviation
beyond a long, ends the job with an overflow error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, fresh, table, with_rows, written
from tidemark.llm.sums import column_sums, matrix, products, summed

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_DIMS = 4096
# Entries from here on have integers whose differences may not fit a long.
LARGEST = float(1 << 54)
# Extended precision: 64 bits of mantissa where the machine has them.
WIDE = np.longdouble

@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: n, the sums S, and one unit vector and eigenvalue a component."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # dims x components
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def integers(vector: str) -> Column:
    def whole(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * F.lit(float(SCALE)))
        too_large = F.raise_error(F.lit("overflow: an entry's integer is out of range")).cast("bigint")
        return F.when(F.abs(c.cast("double")) < LARGEST, scaled + F.lit(OFFSET)).otherwise(too_large)

    return F.transform(F.col(vector), whole)


def usable(vector: str) -> Column:
    """No null, no entry null or not finite."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def wide(x: Fraction) -> np.longdouble:
    """A fraction in extended precision: a double and what it leaves."""
    high = float(x)
    return WIDE(high) + WIDE(float(x - Fraction(high)))


def clusters(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Runs of falling eigenvalues whose neighbours lie within ``gap``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    return [c for c in np.split(np.arange(len(values)), cuts) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``a`` from approximate vectors, by Ogita-Aishima iteration.

    A step is four matrix products: R = I - X'X is the lack of orthogonality, S = X'AX what is off
    the diagonal, and E corrects both where eigenvalues are apart. In a cluster E only restores
    orthogonality; the span of its vectors is then solved again with the mean taken off, which
    makes differences visible that vanish beside the eigenvalues themselves.
    """
    identity = np.eye(len(a), dtype=WIDE)
    small = WIDE(np.finfo(WIDE).eps) * len(a)
    norm = np.linalg.norm(a.astype(float))
    before = None
    for _ in range(steps):
        r = identity - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # Below this distance rounding and the present error can't tell two eigenvalues apart.
        gap = 2 * (np.linalg.norm(off.astype(float)) + norm * np.linalg.norm(r.astype(float)))
        gap = max(WIDE(gap), 16 * small * norm)
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        np.fill_diagonal(far, False)
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        for members in clusters(values, gap):
            x[:, members] = sub_solved(a, x[:, members], values[members].mean())
        size = np.abs(e).max()
        if size <= small or (before is not None and size < 1e-12 and size >= before):
            break
        before = size
    x = orthogonal(x)
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def sub_solved(a: np.ndarray, span: np.ndarray, mean: np.longdouble) -> np.ndarray:
    """The vectors of a cluster turned within their span to those of ``a`` less the mean."""
    shifted = span.T @ (a @ span - mean * span)
    scale = np.abs(shifted).max()
    if scale == 0:
        return span
    turn = np.linalg.eigh((shifted / scale).astype(float))[1][:, ::-1].astype(WIDE)
    return span @ orthogonal(turn)


def orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthogonal columns made orthogonal in extended precision (Newton-Schulz)."""
    for _ in range(3):
        x = x @ (np.eye(x.shape[1], dtype=WIDE) * WIDE(1.5) - x.T @ x / 2)
    return x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit vectors of a symmetric extended-precision matrix."""
    scale = np.abs(a).max()
    if scale == 0:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    scaled = a / scale
    start = np.linalg.eigh(scaled.astype(np.float32))[1][:, ::-1]
    values, vectors = refined(scaled, start.astype(WIDE))
    # One sign of the two: the largest entry is positive.
    largest = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.sign(vectors[largest, np.arange(len(a))])


def project(vectors: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows. n*x - S is exact, so only the projection itself rounds."""
    moved = centred(vectors, model)
    return (moved.astype(float) / model.n) @ model.vectors / np.sqrt(model.values)


def centred(vectors: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, in longs where they hold it."""
    most = int(np.abs(vectors).max(initial=0))
    limit = model.n * most + max(map(abs, model.sums), default=0)
    kind = np.int64 if limit < 1 << 62 else object
    return vectors.astype(kind) * model.n - np.array(model.sums, kind)


def deviations(vectors: np.ndarray, model: Whitening) -> list[int]:
    moved = centred(vectors, model)
    most = int(np.abs(moved).max(initial=0))
    exact = moved if most * most * model.dims < 1 << 62 else moved.astype(object)
    return [int(x) for x in (exact * exact).sum(axis=1)]


def fit(frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``frame``; None if there are none.

    Three jobs: the distinct vectors are written once, then summed, then multiplied; a fourth
    measures the covariance of what the model makes of them.
    """
    distinct = written(frame.where(usable(vector)).select(integers(vector).alias("x")).distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None or lengths["dims"] == 0:
        discard(distinct)
        return None
    dims = lengths["dims"]
    if dims > MAX_DIMS:
        discard(distinct)
        raise ValueError(f"vectors of {dims} entries; the covariance is solved in one place up to {MAX_DIMS}")
    fit_list = distinct.where(F.size("x") == dims)
    n, *sums = summed(fit_list, lambda c: np.r_[len(c[0]), column_sums(matrix(c[0], dims))], dims + 1)
    centre = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(dims)
    found = summed(
        fit_list, lambda c: products(matrix(c[0], dims) - np.array(centre, np.int64))[upper], len(upper[0])
    )
    cells = [[0] * dims for _ in range(dims)]
    rest = [s - n * c for s, c in zip(sums, centre)]
    for i, j, uu in zip(*map(np.ndarray.tolist, upper), found):
        # n^2 V = n * sum(u u') - (sum u)(sum u)', all integers.
        cells[i][j] = cells[j][i] = n * uu - rest[i] * rest[j]
    covariance = np.array([[wide(Fraction(c, n * n)) for c in row] for row in cells], WIDE)
    values, vectors = eigen(covariance)
    trace = float(Fraction(sum(cells[i][i] for i in range(dims)), n * n))
    real = int((values > trace * dims * np.finfo(float).eps).sum())
    kept = min(components, real)
    model = Whitening(
        n, tuple(sums), vectors[:, :kept].astype(float), values[:kept].astype(float), trace, 0.0
    )
    error = identity_error(fit_list, model)
    discard(distinct)
    return replace(model, identity_error=error)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, as measured."""
    kept = len(model.values)
    upper = np.triu_indices(kept)

    def make(columns: list[pa.Array]) -> np.ndarray:
        made = project(matrix(columns[0], model.dims), model)
        return np.concatenate([(made.T @ made)[upper], made.sum(axis=0)])

    sums = np.array(summed(fit_list, make, len(upper[0]) + kept, exact=False)) / model.n
    second, first = sums[: len(upper[0])], sums[len(upper[0]) :]
    off = second - first[upper[0]] * first[upper[1]] - (upper[0] == upper[1])
    return float(np.abs(off).max(initial=0.0))


def whiten(frame: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of ``frame`` that can be projected, with ``whitened`` (an array) and ``deviation``.

    Columns of ``frame`` with these names are replaced.
    """
    (x,) = fresh(frame, "integers_")
    rows = frame.where(usable(vector) & (F.size(vector) == model.dims)).withColumn(x, integers(vector))

    def make(columns: list[pa.Array]) -> list:
        vectors = matrix(columns[0], model.dims)
        return [project(vectors, model).tolist(), deviations(vectors, model)]

    new = {"whitened": T.ArrayType(T.DoubleType()), "deviation": T.LongType()}
    return with_rows(rows, new, make, x).drop(x)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None or not len(model.values):
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], T._parse_datatype_string(schema)).select(
            F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("vec_id"), "*"
        )
    shares = F.array(*[F.lit(float(e) / model.trace) for e in model.values])
    return (
        whiten(vectors, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
        .select(
            "vec_id",
            (F.col("place") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            shares[F.col("place")].alias("explained"),
            F.lit(model.identity_error).alias("identity_error"),
        )
    )
