"""Centroid clustering in integers, with a PCA-rotated filter before exact distances.

Vectors become integers floor(scale * x). Rounds of assignment and exact floored means follow, all
reproducible to the last digit. To skip most exact distances every vector is stored with its leading
coordinates on the principal axes and the norm of what they leave out. For a vector and a centroid
the distance of the leading coordinates and the difference of the two norms together bound the
distance from below; only centroids whose bound does not exceed the distance of the most promising
one are verified, in integers. The bound is lowered by more than all rounding can amount to, so the
nearest centroid always survives, and all that are equally near: the smallest number wins.

The rotated table is written once and read by every round. A round sends one row per cluster and
dimension from each task; k centroids are all that reaches the driver (``MAX_CELLS`` bounds them).

Defined results: vectors that are null, have other than ``dims`` entries, or null or non-finite
ones, are left out. Of fewer than k vectors each is a centroid; equal vectors may be several, of
which the smallest number takes all and the others stay empty and keep their place. Seeds with equal
hashes (repeated keys) come in the order of their vectors, null keys last. An empty table gives no
rows, repeated rows count each. Entries too large for distances to fit a long end the job with an
overflow error. Columns named ``cluster`` or ``distance`` are replaced.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, fresh, table, with_rows, written
from tidemark.llm.sums import column_sums, matrix, summed

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
# Share of the variance that the leading coordinates hold: few axes on vectors that lie in clusters,
# most of them on vectors without any direction of their own.
SHARE = 0.9
MAX_CELLS = 1 << 24
# Share of the two norms by which a bound is lowered. Coordinates are stored as floats of 24 bits;
# this is 16 times their rounding.
SLACK = 2.0**-20
# Rows compared with all centroids at once.
STEP = 2048


@dataclass(frozen=True)
class Rotation:
    """Principal axes about a centre; ``axes`` has one orthonormal column per leading coordinate."""

    centre: np.ndarray
    axes: np.ndarray

    def apply(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the rest."""
        moved = vectors - self.centre
        leading = moved @ self.axes
        return leading, np.linalg.norm(moved - leading @ self.axes.T, axis=1)


@dataclass(frozen=True)
class Clusters:
    centroids: np.ndarray  # k x dims, integers
    rotation: Rotation
    sizes: list[int]
    inertias: list[int]
    scale: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def usable(vector: str, dims: int) -> Column:
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(vector: str, scale: int, dims: int) -> Column:
    """floor(scale * x); entries whose squared distances might pass a long raise an error."""
    largest = float(math.isqrt((1 << 62) // dims) // 2)

    def whole(c: Column) -> Column:
        scaled = c.cast("double") * F.lit(float(scale))
        too_large = F.raise_error(F.lit("overflow: an entry is too large for exact distances")).cast("bigint")
        return F.when(F.abs(scaled) < largest, F.floor(scaled)).otherwise(too_large)

    return F.transform(F.col(vector), whole)


def principal_axes(rows: DataFrame, dims: int, about: np.ndarray, share: float) -> Rotation:
    """From the second moments of all rows; any orthonormal axes are right, these filter best."""

    def make(columns: list[pa.Array]) -> np.ndarray:
        moved = matrix(columns[0], dims) - about
        return np.concatenate([[len(moved)], moved.sum(axis=0), (moved.T @ moved).ravel()])

    sums = np.array(summed(rows, make, 1 + dims + dims * dims, exact=False))
    n, first, second = sums[0], sums[1 : dims + 1], sums[dims + 1 :].reshape(dims, dims)
    mean = first / n
    values, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
    held = np.cumsum(np.maximum(values[::-1], 0))
    leading = 1 + int(np.searchsorted(held, share * held[-1]))
    return Rotation(about + mean, np.linalg.qr(axes[:, ::-1][:, :leading])[0])


def nearest(
    vectors: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many were verified."""
    c_leading, c_rest = rotation.apply(centroids)
    points = np.c_[leading, rest].astype(float)
    goals = np.c_[c_leading, c_rest]
    sizes, goal_sizes = np.linalg.norm(points, axis=1), np.linalg.norm(goals, axis=1)
    numbers, distances = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
    verified = 0
    for start in range(0, len(vectors), STEP):
        part = slice(start, start + STEP)
        some, x = points[part], vectors[part].astype(np.int64)
        squares = sizes[part, None] ** 2 + goal_sizes**2 - 2 * some @ goals.T
        bound = np.sqrt(np.maximum(squares, 0)) - SLACK * (sizes[part, None] + goal_sizes)
        bound = np.maximum(bound, 0) ** 2
        every = np.arange(len(x))
        promising = bound.argmin(axis=1)
        exact = np.full(bound.shape, np.iinfo(np.int64).max)
        first = exact[every, promising] = ((x - centroids[promising]) ** 2).sum(axis=1)
        left = bound <= first[:, None]
        left[every, promising] = False
        verified += len(x) + int(left.sum())
        for number in np.flatnonzero(left.any(axis=0)):
            rows = np.flatnonzero(left[:, number])
            exact[rows, number] = ((x[rows] - centroids[number]) ** 2).sum(axis=1)
        numbers[part] = exact.argmin(axis=1)
        distances[part] = exact.min(axis=1)
    return numbers, distances, verified


def fit(
    frame: DataFrame,
    *,
    vector: str = "embedding",
    key: str = "vec_id",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: str = SEED,
    share: float = SHARE,
) -> Clusters | None:
    """Centroids after ``rounds`` rounds, with sizes and inertias; None without usable vectors."""
    if k * dims > MAX_CELLS or dims * dims > MAX_CELLS:
        raise ValueError(f"centroids and axes of more than {MAX_CELLS} entries are not held in one place")
    kept = frame.where(usable(vector, dims)).select(F.col(key).alias("key"), integers(vector, scale, dims).alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    seeds = kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    if not seeds:
        return None
    centroids = np.array([r["x"] for r in seeds], np.int64)
    rotation = principal_axes(kept.select("x"), dims, centroids[0].astype(float), share)

    def rotate(columns: list[pa.Array]) -> list:
        coordinates, rest = rotation.apply(matrix(columns[0], dims))
        return [coordinates.astype(np.float32).tolist(), rest]

    stored = {"leading": T.ArrayType(T.FloatType()), "rest": T.DoubleType()}
    rotated = written(with_rows(kept.select("x"), stored, rotate, "x"), "rotated")

    def assigned() -> tuple[list[int], list[int], list[list[int]]]:
        """Sizes, inertias and vector sums of all clusters."""
        now = centroids

        def make(columns: list[pa.Array]) -> np.ndarray:
            x = matrix(columns[0], dims)
            coordinates = matrix(columns[1], rotation.axes.shape[1])
            numbers, distances, _ = nearest(x, coordinates, columns[2].to_numpy(), now, rotation)
            made = np.zeros((len(now), dims + 2), object)
            order = np.argsort(numbers, kind="stable")
            cuts = np.searchsorted(numbers[order], np.arange(len(now) + 1))
            for number in np.unique(numbers):
                rows = order[cuts[number] : cuts[number + 1]]
                made[number, 0] = len(rows)
                made[number, 1] = column_sums(distances[rows, None])[0]
                made[number, 2:] = column_sums(x[rows])
            return made.ravel()

        cells = summed(rotated, make, len(now) * (dims + 2))
        table = [cells[i : i + dims + 2] for i in range(0, len(cells), dims + 2)]
        return [r[0] for r in table], [r[1] for r in table], [r[2:] for r in table]

    for _ in range(rounds):
        sizes, _, sums = assigned()
        moved = [[s // n for s in row] if n else list(old) for n, row, old in zip(sizes, sums, centroids)]
        centroids = np.array(moved, np.int64)
    sizes, inertias, _ = assigned()
    discard(rotated)
    return Clusters(centroids, rotation, sizes, inertias, scale)


def assign(frame: DataFrame, clusters: Clusters, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``frame`` with ``cluster`` and ``distance`` (squared)."""
    (x,) = fresh(frame, "integers_")
    centroids, rotation, dims = clusters.centroids, clusters.rotation, clusters.dims

    def make(columns: list[pa.Array]) -> list:
        vectors = matrix(columns[0], dims)
        coordinates, rest = rotation.apply(vectors)
        return list(nearest(vectors, coordinates, rest, centroids, rotation)[:2])

    rows = frame.where(usable(vector, dims)).withColumn(x, integers(vector, clusters.scale, dims))
    return with_rows(rows, {"cluster": T.IntegerType(), "distance": T.LongType()}, make, x).drop(x)


def centroid_sha(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    clusters = fit(vectors)
    if clusters is None:
        schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {schema}")

    def of_cluster(values: list) -> Column:
        return F.array(*map(F.lit, values))[F.col("cluster")]

    return assign(vectors, clusters).select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(clusters.inertias).cast("long").alias("cluster_inertia"),
        F.lit(sum(clusters.inertias)).cast("long").alias("inertia"),
        of_cluster([centroid_sha(c) for c in clusters.centroids]).alias("centroid_sha256"),
    )


def _sql() -> str:
    """The rounds one after the other, every vector against every centroid."""
    steps = f"""
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS}
), entries AS MATERIALIZED (
    SELECT r, vec_id, unnest(range({DIMS})) AS d, unnest(embedding) AS e FROM rows
), kept AS MATERIALIZED (
    SELECT r, vec_id FROM entries GROUP BY r, vec_id HAVING bool_and(e IS NOT NULL AND isfinite(e))
), cells AS MATERIALIZED (
    SELECT r, d, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM entries SEMI JOIN kept USING (r)
), seeds AS MATERIALIZED (
    SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept
    ORDER BY c LIMIT {K}
), c0 AS MATERIALIZED (
    SELECT c, d, x AS m FROM seeds JOIN cells USING (r)
)"""
    for n in range(ROUNDS + 1):
        steps += f""", q{n} AS (
    SELECT r, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS q FROM cells JOIN c{n} USING (d) GROUP BY r, c
), a{n} AS MATERIALIZED (
    SELECT r, min({{'q': q, 'c': c}}) AS best FROM q{n} GROUP BY r
)"""
        if n < ROUNDS:
            steps += f""", s{n} AS (
    SELECT best.c AS c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS k
    FROM cells JOIN a{n} USING (r) GROUP BY ALL
), c{n + 1} AS MATERIALIZED (
    SELECT c, d, coalesce((s - ((s % k) + k) % k) // k, m) AS m FROM c{n} LEFT JOIN s{n} USING (c, d)
)"""
    return steps + f""", hashed AS (
    SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c
), totals AS (
    SELECT best.c AS c, CAST(sum(best.q) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY best.c
)
SELECT vec_id, CAST(best.c AS INTEGER) AS "cluster", best.q AS distance, cluster_inertia,
       CAST((SELECT sum(cluster_inertia) FROM totals) AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN totals ON totals.c = best.c JOIN hashed ON hashed.c = best.c
"""


SQL = _sql()
