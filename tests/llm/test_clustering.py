"""Clusters against plain integer arithmetic over all pairs."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import clustering
from tidemark.llm.clustering import assign, centroid_sha, fit, nearest, op11_clustering


def brute(rows, k=40, rounds=5, dims=64, scale=256):
    """Sorted result rows of the contract, for rows of (vec_id, vector)."""
    kept = [
        (i, [math.floor(scale * float(c)) for c in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]
    sha = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [x for _, x in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def assigned():
        return [
            min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(centroids)) for _, x in kept
        ]

    for _ in range(rounds):
        best = assigned()
        for c in range(len(centroids)):
            members = [x for (_, x), (_, at) in zip(kept, best) if at == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    best = assigned()
    inertia = [sum(q for q, at in best if at == c) for c in range(len(centroids))]
    return sorted(
        ((i, c, q, inertia[c], sum(inertia), centroid_sha(centroids[c])) for (i, _), (q, c) in zip(kept, best)), key=repr
    )


def check(spark, rows, folder):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    frame.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    found = sorted(map(tuple, op11_clustering(spark, str(folder)).collect()), key=repr)
    rows = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert found == brute(rows)
    return found


def vectors(rnd, n, spread=0.3):
    centres = rnd.normal(size=(7, 64)) * spread
    return [list(map(float, centres[rnd.integers(7)] + rnd.normal(size=64) * 0.05)) for _ in range(n)]


def test_awkward_rows(spark, tmp_path):
    rnd = np.random.default_rng(1)
    made = vectors(rnd, 150)
    rows = list(enumerate(made)) + [(7, made[7])] * 3 + [(1000 + i, made[3]) for i in range(60)]
    rows += [(None, made[5]), (900, None), (901, made[0][:63]), (902, [*made[0], 1.0]), (903, [])]
    rows += [(904, [None, *made[0][1:]]), (905, [float("nan"), *made[0][1:]]), (906, [float("-inf"), *made[0][1:]])]
    check(spark, rows, tmp_path)


def test_ties_and_equal_seeds(spark, tmp_path):
    """Coarse vectors: equal seeds, equal distances, empty clusters that stay."""
    rnd = np.random.default_rng(2)
    rows = [(i, [float(c) / 256 for c in rnd.integers(-1, 2, 2)] + [0.0] * 62) for i in range(200)]
    check(spark, rows, tmp_path)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, tmp_path, n):
    assert len(check(spark, list(enumerate(vectors(np.random.default_rng(3), n))), tmp_path)) == n


def test_large_entries(spark, tmp_path):
    rnd = np.random.default_rng(4)
    rows = [(i, list(map(float, r))) for i, r in enumerate(rnd.normal(size=(60, 64)) * 1e5)]
    check(spark, rows, tmp_path)
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="overflow"):
        fit(frame)


def test_filter_never_loses_the_nearest_and_spares_work():
    rnd = np.random.default_rng(5)
    for scale in (3, 300, 1e7):
        x = np.floor(rnd.normal(size=(3000, 64)) * scale * 3 * 0.85 ** np.arange(64)).astype(np.int64)
        centroids = x[:50].copy()
        centroids[10] = centroids[3]
        moved = x - x.mean(axis=0)
        axes = np.linalg.eigh(moved.T @ moved)[1][:, ::-1][:, :16]
        rotation = clustering.Rotation(x.mean(axis=0), axes)
        leading, rest = rotation.apply(x)
        numbers, distances, verified = nearest(x, leading.astype(np.float32), rest, centroids, rotation)
        exact = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
        assert (numbers == exact.argmin(axis=1)).all() and (distances == exact.min(axis=1)).all()
        assert verified < 0.2 * exact.size


def test_other_parameters_and_kept_columns(spark):
    rnd = np.random.default_rng(6)
    rows = [(f"k{i}", list(map(float, r)), i) for i, r in enumerate(rnd.normal(size=(90, 5)))]
    frame = spark.createDataFrame(rows, "name string, v array<double>, distance int")
    found = fit(frame, vector="v", key="name", k=3, rounds=2, dims=5, scale=10, share=0.5)
    out = assign(frame, found, "v")
    assert out.columns == ["name", "v", "cluster", "distance"]
    want = {(i, c, q) for i, c, q, *_ in brute([r[:2] for r in rows], 3, 2, 5, 10)}
    assert {(r["name"], r["cluster"], r["distance"]) for r in out.collect()} == want
