"""Whitening against plain numpy over whole tables, and eigenvectors with clustered eigenvalues."""

import math

import numpy as np
import pytest
from conftest import SMALL

from tidemark.llm import whitening
from tidemark.llm.sums import products
from tidemark.llm.whitening import WIDE, eigen, op12_whitening


def brute(rows):
    """{(row number, component): (deviation, |whitened|, explained)} and n."""
    kept = {
        k: tuple(math.floor(64 * float(c)) + 1000000 for c in v)
        for k, v in enumerate(rows)
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    listed = sorted(set(kept.values()))
    if not listed or not listed[0]:
        return {}, len(listed)
    n, sums = len(listed), [sum(x) for x in zip(*listed)]
    moved = np.array([[n * c - s for c, s in zip(x, sums)] for x in listed], float) / n
    values, vectors = np.linalg.eigh(moved.T @ moved / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for k, x in kept.items():
        off = [n * c - s for c, s in zip(x, sums)]
        for i in range(16):
            if i < len(values) and values[i] > 1e-9 * values.sum():
                w = np.array(off, float) / n @ vectors[:, i] / math.sqrt(values[i])
                found[k, i + 1] = (sum(o * o for o in off), abs(w), values[i] / values.sum())
    return found, n


def compare(spark, rows, folder, close=1e-7):
    frame = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, n int")
    frame.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    rows = [v and [None if c is None else float(np.float32(c)) for c in v] for v in rows]
    found = op12_whitening(spark, str(folder)).collect()
    want, n = brute(rows)
    assert {(r["vec_id"], r["component"]) for r in found} == set(want)
    assert len(found) == len(want)
    for r in found:
        deviation, size, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, abs=close)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        assert r["identity_error"] < 1e-9
    return found


def test_given_table(spark):
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id")
    rows = [r["embedding"] for r in frame.collect()]
    found = {(r["vec_id"], r["component"]): r for r in op12_whitening(spark, SMALL).collect()}
    want, n = brute(rows)
    assert len(found) == len(want) == 16 * frame.count()
    signs = {}
    for key, (deviation, size, share) in want.items():
        r = found[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, abs=1e-9)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
    assert max(r["identity_error"] for r in found.values()) < 1e-9


def test_awkward_rows(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [list(map(float, r)) for r in rnd.normal(size=(60, 20)) * np.linspace(3, 0.2, 20)]
    rows += [rows[0]] * 40 + [None, [None] * 20, rows[1][:-1] + [None]]
    rows += [rows[2][:-1] + [float("nan")], rows[3][:-1] + [float("inf")], rows[4][:-1] + [float("-inf")]]
    compare(spark, rows, tmp_path)


def test_few_dimensions_and_flat_ones(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [[*map(float, r), 7.0, 7.0] for r in rnd.normal(size=(30, 3))]
    found = compare(spark, rows, tmp_path)
    assert {r["component"] for r in found} == {1, 2, 3}


def test_large_entries(spark, tmp_path):
    """Products beyond 2^53 are added as Python integers; deviations stay exact."""
    rnd = np.random.default_rng(4)
    rows = [list(map(float, r)) for r in rnd.normal(size=(12, 3)) * 2e5]
    compare(spark, rows, tmp_path, close=1e-6)


@pytest.mark.parametrize("rows", [[], [None], [[1.0, 2.0]] * 5, [[], []]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert compare(spark, rows, tmp_path) == []


def test_other_lengths_are_left_out(spark):
    rnd = np.random.default_rng(5)
    rows = [(list(map(float, r)),) for r in rnd.normal(size=(20, 4))] + [([1.0, 2.0],), ([],)]
    frame = spark.createDataFrame(rows, "embedding array<double>").selectExpr("*", "'mine' AS whitened")
    model = whitening.fit(frame)
    out = whitening.whiten(frame, model)
    assert (model.n, model.dims, out.count()) == (20, 4, 20)
    assert out.columns == ["embedding", "whitened", "deviation"]


def test_entries_out_of_range(spark):
    frame = spark.createDataFrame([([1e30, 1.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="overflow"):
        whitening.fit(frame)


def test_products_are_exact():
    rnd = np.random.default_rng(6)
    for size in (10, 1 << 20, 1 << 27, 1 << 40):
        rows = rnd.integers(-size, size, (70, 5))
        want = rows.astype(object).T @ rows.astype(object)
        assert (products(rows) == want).all()


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 100, 40),
        np.r_[50 + np.arange(10) * 1e-9, np.full(10, 20.0), np.linspace(1e-6, 10, 20)],
        np.r_[1e6, 3 + np.arange(20) * 1e-6, np.zeros(19)],
        np.ones(40),
        np.zeros(40),
    ],
)
def test_eigenvectors(values):
    rnd = np.random.default_rng(7)
    q = whitening.orthogonal(np.linalg.qr(rnd.normal(size=(40, 40)))[0].astype(WIDE))
    a = q @ (values.astype(WIDE)[:, None] * q.T)
    a = (a + a.T) / 2
    found, x = eigen(a)
    want = np.sort(values)[::-1]
    scale = max(values.max(), 1e-300)
    assert np.abs(found - want).max() <= 1e-15 * scale
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() <= 1e-17 * scale
    order = np.argsort(-values, kind="stable")
    for k in range(40):  # where a neighbour is within 1e-7 of the largest, vectors of a cluster may mix
        if np.sort(np.abs(values - values[order[k]]))[1] > 1e-13 * scale:
            assert abs(abs(x[:, k] @ q[:, order[k]]) - 1) < 1e-12
