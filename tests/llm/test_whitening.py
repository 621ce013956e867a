"""Whitening against a dense eigendecomposition."""

import math
import random

import numpy as np
import pytest

from sentigrade.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n string, x int"


def plain(vectors, components=8):
    """x, deviation, eigenvalues and components by a dense decomposition."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    n = len(x)
    total = x.sum(axis=0)
    centred = (n * x - total) / n
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    _, s, right = np.linalg.svd(centred, full_matrices=False)
    return n, deviation, s**2 / n, right, centred


def check(got, vectors, keys, components=8, tolerance=1e-9):
    n, deviation, values, right, centred = plain(vectors)
    share = values / values.sum()
    count = min(components, len(vectors[0]), int((np.sqrt(values) > 1e-10 * np.sqrt(values[0])).sum()))
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == len(keys) * count
    for c in range(count):
        want = centred @ right[c] / math.sqrt(values[c])
        have = np.array([by[k, c + 1].whitened for k in keys])
        assert np.abs(np.abs(want) - np.abs(have)).max() < tolerance
        assert np.sign(want @ have) * (want @ have) == pytest.approx(n, rel=1e-9)
        for k, d in zip(keys, deviation):
            row = by[k, c + 1]
            assert row.n == n and row.deviation == d and row.explained == pytest.approx(share[c], rel=1e-9) and row.identity_error < 1e-9


def made(count, width, seed=0, scale=None):
    rng = np.random.default_rng(seed)
    scale = np.geomspace(1, 0.01, width) if scale is None else scale
    rotate = np.linalg.qr(rng.standard_normal((width, width)))[0]
    return [[float(np.float32(c)) for c in v] for v in rng.standard_normal((count, width)) * scale @ rotate]


@pytest.mark.parametrize("count, width", [(400, 20), (3, 12), (60, 5), (50, 1)])
def test_same_as_a_dense_decomposition(spark, count, width):
    vectors = made(count, width)
    df = spark.createDataFrame([(k, v, 1, "n", 0) for k, v in enumerate(vectors)], KIND).repartition(4)
    check(whitening.whiten(df).collect(), vectors, range(count))


def test_rows_without_usable_vectors(spark):
    vectors = made(30, 6)
    bad = [None, [], [None] * 6, [*vectors[0][:5], float("nan")], [*vectors[0][:5], float("inf")], [1e38] * 6]
    rows = [(k, v, 1, "n", 0) for k, v in enumerate(vectors)] + [(100 + k, v, 1, "n", 0) for k, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND).repartition(3))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), vectors, range(30))
    nothing = [(1, None, 1, "n", 0), (2, [1.0, 2.0], 1, "n", 0), (3, [1.0, 2.0], 1, "n", 0)]
    assert whitening.whiten(spark.createDataFrame(nothing, KIND)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0


def test_repeated_ids_and_two_lengths(spark):
    a, b = made(25, 6), made(20, 3, 1)
    rows = [(k, v, None, "n", 0) for k, v in enumerate(a)] + [(50 + k, v, 1, "n", 0) for k, v in enumerate(b)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    check([r for r in got if r.vec_id < 50], a, range(25))
    check([r for r in got if r.vec_id >= 50], b, range(50, 70))
    again = spark.createDataFrame([(None, v, 1, "n", 0) for v in a] + [(7, a[0], 1, "n", 0)] * 9, KIND)
    found = whitening.whiten(again).collect()
    assert len(found) == 34 * 6 and {r.n for r in found} == {34}


def test_integers_beyond_longs(spark):
    rng = random.Random(5)
    vectors = [[rng.choice([-1, 1]) * 1e15 * rng.random() for _ in range(4)] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    assert len(got) == 160 and {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-9
    sums = whitening.exact_sums(whitening.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))[4]
    assert sums.total == tuple(sum(math.floor(1024 * v[c]) + 100_000 for v in vectors) for c in range(4))


def test_equal_values_are_all_found():
    rng = np.random.default_rng(2)
    left = np.linalg.qr(rng.standard_normal((300, 30)))[0]
    right = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.array([9.0, 5, 5, 5, 4, 4, 3, 3, 3, *np.linspace(2, 0.1, 21)])
    matrix = left * values @ right.T
    steps = 0

    def product(v, last, earlier):
        nonlocal steps
        steps += 1
        w = matrix @ v - (last[0] * (matrix @ last[1]) if last else 0)
        return np.concatenate([matrix.T @ w, [w @ w], (matrix @ earlier).T @ w])

    found = whitening.leading(product, 30, 8)
    assert np.allclose([s for s, _ in found], values[:8], rtol=1e-12)
    basis = np.stack([v for _, v in found])
    assert np.abs(basis @ basis.T - np.eye(8)).max() < 1e-10
    assert np.abs(np.linalg.norm(matrix @ basis.T, axis=0) - values[:8]).max() < 1e-10


def test_few_steps_for_a_long_vector():
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((2000, 400)) * np.geomspace(1, 1e-3, 400)
    steps = 0

    def product(v, last, earlier):
        nonlocal steps
        steps += 1
        w = matrix @ v - (last[0] * (matrix @ last[1]) if last else 0)
        return np.concatenate([matrix.T @ w, [w @ w], (matrix @ earlier).T @ w])

    found = whitening.leading(product, 400, 8)
    _, s, right = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose([v for v, _ in found], s[:8], rtol=1e-12) and steps < 200
    assert all(abs(abs(right[k] @ v) - 1) < 1e-12 for k, (_, v) in enumerate(found))
