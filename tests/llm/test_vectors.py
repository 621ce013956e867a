"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from sentigrade.llm import vectors


def brute(rows, threshold=vectors.THRESHOLD):
    units = []
    for _, values, label in rows:
        usable = values and None not in values and len(values) == 16 and np.isfinite(values).all() and np.any(values) and label is not None
        unit = np.array(values, dtype=float) if usable else np.zeros(16)
        unit = unit / max(np.abs(unit).max(), 1e-300)
        units.append(unit / (np.linalg.norm(unit) or 1))
    units = np.array(units)
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    links = (units @ units.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    out, seen = [None] * len(rows), [False] * len(rows)
    for start in range(len(rows)):
        if seen[start]:
            continue
        group, queue = [], [start]
        seen[start] = True
        while queue:
            k = queue.pop()
            group.append(k)
            for j in np.flatnonzero(links[k]):
                if not seen[j]:
                    seen[j] = True
                    queue.append(j)
        smallest = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            key = rows[k][0]
            out[k] = (key, int(links[k].sum()), smallest, key is not None and key == smallest)
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    made = []
    for k in range(150):
        made.append((k, rng.normal(size=16).tolist(), int(rng.integers(2))))
    centre = rng.normal(size=16)
    for k in range(120):  # a hot group around the threshold
        made.append((1000 + k, (centre + rng.normal(size=16) * rng.uniform(0.05, 0.4)).tolist(), 1))
    step = rng.normal(size=16)
    for k in range(40):  # a chain
        step = step / np.linalg.norm(step) + rng.normal(size=16) * 0.07
        made.append((2000 + k, (step * 10.0 ** rng.integers(-3, 4)).tolist(), 0))
    one = made[3][1]
    made += [(3000, one, made[3][2]), (3000, one, made[3][2]), (None, one, made[3][2]), (3001, one, None), (None, None, 1)]
    made += [(3002, [0.0] * 16, 1), (3003, [None, *one[1:]], 1), (3004, [float("nan"), *one[1:]], 1), (3005, [float("inf"), *one[1:]], 1)]
    made += [(3006, one[:5], 1), (3007, [], 1), (3008, [1e200] * 16, 0), (3009, [2e200] * 16, 0), (3010, [1e-200] * 16, 0)]
    return made


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 30, "block_rows": 25}, {"cell_rows": 60, "block_rows": 1000}])
def test_same_links_as_all_pairs(spark, rows, sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", vectors.F.lit("x"))
    got = vectors.near_duplicates(df.repartition(3), **sizes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 10, "block_rows": 8}])
def test_every_length_is_compared(spark, sizes):
    rng = np.random.default_rng(3)
    rows = []
    for width, count in ((16, 60), (5, 20), (3, 1)):
        for k in range(count):
            one = rng.normal(size=width).tolist()
            rows += [(1000 * width + 2 * k, one, k % 2), (1000 * width + 2 * k + 1, [2 * x for x in one], k % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df.repartition(3), **sizes).collect()}
    for key, values, label in rows:
        unit = np.array(values) / np.linalg.norm(values)
        others = [np.array(v) / np.linalg.norm(v) for k, v, own in rows if k != key and own == label and len(v) == len(values)]
        assert got[key].n_links == sum(float(unit @ o) >= vectors.THRESHOLD for o in others) > 0
        assert got[key].component_id <= key - key % 2


def test_empty_table(spark, rows):
    df = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>, label int").limit(0)
    assert vectors.near_duplicates(df).count() == 0


def test_balls_agree_with_products():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    tight = [centre + rng.normal(size=(30, 8)) * 0.01 for _ in range(2)]
    left, right = (t / np.linalg.norm(t, axis=1, keepdims=True) for t in tight)
    a, b, edges = vectors.linked(left, right, 0.9)
    assert (a == 30).all() and (b == 30).all() and len({i for i, _ in edges} | {30 + j for _, j in edges}) == 60
    a, b, edges = vectors.linked(left, -right, 0.9)
    assert not a.any() and not b.any() and not len(edges)
