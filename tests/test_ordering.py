"""First, top-n, numbering, ranks and quantiles: the plain and the split way give the same."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentigrade.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [
        ("hot" if i % 3 == 0 else f"g{i % 11}", i, None if i % 17 == 0 else rng.choice([1.5, 2.5, rng.random()]))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "g string, id bigint, v double").repartition(4)


@pytest.mark.parametrize("rows", [10, 10_000])
def test_average_rank(skewed, rows):
    ranked = ordering.average_rank(skewed, ["g"], "v", "r", ties="t", rows=rows).toPandas().sort_values("id")
    expected = ranked.groupby("g")["v"].rank()
    assert np.allclose(ranked["r"].astype(float), expected, equal_nan=True)
    sizes = ranked.groupby(["g", "v"])["id"].transform("count")
    known = ranked["v"].notna()
    assert (ranked.loc[known, "t"] == sizes[known]).all()
    assert ranked.loc[~known, "t"].isna().all()


def test_exact_quantiles(skewed):
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    found = ordering.exact_quantiles(skewed, ["g"], "v", shares).toPandas().set_index("g").sort_index()
    values = skewed.toPandas().groupby("g")["v"]
    for name, share in shares.items():
        assert np.allclose(found[name], values.quantile(share).sort_index())


@pytest.mark.parametrize("rows", [10, 10_000])
def test_top_per_group_keeps_the_exact_first_rows(skewed, rows):
    top = ordering.top_per_group(skewed, ["g"], [F.col("id").desc()], 7, ["id"], rows).toPandas()
    expected = skewed.toPandas().sort_values("id", ascending=False).groupby("g").head(7)
    assert set(top["id"]) == set(expected["id"])


def test_number_by_hash_is_a_permutation_and_repeats(skewed):
    first = ordering.number_by_hash(skewed, "g", "id", 3, "n", digits=1).toPandas()
    again = ordering.number_by_hash(skewed.repartition(7), "g", "id", 3, "n", digits=2).toPandas()
    for _, group in first.groupby("g"):
        assert sorted(group["n"]) == list(range(len(group)))
    merged = first.merge(again, on="id")
    assert (merged["n_x"] == merged["n_y"]).all()


def test_keep_first_with_null_keys(spark):
    rows = [(1, "x", "b", 2), (1, "x", "a", 9), (1, "x", "a", 3), (None, "x", "a", 1), (None, "x", "a", 0)]
    df = spark.createDataFrame(rows, "app int, t string, f string, id int")
    kept = ordering.keep_first(df, ["app", "t"], ["f", "id"])
    assert {tuple(r) for r in kept.collect()} == {(1, "x", "a", 3), (None, "x", "a", 0)}


def test_ranks_sum_to_the_same_total(spark):
    df = spark.createDataFrame(pd.DataFrame({"b": [1, 1, 1, 2, 2, 2], "v": [3.0, 3.0, 1.0, 5.0, 5.0, 5.0]}))
    sums = ordering.average_rank(df, ["b"], "v", "r").groupBy("b").agg(F.sum("r").alias("s")).collect()
    assert {r.s for r in sums} == {6.0}
