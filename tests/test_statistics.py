"""Tests and correlations against textbook values and brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentigrade.operators import correlation, metrics, nonparametric, ordering, tails

MODELS = ["a", "b", "c", "d"]


def blocks(spark, effect, seed=1, n=25, ties=False):
    rng = np.random.default_rng(seed)
    data = rng.normal(50, 10, (n, 4)) + effect * np.arange(4)
    if ties:
        data = np.round(data / 10)
    table = pd.DataFrame(data, columns=MODELS)
    table.insert(0, "run_id", [f"{i // 5}_{i % 5}" for i in range(n)])
    return spark.createDataFrame(table), table[MODELS]


def brute_friedman(table):
    ranks = table.rank(axis=1).to_numpy()
    n, k = ranks.shape
    plain = 12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)
    ties = sum((c**3 - c) for row in table.to_numpy() for c in np.unique(row, return_counts=True)[1])
    return plain / (1 - ties / (n * k * (k * k - 1)))


def test_tails_match_tables():
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(9.487729, 4) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_tail(0.5, 3) == pytest.approx(0.918891, abs=1e-6)
    # t = 2.228139 is the two-sided 5% point at 10 degrees of freedom.
    r = 2.228139 / math.sqrt(10 + 2.228139**2)
    assert tails.correlation_p(r, 12) == pytest.approx(0.05, abs=1e-6)
    assert tails.studentized_range_tail(3.314, 3) == pytest.approx(0.05, abs=2e-4)
    assert tails.studentized_range_tail(3.633, 4) == pytest.approx(0.05, abs=2e-4)
    # n = 8: W = 3 has the two-sided exact probability 10 / 256.
    assert tails.signed_rank_exact_p(3, 8) == pytest.approx(10 / 256)


@pytest.mark.parametrize("effect,ties", [(0, False), (2, False), (8, False), (3, True)])
def test_friedman_and_average_ranks(spark, effect, ties):
    df, table = blocks(spark, effect, ties=ties)
    row = nonparametric.friedman(df, MODELS).first()
    chi2 = brute_friedman(table)
    assert row.chi2 == pytest.approx(chi2)
    assert row.kendall_w == pytest.approx(chi2 / (25 * 3))
    assert row.p_value == pytest.approx(tails.chi2_tail(chi2, 3))
    ranks = nonparametric.average_ranks(df, MODELS).toPandas().set_index("model")
    expected = table.rank(axis=1, ascending=False)
    assert np.allclose(ranks["average_rank"].loc[MODELS], expected.mean())
    assert np.allclose(ranks["rank_std"].loc[MODELS], expected.std())
    assert ranks["average_rank"].sum() == pytest.approx(10)


def test_friedman_is_null_when_values_are_missing(spark):
    df = spark.createDataFrame([("r", 1.0, None)], "run_id string, a double, b double")
    assert nonparametric.friedman(df, ["a", "b"]).first().chi2 is None


def test_nemenyi(spark):
    df, table = blocks(spark, 6)
    found = nonparametric.nemenyi(df, MODELS).toPandas().set_index(["model_1", "model_2"])
    ranks = table.rank(axis=1, ascending=False).mean()
    q = abs(ranks["a"] - ranks["d"]) / math.sqrt(4 * 5 / (6 * 25))
    assert found.loc[("a", "d"), "q"] == pytest.approx(q)
    p = tails.studentized_range_tail(q * math.sqrt(2), 4)
    assert found.loc[("d", "a"), "p_value"] == pytest.approx(p)
    assert found.loc[("b", "b"), "p_value"] == 1.0


@pytest.mark.parametrize("ties,rows", [(False, None), (True, None), (True, 5)])
def test_wilcoxon(spark, ties, rows):
    df, table = blocks(spark, 3, seed=4, ties=ties)
    found = nonparametric.wilcoxon_pairs(df, MODELS, rows=rows).toPandas().set_index(["model_1", "model_2"])
    for a, b in itertools.combinations(MODELS, 2):
        d = table[a] - table[b]
        nonzero = d[d != 0]
        ranks = nonzero.abs().rank()
        plus, minus = ranks[nonzero > 0].sum(), ranks[nonzero < 0].sum()
        m = len(nonzero)
        assert plus + minus == pytest.approx(m * (m + 1) / 2)
        row = found.loc[(a, b)]
        assert row["statistic"] == pytest.approx(min(plus, minus))
        assert row["effect_size_r"] == pytest.approx(1 - 2 * min(plus, minus) / (25 * 26 / 2))
        pooled = math.sqrt((table[a].var() + table[b].var()) / 2)
        assert row["cohens_d"] == pytest.approx((table[a].mean() - table[b].mean()) / pooled)
        same = sum(c**3 - c for c in ranks.value_counts())
        assert row["p_value"] == pytest.approx(tails.signed_rank_p(min(plus, minus), m, same, 25 - m, 50))


def test_mcen(spark):
    runs = [(10, 10, 0, 0), (0, 0, 0, 0), (5, 5, 5, 5), (7, 0, 0, 0), (20, 12, 3, 6)]
    df = spark.createDataFrame(runs, "tp long, tn long, fp long, fn long")
    found = [r[0] for r in df.select(metrics.mcen(*(F.col(c) for c in ("tp", "tn", "fp", "fn")))).collect()]

    def brute(tp, tn, fp, fn):
        n = tp + tn + fp + fn
        total = 0.0
        for hit in (tp, tn):
            mass = hit + fp + fn
            cells = [c / mass for c in (fp, fn) if c]
            total += mass / (2 * n) * -sum(p * math.log2(p) for p in cells) if cells else 0
        return min(max(total, 0), 1)

    assert found == pytest.approx([0, 0, brute(5, 5, 5, 5), 0, brute(20, 12, 3, 6)])


@pytest.fixture(scope="module")
def games():
    rng = np.random.default_rng(3)
    n = 60
    x = rng.normal(size=n).round(1)
    table = pd.DataFrame({"x": x, "z": (x + rng.normal(size=n)).round(1), "flag": (x > 0).astype(float)})
    table["y"] = (x + table["z"] + rng.normal(size=n)).round(1)
    table.loc[[3, 9], "y"] = np.nan
    table.loc[[5], "z"] = np.nan
    return table


def as_spark(spark, table):
    return spark.createDataFrame(table.astype(object).where(table.notna(), None), "x double, z double, flag double, y double")


def brute_partial(x, y, z):
    kept = x.notna() & y.notna() & z.notna()
    rx, ry, rz = (s[kept].rank().to_numpy() for s in (x, y, z))
    design = np.column_stack([np.ones_like(rz), rz])
    left, right = (r - design @ np.linalg.lstsq(design, r, rcond=None)[0] for r in (rx, ry))
    return np.corrcoef(left, right)[0, 1], int(kept.sum())


@pytest.mark.parametrize("rows", [None, 5])
def test_correlations(spark, games, rows):
    df = as_spark(spark, games)
    table = correlation.correlate_pairs(df, ["x", "flag"], ["y"], "z", ["y"], rows=rows)
    found = correlation.with_p_values(table).toPandas().set_index("feature")
    kept = games.dropna(subset=["y"])
    for c in ("x", "flag"):
        row = found.loc[c]
        assert row["n_samples"] == 58
        assert row["pearson_r"] == pytest.approx(np.corrcoef(kept[c], kept["y"])[0, 1])
        spearman = np.corrcoef(kept[c].rank(), kept["y"].rank())[0, 1]
        assert row["spearman_r"] == pytest.approx(spearman)
        assert row["spearman_p"] == pytest.approx(tails.correlation_p(spearman, 58))
        partial, n = brute_partial(games[c], games["y"], games["z"])
        assert (row["partial_r"], row["partial_n"]) == (pytest.approx(partial), n)
    alone = correlation.partial_spearman(df, "x", "y", "z", rows=rows).first()
    assert alone.partial_r == pytest.approx(brute_partial(games["x"], games["y"], games["z"])[0])


@pytest.mark.parametrize("rows", [None, 3])
def test_columns_are_ranked_once_for_pairs_over_the_same_rows(spark, monkeypatch, rows):
    rng = np.random.default_rng(5)
    table = pd.DataFrame({c: rng.integers(0, 9, 80).astype(float) for c in ("a", "b", "c", "p", "q", "r", "z")})
    table.loc[table.index % 7 == 0, "b"] = np.nan
    table.loc[table.index % 5 == 0, ["c", "q"]] = np.nan
    table.loc[3:6, "z"] = np.nan
    table["p"] = table["p"].where(table["b"].notna() | table["c"].notna(), 4.0)
    written, write = [], ordering.materialize

    def noted(df, label):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(ordering, "materialize", noted)
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), ", ".join(f"{c} double" for c in table))
    found = correlation.correlate_pairs(df, ["a", "b", "c"], ["p", "q", "r"], "z", ["p"], rows=rows).toPandas()
    found = found.set_index(["feature", "outcome"])
    assert len(found) == 9
    for (f, o), row in found.iterrows():
        kept = table.dropna(subset=[f, o])
        assert row["n_samples"] == len(kept)
        assert row["pearson_r"] == pytest.approx(np.corrcoef(kept[f], kept[o])[0, 1])
        assert row["spearman_r"] == pytest.approx(np.corrcoef(kept[f].rank(), kept[o].rank())[0, 1])
        if o == "p":
            partial, n = brute_partial(table[f], table[o], table["z"])
            assert (row["partial_r"], row["partial_n"]) == (pytest.approx(partial), n)
    # Rows: all (a p r), known b (b p r), known c or q (a c p q r), both (b q), and the first three with z (x p z).
    assert written == [(3 + 3 + 5 + 2 + 3 * 3) * 9]


def test_a_side_constant_only_where_both_are_known(spark):
    rows = [(float(i), 0.1 if i < 8 else 0.7, float(i % 3) if i < 8 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "x double, flat double, y double")
    found = {r.feature: r for r in correlation.correlate_pairs(df, ["x", "flat"], ["y"]).collect()}
    assert (found["flat"].n_samples, found["flat"].pearson_r, found["flat"].spearman_r) == (8, None, None)
    assert found["x"].pearson_r is not None


def test_small_and_constant_inputs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 6, "x double, y double, z double")
    assert correlation.partial_spearman(df.limit(3), "x", "y", "z").first().partial_r is None
    row = correlation.correlate_pairs(df, ["x"], ["y"]).first()
    assert (row.n_samples, row.pearson_r, row.spearman_r) == (6, None, None)
    assert correlation.correlate_pairs(df.limit(4), ["x"], ["y"]).count() == 0


def test_hypothesis_and_verdict(spark):
    rows = [(float(i), float(i) + (i % 2)) for i in range(12)] + [(3.0, None)]
    df = spark.createDataFrame(rows, "ea_predicted_positive_ratio double, pr_actual_positive_ratio double")
    row = correlation.validate_hypothesis(df).first()
    assert (row.n_samples, row.verdict, row.direction, row.effect_size) == (12, "SUPPORTED", "positive", "Large")
    assert correlation.validate_hypothesis(df.limit(4)).count() == 0


def test_policies(spark):
    rows = [(f"r{i}", 1.0, None if i > 3 else 2.0, None if i % 2 else 3.0) for i in range(10)]
    matrix = spark.createDataFrame(rows, "run_id string, a double, b double, c double")
    kept, models, excluded = metrics.apply_policy(matrix, ["a", "b", "c"])
    assert (models, excluded, kept.count()) == (["a", "c"], ["b"], 5)
    assert metrics.apply_policy(matrix, ["a", "b", "c"], "drop_runs")[0].count() == 2
    assert metrics.apply_policy(matrix, ["a", "b", "c"], "use_available")[0].count() == 10
