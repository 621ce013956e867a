"""Friedman, Nemenyi and Wilcoxon tests over a run matrix (one row per run, one column per model).

Ranks across the models of a run are computed inside the row, without a window or a shuffle; the
column count is the number of models compared, the row count is unbounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tails
from .ordering import average_rank


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def row_ranks(models: Sequence[str], descending: bool) -> Column:
    """Average-tie ranks of the model columns inside a row, in the order of ``models``."""
    values = F.array(*[_column(m) for m in models])

    def rank(x: Column) -> Column:
        ahead = F.filter(values, lambda y: y > x) if descending else F.filter(values, lambda y: y < x)
        equal = F.filter(values, lambda y: y == x)
        return F.size(ahead) + (F.size(equal) + 1) / F.lit(2.0)

    return F.transform(values, rank)


def _ranked(matrix: DataFrame, models: Sequence[str], descending: bool) -> DataFrame:
    return matrix.withColumn("_ranks", row_ranks(models, descending))


def average_ranks(matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean rank per model (1 is the highest value), its deviation, and the consistency of ranks.

    Rows with a missing value have no ranks and are left out, as the tests need complete runs.
    """
    complete = matrix.na.drop(subset=list(models))
    measures = [
        F.struct(
            F.lit(m).alias("model"),
            F.avg(F.get("_ranks", F.lit(i))).alias("average_rank"),
            F.stddev_samp(F.get("_ranks", F.lit(i))).alias("rank_std"),
            F.count(F.lit(1)).alias("n_runs"),
        )
        for i, m in enumerate(models)
    ]
    table = _ranked(complete, models, True).agg(F.array(*measures).alias("m"))
    table = table.withColumn("_max_std", F.array_max(F.transform("m", lambda s: s["rank_std"])))
    consistency = F.when(F.col("_max_std") == 0, "perfect").when(F.col("_max_std") < 0.5, "high").otherwise("varied")
    return (
        table.withColumn("consistency", consistency)
        .select(F.inline("m"), "consistency")
        .orderBy("average_rank", "model")
    )


def friedman(matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """Tie-corrected chi-squared, p and Kendall's W, as one row; NULL when values are missing."""
    k = len(models)
    values = F.array(*[_column(m) for m in models])
    tied = F.aggregate(
        F.transform(values, lambda x: F.size(F.filter(values, lambda y: y == x))),
        F.lit(0).cast("bigint"),
        lambda total, t: total + t * t - 1,
    )
    is_complete = F.forall(values, lambda x: x.isNotNull())
    rank_sums = [F.sum(F.get("_ranks", F.lit(i))) for i in range(k)]
    squares = sum((s * s for s in rank_sums[1:]), rank_sums[0] * rank_sums[0])
    table = (
        _ranked(matrix, models, False)
        .withColumn("_ties", tied)
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            squares.alias("_squares"),
            F.sum("_ties").alias("_ties"),
            F.every(is_complete).alias("_complete"),
        )
    )
    n = F.col("n_samples")
    plain = F.try_divide(F.lit(12.0), n * k * (k + 1)) * F.col("_squares") - 3 * n * (k + 1)
    correction = 1 - F.try_divide(F.col("_ties"), n * k * (k * k - 1))
    chi2 = F.when(F.col("_complete"), F.try_divide(plain, correction))
    table = table.select(chi2.alias("chi2"), "n_samples", F.lit(k).alias("n_models"))
    table = table.withColumn("kendall_w", F.try_divide(F.col("chi2"), n * (k - 1)))
    table = table.withColumn("p_value", tails.chi2_p(F.col("chi2"), F.lit(k - 1)))
    return table.withColumn("significant", F.col("p_value") < 0.05)


def nemenyi(matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """All model pairs with the rank difference in standard errors and its p."""
    k = len(models)
    ranks = average_ranks(matrix, models)
    listed = ranks.agg(
        F.array_sort(F.collect_list(F.struct("model", "average_rank"))).alias("m"),
        F.max("n_runs").alias("n"),
    )
    pairs = listed.select(F.explode("m").alias("a"), "m", "n").select("a", F.explode("m").alias("b"), "n")
    difference = F.abs(F.col("a.average_rank") - F.col("b.average_rank"))
    q = difference / F.sqrt(F.lit(k * (k + 1)) / (6 * F.col("n")))
    return (
        pairs.select(F.col("a.model").alias("model_1"), F.col("b.model").alias("model_2"), q.alias("q"))
        .withColumn("p_value", tails.nemenyi_p(F.col("q"), F.lit(k)))
        .withColumn("p_value", F.when(F.col("model_1") == F.col("model_2"), 1.0).otherwise(F.col("p_value")))
    )


def paired_differences(matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per run and unordered model pair: model_1, model_2, x, y, d."""
    pairs = [
        F.struct(
            F.lit(a).alias("model_1"), F.lit(b).alias("model_2"), _column(a).alias("x"), _column(b).alias("y")
        )
        for i, a in enumerate(models)
        for b in models[i + 1 :]
    ]
    return (
        matrix.select(F.inline(F.array(*pairs)))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .withColumn("d", F.col("x") - F.col("y"))
    )


def wilcoxon_pairs(
    matrix: DataFrame, models: Sequence[str], exact_limit: int = 50, rows: int | None = None
) -> DataFrame:
    """Signed-rank test of every model pair, with effect size and Cohen's d, by p.

    Differences of zero get no rank; the effect size counts them in n.
    """
    pair = ["model_1", "model_2"]
    paired = paired_differences(matrix, models)
    paired = paired.withColumn("_size", F.when(F.col("d") != 0, F.abs("d")))
    ranked = average_rank(paired, pair, "_size", "_rank", ties="_same", rows=rows)
    sums = ranked.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count("_size").alias("n_nonzero"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_rank"))), F.lit(0.0)).alias("_plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("_rank"))), F.lit(0.0)).alias("_minus"),
        F.coalesce(F.sum(F.col("_same") * F.col("_same") - 1), F.lit(0)).alias("tie_term"),
        F.avg("x").alias("_mean_x"),
        F.avg("y").alias("_mean_y"),
        F.var_samp("x").alias("_var_x"),
        F.var_samp("y").alias("_var_y"),
    )
    n = F.col("n_samples")
    table = sums.withColumn("statistic", F.least("_plus", "_minus"))
    mean_diff = F.col("_mean_x") - F.col("_mean_y")
    pooled = F.sqrt((F.col("_var_x") + F.col("_var_y")) / 2)
    return (
        table.select(
            *pair,
            "n_samples",
            "n_nonzero",
            "tie_term",
            "statistic",
            (1 - 2 * F.col("statistic") / (n * (n + 1) / 2)).alias("effect_size_r"),
            F.coalesce(F.try_divide(mean_diff, pooled), F.lit(0.0)).alias("cohens_d"),
            mean_diff.alias("mean_diff"),
        )
        .withColumn(
            "p_value",
            tails.wilcoxon_p(
                F.col("statistic"),
                F.col("n_nonzero"),
                F.col("tie_term"),
                F.col("n_samples") - F.col("n_nonzero"),
                exact_limit,
            ),
        )
        .withColumn("significant", F.col("p_value") < 0.05)
        .orderBy("p_value", *pair)
    )
