"""Classification and regression metrics, run summaries and the run matrix."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_METRICS = ("f1_score", "accuracy", "precision", "recall")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """All label pairs with their counts, zeros included: one conditional count per cell."""
    cells = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(p).alias("predicted"),
            F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias("n"),
        )
        for a in labels
        for p in labels
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def class_report(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    classes = [
        F.struct(
            F.lit(str(label)).alias("class"),
            F.count_if((F.col(actual) == label) & (F.col(predicted) == label)).alias("tp"),
            F.count_if(F.col(predicted) == label).alias("called"),
            F.count_if(F.col(actual) == label).alias("support"),
        )
        for label in labels
    ]
    table = df.agg(F.array(*classes).alias("c")).select(F.inline("c"))
    table = table.withColumn("precision", _ratio(F.col("tp"), F.col("called")))
    table = table.withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    table = table.withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    columns = ["class", "precision", "recall", "f1", "support"]
    scores = ("precision", "recall", "f1")
    weighted = [
        _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores
    ]
    support = F.sum("support").alias("support")
    macro = table.agg(*[F.avg(c).alias(c) for c in scores], support)
    weights = table.agg(*weighted, support)
    return (
        table.select(*columns)
        .unionByName(macro.withColumn("class", F.lit("macro avg")).select(*columns))
        .unionByName(weights.withColumn("class", F.lit("weighted avg")).select(*columns))
    )


def binary_scores(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, macro precision, recall and F1 and weighted F1 from the four counts."""
    precision_1, recall_1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    precision_0, recall_0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1 = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_0 = _ratio(2 * tn, 2 * tn + fp + fn)
    n = tp + tn + fp + fn
    return {
        "accuracy": _ratio(tp + tn, n),
        "precision": (precision_0 + precision_1) / 2,
        "recall": (recall_0 + recall_1) / 2,
        "f1_score": (f1_0 + f1_1) / 2,
        "weighted_f1": _ratio(f1_1 * (tp + fn) + f1_0 * (tn + fp), n),
    }


def _binary_counts(actual: str, predicted: str) -> list[Column]:
    y, p = F.col(actual), F.col(predicted)
    return [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    ]


def binary_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by).agg(*_binary_counts(actual, predicted))
    scores = binary_scores(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    names = ("accuracy", "precision", "recall", "f1_score")
    return counts.select(*by, "tp", "tn", "fp", "fn", *[scores[c].alias(c) for c in names])


def accuracy_by_game(scored: DataFrame, game: str = "game_name") -> DataFrame:
    """Accuracy, weighted F1 and ratio error per game and pooled (game NULL).

    The pooled row's ratio error is the mean over games.  Counts per game come first, the rollup
    works on them.
    """
    counts = scored.groupBy(game).agg(*_binary_counts("positive", "predicted"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    per_game = counts.withColumn("_error", F.abs(_ratio(tp + fp, n) - _ratio(tp + fn, n)))
    rolled = per_game.rollup(game).agg(
        F.grouping(game).cast("int").alias("is_pooled"),
        *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")],
        F.avg("_error").alias("absolute_error"),
    )
    scores = binary_scores(tp, tn, fp, fn)
    return rolled.select(
        game,
        "is_pooled",
        n.alias("n_reviews"),
        _ratio(tp + fp, n).alias("predicted_positive_ratio"),
        _ratio(tp + fn, n).alias("actual_positive_ratio"),
        "absolute_error",
        scores["accuracy"].alias("accuracy"),
        scores["weighted_f1"].alias("weighted_f1"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, log_r2: bool = True) -> DataFrame:
    """MAE and RMSE in units, R2 on log1p values (the scale the model was fitted on)."""
    y, p = F.col(actual), F.col(predicted)
    ly, lp = (F.log1p(y), F.log1p(p)) if log_r2 else (y, p)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (1 - F.try_divide(F.sum((ly - lp) * (ly - lp)), F.var_pop(ly) * F.count(ly))).alias("r2"),
    )


def mcen(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Modified confusion entropy of a two-class confusion matrix, between 0 and 1.

    Delgado and Nunez-Gonzalez (2019): the off-diagonal cells as shares of each class's row and
    column total, entropies in base 2, classes weighted by their totals.
    """
    total = tp + tn + fp + fn

    def entropy(cell: Column, mass: Column) -> Column:
        p = F.try_divide(cell, mass)
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    value = F.lit(0.0)
    for hit in (tp, tn):
        mass = hit + fp + fn
        weight = _ratio(mass, 2 * total)
        value = value + weight * (entropy(fp, mass) + entropy(fn, mass))
    return F.when(total.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def z_score(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf((1 + confidence) / 2)


def margin_of_error(std: Column, n: Column, confidence: float = 0.95) -> Column:
    return F.when(n > 0, F.lit(z_score(confidence)) * std / F.sqrt(n)).otherwise(0.0)


def model_summary(results: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean, sample deviation and margin of error per model, best first; MCEN where counts were stored.

    The window numbers one row per model.
    """
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    own = F.when(tp.isNotNull(), mcen(tp, tn, fp, fn))
    measures = [F.count(F.lit(1)).alias("n_runs")]
    for metric in RUN_METRICS:
        measures.append(F.avg(metric).alias(f"{metric}_mean"))
        measures.append(F.stddev_samp(metric).alias(f"{metric}_std"))
    measures += [
        F.avg("train_time").alias("train_time_mean"),
        F.avg("inference_time_ms").alias("inference_time_ms_mean"),
        F.avg("_mcen").alias("mcen_mean"),
        F.stddev_pop("_mcen").alias("mcen_std"),
        *[F.bround(F.avg(F.when(tp.isNotNull(), F.col(c))), 0).alias(f"_{c}") for c in ("tp", "tn", "fp", "fn")],
    ]
    table = results.withColumn("_mcen", own).groupBy("model", "type").agg(*measures)
    for metric in RUN_METRICS:
        moe = margin_of_error(F.col(f"{metric}_std"), F.col("n_runs"), confidence)
        table = table.withColumn(f"{metric}_moe", moe)
    pooled = mcen(*(F.col(f"_{c}") for c in ("tp", "tn", "fp", "fn")))
    return (
        table.withColumn("mcen_aggregated", F.when(F.col("_tp").isNotNull(), pooled))
        .withColumn("confidence_level", F.lit(confidence))
        .withColumn("z_score", F.lit(z_score(confidence)))
        .drop("_tp", "_tn", "_fp", "_fn")
        .withColumn("position", F.row_number().over(Window.orderBy(F.col("f1_score_mean").desc(), "model")))
        .orderBy("position")
    )


def checkpoint_summary(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("model", "type")
        .agg(
            F.avg("f1_score").alias("avg_f1"),
            F.stddev_samp("f1_score").alias("std_f1"),
            F.min("f1_score").alias("min_f1"),
            F.max("f1_score").alias("max_f1"),
            *[F.avg(c).alias(f"avg_{c}") for c in ("accuracy", "precision", "recall", "train_time")],
        )
        .orderBy(F.col("avg_f1").desc(), "model")
    )


def progress(results: DataFrame, models: Sequence[str], runs_per_model: int) -> DataFrame:
    """Completed runs per listed model; models without runs are listed too."""
    expected = [
        F.struct(
            F.lit(m).alias("model"), F.count_if(F.col("model") == m).alias("completed")
        )
        for m in models
    ]
    table = results.agg(F.array(*expected).alias("m")).select(F.inline("m"))
    pct = F.least(F.lit(100.0), F.coalesce(F.try_divide(F.col("completed") * 100, F.lit(runs_per_model)), F.lit(0.0)))
    return table.select(
        "model",
        "completed",
        F.lit(runs_per_model).alias("expected"),
        pct.alias("pct"),
        (F.col("completed") >= runs_per_model).alias("is_done"),
    )


def run_matrix(results: DataFrame, models: Sequence[str], value: str = "f1_score") -> DataFrame:
    """One row per run (seed_fold), one column per model: the first stored non-NULL value."""
    run = F.concat_ws("_", "seed", "fold").alias("run_id")
    cells = [
        F.min_by(
            F.when(F.col("model") == m, F.col(value)),
            F.when((F.col("model") == m) & F.col(value).isNotNull(), F.col("timestamp")),
        ).alias(m)
        for m in models
    ]
    return results.groupBy(run).agg(*cells)


def apply_policy(
    matrix: DataFrame, models: Sequence[str], policy: str = "drop_incomplete_models", minimum: float = 0.5
) -> tuple[DataFrame, list[str], list[str]]:
    """Run matrix without incomplete parts: (matrix, kept models, excluded models).

    Completion is one aggregate row; models below ``minimum`` are left out, then incomplete runs
    are dropped.  ``drop_runs`` keeps all models, ``use_available`` keeps runs with at least half
    of the models.
    """
    models = list(models)
    if policy == "use_available":
        return matrix.na.drop(thresh=max(1, len(models) // 2), subset=models), models, []
    kept, excluded = models, []
    if policy == "drop_incomplete_models":
        row = matrix.agg(
            F.count(F.lit(1)).alias("_runs"), *[F.count(F.col(f"`{m}`")).alias(m) for m in models]
        ).first()
        complete = [m for m in models if row["_runs"] and row[m] / row["_runs"] >= minimum]
        excluded = [m for m in models if m not in complete]
        kept = complete or models
    return matrix.select("run_id", *kept).na.drop(subset=kept), kept, excluded


def describe_matrix(long: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per group."""
    from .ordering import exact_quantiles

    quartiles = exact_quantiles(long, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rest = long.groupBy(group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )
    return rest.join(quartiles, group)
