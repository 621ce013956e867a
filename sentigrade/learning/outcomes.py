"""Feature matrix of games, and prediction of success tier and revenue with held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists, values
from ..functions.text import split_field
from ..operators.metrics import regression_metrics
from ..operators.ordering import number_by_hash
from ..operators.relational import join_games
from ..session import scratch_folder, store
from . import held_out, left_out

# The feature columns of each set.
STEAM_FEATURES = (
    "ea_predicted_positive_ratio",
    "ea_avg_positive_probability",
    "ea_actual_positive_ratio",
    "log_ea_review_count",
    "sentiment_confidence",
    "ea_sentiment_std",
    "ea_mean_review_length",
    "ea_long_review_ratio",
    "ea_neg_pos_length_ratio",
)
YOUTUBE_FEATURES = (
    "yt_predicted_positive_ratio",
    "yt_avg_positive_probability",
    "yt_sentiment_std",
    "yt_mean_comment_length",
    "yt_long_comment_ratio",
    "log_yt_comment_count",
    "yt_sentiment_confidence",
)
METADATA_FEATURES = (
    "release_year",
    "years_since_release",
    "release_month",
    "release_is_q4",
    "ea_cohort_post_2020",
    "price_usd",
    "price_tier",
    "num_genres",
    "num_categories",
    "num_platforms",
    "num_languages",
    "num_top_tags",
    "num_publishers",
    "num_developers",
    "is_self_published",
    "ea_to_pr_review_ratio",
    "required_age",
    "supports_windows",
    "supports_mac",
    "supports_linux",
    *lists.CATEGORY_MARKS,
    *(lists.flag_name("genre_", g) for g in lists.GENRES),
    *(lists.flag_name("tag_", t) for t in lists.TAGS),
)
FEATURE_SETS = {
    "steam": STEAM_FEATURES,
    "youtube": YOUTUBE_FEATURES,
    "metadata": METADATA_FEATURES,
    "steam+metadata": STEAM_FEATURES + METADATA_FEATURES,
    "combined": STEAM_FEATURES + YOUTUBE_FEATURES + METADATA_FEATURES,
}

SMALLEST_SAMPLE = 5


def feature_columns(feature_set: str, df: DataFrame) -> list[str]:
    """Columns of the set that the table has."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {tuple(FEATURE_SETS)}, got {feature_set}")
    return [c for c in FEATURE_SETS[feature_set] if c in df.columns]


def _split_at(separator: str):
    return lambda c: split_field(c, separator)


# What features are made of: a working column, the columns it may come from (the first that the table
# has), and how it is read.
_INPUTS = {
    "_released": (("steam_release_date", "release_date"), lambda c: values.parse_date(c.cast("string"))),
    "_price": (("steam_current_price_usd", "current_price_usd"), values.to_numeric),
    "_age": (("required_age",), values.to_numeric),
    "_genres": (("genres",), _split_at("|")),
    "_categories": (("categories",), _split_at("|")),
    "_platforms": (("platforms",), _split_at("|")),
    "_tags": (("steamspy_tags",), _split_at("|")),
    "_languages": (("steamspy_languages",), _split_at(",")),
    "_developers": (("developer",), _split_at(",")),
    "_publishers": (("publisher",), _split_at(",")),
    "_later": (("pr_review_count",), lambda c: c),
    "_early": (("ea_review_count",), lambda c: c),
}

# Which features follow from which working columns; ``year`` is the year ages are counted to.
_METADATA_RULES = (
    (("_released",), lambda year: values.release_features("_released", year)),
    (("_price",), lambda year: {"price_usd": F.col("_price"), "price_tier": values.price_tier("_price")}),
    (("_age",), lambda year: {"required_age": F.coalesce("_age", F.lit(0.0))}),
    (("_genres",), lambda year: lists.flag_columns("_genres", lists.GENRES, "genre_") | lists.list_sizes(num_genres="_genres")),
    (("_categories",), lambda year: {
        name: lists.any_contains("_categories", marks).cast("int") for name, marks in lists.CATEGORY_MARKS.items()
    } | lists.list_sizes(num_categories="_categories")),
    (("_platforms",), lambda year: lists.flag_columns("_platforms", lists.PLATFORMS, "supports_") | lists.list_sizes(num_platforms="_platforms")),
    (("_tags",), lambda year: lists.flag_columns("_tags", lists.TAGS, "tag_") | lists.list_sizes(num_top_tags="_tags")),
    (("_languages",), lambda year: lists.list_sizes(num_languages="_languages")),
    (("_developers", "_publishers"), lambda year: lists.list_sizes(num_developers="_developers", num_publishers="_publishers")
        | {"is_self_published": lists.same_set("_developers", "_publishers").cast("int")}),
    (("_later", "_early"), lambda year: {"ea_to_pr_review_ratio": values.guarded_ratio("_later", "_early")}),
)


def metadata_features(df: DataFrame, as_of_year: int) -> DataFrame:
    """Calendar, price, list and flag features of the metadata columns the table has."""
    inputs = {}
    for name, (sources, read) in _INPUTS.items():
        for source in [c for c in sources if c in df.columns][:1]:
            inputs[name] = read(F.col(source))
    made: dict = {}
    for needed, rule in _METADATA_RULES:
        if inputs.keys() >= set(needed):
            made |= rule(as_of_year)
    return df.withColumns(inputs).withColumns(made).drop(*inputs)


_SENTIMENT_RULES = {
    "sentiment_confidence": ("ea_predicted_positive_ratio", values.confidence),
    "log_ea_review_count": ("ea_review_count", F.log1p),
    "yt_sentiment_confidence": ("yt_predicted_positive_ratio", values.confidence),
    "log_yt_comment_count": ("yt_comment_count", F.log1p),
}


def sentiment_features(df: DataFrame) -> DataFrame:
    """Confidence and log volume of the sentiment columns the table has."""
    return df.withColumns(
        {name: make(source) for name, (source, make) in _SENTIMENT_RULES.items() if source in df.columns}
    )


def feature_matrix(
    game_sentiment: DataFrame,
    metrics: DataFrame,
    as_of_year: int,
    video: DataFrame | None = None,
    metadata: DataFrame | None = None,
) -> DataFrame:
    """One row per game with sentiment and outcomes; comment and metadata columns where known.

    All joins are on unique keys, so nothing is multiplied or skewed; which side is broadcast is
    left to the measured sizes.
    """
    merged = join_games(game_sentiment, metrics, "_m")
    if video is not None:
        merged = join_games(merged, video, "_yt", "left")
    if metadata is not None:
        merged = join_games(merged, metadata, "_meta", "left")
    return sentiment_features(metadata_features(merged, as_of_year))


def _all_known(values_column: str):
    return ~F.exists(values_column, lambda v: v.isNull() | F.isnan(v))


def _features(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")


def complete_rows(df: DataFrame, key: str, target: str, features: Sequence[str]) -> DataFrame:
    """key, target and the features as one array ``_x``, without rows that miss any of them.

    One array instead of a column per feature: the optimizer derives a constraint for every way
    of renaming the columns of a filter, which doubles with each column.
    """
    rows = df.select(key, target, _features(features))
    return rows.where(F.col(target).isNotNull() & _all_known("_x"))


# --- Revenue: exact leave-one-out ridge regression from one set of sums -------------------------


@dataclass(frozen=True)
class RidgeSums:
    """Row count, centre, and the sums of centred x, xx', xy and of y."""

    n: int
    centre: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    y: float

    def solve(self, alpha: float):
        """(means, scales, weights, intercept) of a ridge fit on population-scaled columns."""
        return _solve(self.n, self.x[None], self.xx[None], self.xy[None], np.array([self.y]), self.centre, alpha)


def _solve(n, x, xx, xy, y, centre, alpha):
    """Ridge fits for a batch of sums; a column without spread keeps scale 1."""
    mean = x / n
    cov = xx / n - mean[:, :, None] * mean[:, None, :]
    variance = np.einsum("bii->bi", cov).copy()
    floor = 1e-18 * (mean + centre) ** 2 + 1e-300
    scale = np.where(variance > floor, np.sqrt(np.maximum(variance, 0)), 1.0)
    cov = cov / (scale[:, :, None] * scale[:, None, :])
    moment = (xy / n - mean * (y / n)[:, None]) / scale
    size = cov.shape[1]
    weights = np.linalg.solve(cov + (alpha / n) * np.eye(size)[None], moment[:, :, None])[:, :, 0]
    return mean, scale, weights, y / n


def _matrix(batch: pd.DataFrame, centre: np.ndarray) -> np.ndarray:
    return np.stack(batch["_x"].to_numpy()).astype(float) - centre


def ridge_sums(rows: DataFrame, d: int, target: str) -> RidgeSums:
    """Centred sums of ``_x`` in two passes; every task reduces its batches to one small array.

    What reaches the driver is 2 + 2d + d*d numbers for d features, whatever the row count.
    """
    means = rows.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(d)]).alias("m")
    ).first()
    if not means["n"]:
        return RidgeSums(0, np.zeros(d), np.zeros(d), np.zeros((d, d)), np.zeros(d), 0.0)
    centre = np.array(means["m"])

    def reduce(batches):
        total = np.zeros(2 + 2 * d + d * d)
        for batch in batches:
            if len(batch):
                x, y = _matrix(batch, centre), batch[target].to_numpy(float)
                total += np.concatenate(([len(y), y.sum()], x.sum(0), x.T @ y, (x.T @ x).ravel()))
        yield pd.DataFrame({"sums": [total.tolist()]})

    partial = rows.select("_x", target).mapInPandas(reduce, "sums array<double>")
    added = partial.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    total = np.array([r["s"] for r in added.orderBy("pos").collect()])
    return RidgeSums(
        int(total[0]), centre, total[2 : 2 + d], total[2 + 2 * d :].reshape(d, d), total[2 + d : 2 + 2 * d], total[1]
    )


def loo_ridge(
    df: DataFrame, key: str, features: Sequence[str], target: str, alpha: float = 1.0
) -> DataFrame | None:
    """Leave-one-out predictions of log1p(target): key, actual, predicted, absolute_error.

    Removing a row from the sums and solving gives exactly the model refitted without it, scaler
    included, so n refits cost one pass for the sums and one for the rows.  Predictions are
    returned in units, never below 0.  None for fewer than five rows.
    """
    complete = complete_rows(df, key, target, features).where(F.col(target) > 0)
    rows = complete.withColumn("_y", F.log1p(target))
    sums = ridge_sums(rows, len(features), "_y")
    if sums.n < SMALLEST_SAMPLE:
        return None
    n = sums.n - 1
    kind = dict(complete.dtypes)[key]

    def predict(batches):
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                x = _matrix(part, sums.centre)
                y = part["_y"].to_numpy(float)
                mean, scale, weights, level = _solve(
                    n,
                    sums.x - x,
                    sums.xx - x[:, :, None] * x[:, None, :],
                    sums.xy - x * y[:, None],
                    sums.y - y,
                    sums.centre,
                    alpha,
                )
                fitted = ((x - mean) / scale * weights).sum(1) + level
                yield pd.DataFrame({key: part[key], "_y": y, "_fit": fitted})

    predicted = rows.select(key, "_x", "_y").mapInPandas(predict, f"{key} {kind}, _y double, _fit double")
    actual, estimate = F.expm1("_y"), F.greatest(F.expm1("_fit"), F.lit(0.0))
    return predicted.select(
        key,
        actual.alias("actual"),
        estimate.alias("predicted"),
        F.abs(actual - estimate).alias("absolute_error"),
        F.col("_y").alias("actual_log"),
        F.col("_fit").alias("predicted_log"),
    )


def revenue_scores(predictions: DataFrame) -> DataFrame:
    """MAE and RMSE in units; R2 in log space, of the unclamped predictions."""
    units = regression_metrics(predictions, "actual", "predicted", log_r2=False).drop("r2")
    logs = regression_metrics(predictions, "actual_log", "predicted_log", log_r2=False)
    return units.select("*", logs.select("r2").scalar().alias("r2"))


# --- Tier: logistic regression with held-out rows or folds ----------------------------------------------


#: Features times rows of a training matrix that is sent to every task: 64 MB of doubles.
MOST_CELLS = 8_000_000
MOST_LEFT_OUT = 50_000


def _tier_model(train: DataFrame, n: int, classes: int, inverse_penalty: float = 1.0):
    """Logistic model of ``_v`` on ``_label``, penalty 1/C on the summed loss.

    The scaler divides by the sample deviation; the factor (n - 1) / n in the penalty makes the
    fit equal to one on population-scaled features.
    """
    penalty = (n - 1) / (inverse_penalty * n * n)
    stages = [
        StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="features",
            labelCol="_label",
            family="binomial" if classes == 2 else "multinomial",
            regParam=penalty,
            standardization=False,
            maxIter=1000,
            tol=1e-4,
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def _with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector("_x")).drop("_x")


def _present_tiers(df: DataFrame, tier: str) -> dict[str, int]:
    """Rows per tier that occurs, in tier order."""
    counts = {r[tier]: r["count"] for r in df.groupBy(tier).count().collect()}
    return {t: counts[t] for t in values.TIERS if counts.get(t)}


def _with_label(df: DataFrame, tier: str, present: Sequence[str]):
    table = F.array(*[F.lit(t) for t in present])
    return df.withColumn("_label", (F.array_position(table, F.col(tier)) - 1).cast("double"))


def loo_classify(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    tier: str = "success_tier",
    folds: int | None = None,
    seed: int = 0,
    parallelism: int = 4,
    any_size: bool = False,
) -> DataFrame | None:
    """Held-out tier predictions: key, actual_tier, predicted_tier, correct.

    Every row is predicted by a model that has not seen it: one model per row, or one per hashed fold
    where ``folds`` is a number.  Up to ``MOST_CELLS`` features times rows the training matrix is sent to the
    executors, which refit the model there; beyond, the folds are fitted by Spark ML over the whole cluster.
    More than ``MOST_LEFT_OUT`` rows, or a larger matrix, need a number of folds, as n refits of n rows
    cost their square, or ``any_size``: then the model of all rows gives those of the rows, and only rows whose
    class it leaves open are refitted (``left_out``).  A training part with a single tier predicts that tier.  None for fewer than five rows.
    """
    complete = complete_rows(df, key, tier, features)
    n = complete.count()
    if n < SMALLEST_SAMPLE:
        return None
    if n * max(1, len(features)) <= MOST_CELLS and (folds is not None or n <= MOST_LEFT_OUT):
        predicted = _refit_tiers(complete, key, tier, n if folds is None else folds, seed)
    elif folds is None and any_size:
        predicted = _tiers_left_out(complete, key, tier, len(features), n, seed)
    elif folds is None:
        raise ValueError(f"{n} rows are too many to leave out one at a time; give a number of folds")
    else:
        predicted = _fold_tiers(complete, key, tier, folds, seed, parallelism)
    return predicted.select(
        key,
        F.col(tier).alias("actual_tier"),
        "predicted_tier",
        (F.col(tier) == F.col("predicted_tier")).alias("correct"),
    )


def _dealt(complete: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    numbered = number_by_hash(complete.withColumn("_all", F.lit(0)), "_all", key, seed, "_number")
    return numbered.withColumn("_fold", F.col("_number") % folds).drop("_number", "_all")


def _refit_tiers(complete: DataFrame, key: str, tier: str, folds: int, seed: int) -> DataFrame:
    """key, tier and predicted_tier of all rows by refits on the executors."""
    spark = complete.sparkSession
    rows = store(_dealt(complete, key, folds, seed).where(F.col(tier).isin(*values.TIERS)), "dealt")
    known = rows().select("_fold", tier, "_x").toPandas()
    names = np.array(values.TIERS)
    label = pd.Categorical(known[tier], categories=list(names)).codes
    matrix = np.stack(known["_x"].to_list()).astype(float) if len(known) else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast((matrix, label, known["_fold"].to_numpy()))
    kind = dict(complete.dtypes)[key]

    def predict(batches):
        parts = list(batches)  # no more rows than the matrix that was sent
        if not parts:
            return
        own = pd.concat(parts)
        x, y, fold = sent.value
        for number, model in held_out.refits(x, y, fold, np.unique(own["_fold"])):
            part = own[own["_fold"] == number]
            found = names[model.predict(np.stack(part["_x"].to_list()).astype(float))]
            yield pd.DataFrame({key: part[key], tier: part[tier], "predicted_tier": found})

    tasks = min(folds, spark.sparkContext.defaultParallelism)
    dealt = rows().repartition(tasks, "_fold")
    return dealt.mapInPandas(predict, f"{key} {kind}, {tier} string, predicted_tier string")


def _tiers_left_out(complete: DataFrame, key: str, tier: str, d: int, n: int, seed: int) -> DataFrame:
    """key, tier and predicted_tier of all rows, each by the model of all others, for any number of rows."""
    names = F.array(*[F.lit(t) for t in values.TIERS])
    known = complete.where(F.col(tier).isin(*values.TIERS))
    numbered = number_by_hash(known.withColumn("_all", F.lit(0)), "_all", key, seed, "_number").drop("_all")
    numbered = numbered.withColumn("_y", F.array_position(names, F.col(tier)).cast("int") - 1)
    opened = store(numbered.withColumn("_number", F.col("_number").cast("long")), "numbered")
    found = left_out.predictions(opened().select("_x", "_y", "_number"), d)
    predicted = F.get(names, F.col("_class")).alias("predicted_tier")
    return opened().select(key, tier, "_number").join(found, "_number").select(key, tier, predicted)


def _fold_tiers(complete: DataFrame, key: str, tier: str, k: int, seed: int, parallelism: int) -> DataFrame:
    """key, tier and predicted_tier of all rows by one Spark ML fit for each fold, written as they end."""
    opened = store(_dealt(complete, key, k, seed), "dealt")
    counts: dict[int, dict[str, int]] = {f: {} for f in range(k)}
    for r in opened().groupBy("_fold", tier).count().collect():
        counts[r["_fold"]][r[tier]] = r["count"]
    totals = {t: sum(c.get(t, 0) for c in counts.values()) for t in values.TIERS}
    spark, path = complete.sparkSession, scratch_folder(complete.sparkSession, "predicted")

    def predict(fold: int) -> None:
        rows = _with_vector(opened())
        held, train = rows.where(F.col("_fold") == fold), rows.where(F.col("_fold") != fold)
        rest = {t: totals[t] - counts[fold].get(t, 0) for t in values.TIERS}
        present = [t for t, c in rest.items() if c > 0]
        if len(present) == 1:
            found = held.select(key, tier, F.lit(present[0]).alias("predicted_tier"))
        else:
            model = _tier_model(_with_label(train, tier, present), sum(rest.values()), len(present))
            names = F.array(*[F.lit(t) for t in present])
            scored = model.transform(held)
            found = scored.select(key, tier, F.get(names, F.col("prediction").cast("int")).alias("predicted_tier"))
        found.write.parquet(f"{path}/fold={fold}")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(predict, range(k)))
    return spark.read.parquet(path).select(key, tier, "predicted_tier")


# --- New games and ablation ---------------------------------------------------------------------


def predict_new(
    train: DataFrame,
    new: DataFrame,
    key: str = "game_name",
    features: Sequence[str] = STEAM_FEATURES,
    tier: str = "success_tier",
    revenue: str = "estimated_revenue_usd",
    alpha: float = 1.0,
) -> DataFrame | None:
    """Tier, probability per tier and revenue of new games from a fit on all training games.

    Probabilities are named by the tier the model learned; a tier absent from training gets 0.
    """
    new = sentiment_features(new)
    names = [c for c in features if c in new.columns and c in train.columns]
    if not names:
        return None
    known = train.select(tier, F.log1p(revenue).alias("_y"), _features(names))
    known = known.where(F.col(tier).isNotNull() & F.col("_y").isNotNull() & _all_known("_x"))
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    present = _present_tiers(known, tier)
    n = sum(present.values())
    if n < SMALLEST_SAMPLE:
        known.unpersist()
        return None
    sums = ridge_sums(known, len(names), "_y")
    mean, scale, weights, level = (part[0] for part in sums.solve(alpha))
    slopes = weights / scale
    start = float(level - ((mean + sums.centre) * slopes).sum())
    terms = F.zip_with("_x", F.array(*[F.lit(float(v)) for v in slopes]), lambda x, w: x * w)
    fit = F.aggregate(terms, F.lit(start), lambda total, term: total + term)
    games = new.select(key, _features(names)).where(_all_known("_x"))
    games = games.withColumn("predicted_revenue_usd", F.greatest(F.expm1(fit), F.lit(0.0)))
    order = list(present)
    if len(order) == 1:
        scored = games.withColumn("_p", F.array(F.lit(1.0)))
    else:
        model = _tier_model(_with_vector(_with_label(known, tier, order)), n, len(order))
        scored = model.transform(_with_vector(games)).withColumn("_p", vector_to_array("probability"))
    known.unpersist()
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    probability = [
        (F.get("_p", F.lit(order.index(t))) if t in order else F.lit(0.0)).alias(f"prob_{t.lower()}")
        for t in values.TIERS
    ]
    predicted = F.get(F.array(*[F.lit(t) for t in order]), best)
    return scored.select(key, predicted.alias("predicted_tier"), *probability, "predicted_revenue_usd")


def ablation(
    matrix: DataFrame,
    key: str = "app_id",
    feature_sets: Sequence[str] = tuple(FEATURE_SETS),
    folds: int | None = None,
    baseline: str = "steam",
) -> DataFrame:
    """Both tasks for every feature set, with the differences to the baseline set; ``folds`` as in ``loo_classify``."""
    spark = matrix.sparkSession
    rows = []
    for name in feature_sets:
        features = feature_columns(name, matrix)
        row = {"feature_set": name, "n_features": len(features)}
        tiers = loo_classify(matrix, key, features, folds=folds, any_size=True) if features else None
        if tiers is not None:
            measured = tiers.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("a"))
            row["cls_n"], row["cls_accuracy"] = measured.first()
        sales = loo_ridge(matrix, key, features, "estimated_revenue_usd") if features else None
        if sales is not None:
            scores = revenue_scores(sales).first()
            row |= {"reg_n": scores["n"], "reg_mae_usd": scores["mae"]}
            row |= {"reg_rmse_usd": scores["rmse"], "reg_r2_log": scores["r2"]}
        rows.append(row)
    base = next((r for r in rows if r["feature_set"] == baseline), {})
    for row in rows:
        for measure in ("cls_accuracy", "reg_r2_log", "reg_mae_usd"):
            if row.get(measure) is not None and base.get(measure) is not None:
                row[f"delta_{measure}"] = row[measure] - base[measure]
    schema = (
        "feature_set string, n_features int, cls_n bigint, cls_accuracy double, reg_n bigint, "
        "reg_mae_usd double, reg_rmse_usd double, reg_r2_log double, delta_cls_accuracy double, "
        "delta_reg_r2_log double, delta_reg_mae_usd double"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)
