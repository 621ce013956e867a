"""Build the dataset, compare classifiers, validate the hypothesis, predict outcomes.

Each flow composes operators into lazy plans and writes its result tables once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..learning import outcomes
from ..learning.classifiers import MODELS
from ..learning.runner import run_cv
from ..operators import aggregates, correlation, metrics, nonparametric
from ..operators.relational import clean_reviews, dedup_reviews, enrich_left
from ..session import materialize
from ..sources import manifest, readers, sinks


def transform_reviews(raw: DataFrame, metadata: DataFrame | None = None, minimum: int = 10, dedup: bool = True):
    """Clean, length filter, dedup on raw text, metadata: in this order."""
    df = clean_reviews(raw, minimum=minimum)
    if dedup:
        df = dedup_reviews(df)
    return df if metadata is None else enrich_left(df, metadata)


def build_dataset(
    spark: SparkSession,
    raw: dict[str, str],
    metadata: dict[str, str],
    output: str,
    force: bool = False,
) -> dict[str, int]:
    """Training and validation tables as Parquet with a manifest; skipped when nothing changed.

    ``raw`` and ``metadata`` map 'training' and 'validation' to paths.
    """
    manifest_path = f"{output}/manifest"
    hashes = manifest.source_hashes(spark, *raw.values())
    if not force:
        try:
            record, stored = manifest.read_manifest(spark, manifest_path)
            if not manifest.is_stale(hashes, stored):
                return record.select("training_rows", "validation_rows").first().asDict()
        except Exception as missing:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    rows = {"training_rows": 0, "validation_rows": 0}
    for split, path in raw.items():
        known = readers.read_metadata(spark, metadata[split]) if split in metadata else None
        counted = sinks.write_dataset(
            transform_reviews(readers.read_reviews(spark, path), known), f"{output}/{split}", split
        )
        rows[f"{split}_rows"] = counted["rows"]
    manifest.write_manifest(hashes, rows, manifest_path)
    return rows


def compare_models(
    results: DataFrame, models: Sequence[str], policy: str = "drop_incomplete_models"
) -> dict[str, DataFrame]:
    """Result tables of the model comparison, from the run matrix written once."""
    matrix = materialize(metrics.run_matrix(results, models), "run-matrix")
    complete, kept, excluded = metrics.apply_policy(matrix, models, policy)
    long = complete.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("f1_score")) for m in kept
    ])))
    return {
        "friedman": nonparametric.friedman(complete, kept),
        "average_ranks": nonparametric.average_ranks(complete, kept),
        "nemenyi": nonparametric.nemenyi(complete, kept),
        "wilcoxon": nonparametric.wilcoxon_pairs(complete, kept),
        "descriptives": metrics.describe_matrix(long, "model", "f1_score"),
        "model_summary": metrics.model_summary(results.where(~F.col("model").isin(excluded))),
    }


def train_and_compare(
    reviews: DataFrame, results_path: str, models: Sequence[str] = MODELS, seeds: Sequence[int] = (0,), k: int = 5, **options
) -> dict[str, DataFrame]:
    """Cross-validation, continued where it stopped, then the comparison of at least two models."""
    results = run_cv(reviews, results_path, models, seeds, k, **options)
    if len(models) < 2:
        return {"model_summary": metrics.model_summary(results)}
    return compare_models(results, models)


def validate(
    reviews: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    success: DataFrame | None = None,
    metadata: DataFrame | None = None,
    as_of_year: int | None = None,
) -> dict[str, DataFrame]:
    """Game sentiment, accuracy and all correlations; the reviews are scored once."""
    scored = score(reviews).persist(StorageLevel.MEMORY_AND_DISK)
    games = materialize(aggregates.game_sentiment(scored), "game-sentiment")
    tables = {
        "game_sentiment": games.orderBy(F.col("ea_predicted_positive_ratio").desc(), "game_name"),
        "accuracy": materialize(
            metrics.accuracy_by_game(scored.where(F.col("review_type") == "early_access")), "accuracy"
        ),
        "hypothesis": correlation.validate_hypothesis(games),
    }
    scored.unpersist()
    if success is not None:
        year = as_of_year or date.today().year
        matrix = materialize(outcomes.feature_matrix(games, success, year, metadata=metadata), "matrix")
        tables["success"] = correlation.with_p_values(correlation.correlate_features(matrix))
        tables["metadata"] = correlation.with_p_values(
            correlation.correlate_metadata(matrix, outcomes.METADATA_FEATURES)
        )
        tables["top_metadata"] = correlation.correlation_summary(tables["metadata"])
    return tables


def predict_success(
    games: DataFrame, success: DataFrame, as_of_year: int, video: DataFrame | None = None, metadata: DataFrame | None = None,
    tier_folds: int | None = None,
) -> dict[str, DataFrame]:
    """Feature matrix once, then ablation and held-out predictions of tier and revenue.

    Tiers leave out one row per model, or one of ``tier_folds`` folds.
    """
    matrix = materialize(outcomes.feature_matrix(games, success, as_of_year, video, metadata), "matrix")
    features = outcomes.feature_columns("steam", matrix)
    tables = {
        "ablation": outcomes.ablation(matrix, folds=tier_folds),
        "tiers": outcomes.loo_classify(matrix, "app_id", features, folds=tier_folds),
        "revenue": outcomes.loo_ridge(matrix, "app_id", features, "estimated_revenue_usd"),
    }
    if tables["tiers"] is not None:
        tables["tier_report"] = metrics.class_report(
            tables["tiers"], "actual_tier", "predicted_tier", ("Flop", "Moderate", "Hit", "Blockbuster")
        )
        tables["tier_confusion"] = metrics.confusion(
            tables["tiers"], "actual_tier", "predicted_tier", ("Flop", "Moderate", "Hit", "Blockbuster")
        )
    if tables["revenue"] is not None:
        tables["revenue_scores"] = outcomes.revenue_scores(tables["revenue"])
    return {name: table for name, table in tables.items() if table is not None}


def save_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    for name, table in tables.items():
        sinks.write_result(table, f"{folder}/{name}", kind)
