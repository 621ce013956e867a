"""Per-game sentiment features and the distribution tables of a review set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .ordering import exact_quantiles

# Fixed value: texts with more words count as long.
LONG_TEXT = 50


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _text_features(words: Column, positive: Column, probability: Column, among: Column, names: dict) -> list:
    """Sentiment and length measures over the rows where ``among`` holds."""

    def of(value: Column) -> Column:
        return F.when(among, value)

    pos_length = F.coalesce(F.avg(F.when(among & (positive == 1), words)), F.lit(0.0))
    neg_length = F.coalesce(F.avg(F.when(among & (positive == 0), words)), F.lit(0.0))
    measures = {
        "count": F.count(of(F.lit(1))),
        "predicted_ratio": F.avg(of(positive)),
        "probability": F.avg(of(probability)),
        "spread": F.stddev_pop(of(probability)),
        "mean_length": F.avg(of(words)),
        "std_length": F.stddev_pop(of(words).cast("double")),
        "long_ratio": F.avg(of((words > LONG_TEXT).cast("double"))),
        "pos_length": pos_length,
        "neg_length": neg_length,
        "length_ratio": F.when(pos_length > 0, neg_length / pos_length).otherwise(0.0),
    }
    return [measures[key].alias(name) for key, name in names.items()]


def game_sentiment(scored: DataFrame, game: str = "game_name") -> DataFrame:
    """Early-access sentiment features and the post-release outcome of each game.

    One pass of conditional aggregates over rows with review_text, review_type, positive,
    predicted and probability; a game with most of the rows is pre-aggregated on the map side.
    Games without early-access reviews have no row.
    """
    early = F.col("review_type") == "early_access"
    post = F.col("review_type") == "post_release"
    words = word_count("review_text")
    text = _text_features(
        F.col("_words"),
        F.col("predicted"),
        F.col("probability"),
        early,
        {
            "count": "ea_review_count",
            "predicted_ratio": "ea_predicted_positive_ratio",
            "probability": "ea_avg_positive_probability",
            "spread": "ea_sentiment_std",
            "mean_length": "ea_mean_review_length",
            "std_length": "ea_std_review_length",
            "long_ratio": "ea_long_review_ratio",
            "pos_length": "ea_mean_pos_review_length",
            "neg_length": "ea_mean_neg_review_length",
            "length_ratio": "ea_neg_pos_length_ratio",
        },
    )
    return (
        scored.withColumn("_words", words)
        .groupBy(game)
        .agg(
            F.min_by(F.when(early, F.col("app_id")), F.when(early, F.col("row_id"))).alias("app_id"),
            *text,
            F.avg(F.when(early, F.col("positive"))).alias("ea_actual_positive_ratio"),
            F.count(F.when(post, 1)).alias("pr_review_count"),
            F.avg(F.when(post, F.col("positive"))).alias("pr_actual_positive_ratio"),
        )
        .where(F.col("ea_review_count") > 0)
    )


def text_sentiment(scored: DataFrame, min_comments: int = 10) -> DataFrame:
    """The same features for comments, per app, for apps with enough comments."""
    names = {
        "count": "yt_comment_count",
        "predicted_ratio": "yt_predicted_positive_ratio",
        "probability": "yt_avg_positive_probability",
        "spread": "yt_sentiment_std",
        "mean_length": "yt_mean_comment_length",
        "std_length": "yt_std_comment_length",
        "long_ratio": "yt_long_comment_ratio",
        "pos_length": "yt_mean_pos_comment_length",
        "neg_length": "yt_mean_neg_comment_length",
    }
    measures = _text_features(
        F.col("_words"), F.col("predicted"), F.col("probability"), F.lit(True), names
    )
    return (
        scored.withColumn("_words", word_count("text"))
        .groupBy("app_id", "app_name")
        .agg(*measures)
        .where(F.col("yt_comment_count") >= min_comments)
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Class counts overall (review_type NULL) and per review type.

    The rollup runs on the counts per type, so the review rows are read once and not expanded.
    """
    counts = df.groupBy("review_type").agg(
        F.count_if(F.col("positive") == 1).alias("n_positive"),
        F.count_if(F.col("positive") == 0).alias("n_negative"),
    )
    rolled = counts.rollup("review_type").agg(
        F.grouping("review_type").alias("is_total"),
        F.sum("n_positive").alias("n_positive"),
        F.sum("n_negative").alias("n_negative"),
    )
    total = F.col("n_positive") + F.col("n_negative")
    return rolled.select(
        "review_type",
        F.col("is_total").cast("int").alias("is_total"),
        total.alias("n"),
        "n_positive",
        "n_negative",
        (F.try_divide(F.col("n_positive"), total) * 100).alias("positive_pct"),
        F.try_divide(F.col("n_positive"), F.col("n_negative")).alias("pos_neg_ratio"),
    )


def subset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("positive") == 1).alias("n_positive"),
        F.count_if(F.col("positive") == 0).alias("n_negative"),
        F.coalesce(F.avg("positive"), F.lit(0.0)).alias("positive_ratio"),
        F.count_distinct("game_name").alias("n_games"),
    )


def crosstab_pct(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Row percentages; the pivot values are given, so no job is run to find them."""
    counts = df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    total = sum((F.col(str(v)) for v in values), F.lit(0))
    return counts.select(
        row, *[(F.try_divide(F.col(str(v)), total) * 100).alias(f"pct_{v}") for v in values]
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), *columns)


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin includes the maximum.

    Equal values collapse first; the range is a scalar subquery over the same counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    low = counts.select(F.min(value).cast("double")).scalar()
    high = counts.select(F.max(value).cast("double")).scalar()
    x = F.col(value).cast("double")
    ranged = counts.withColumn("_low", low).withColumn("_width", (high - low) / F.lit(bins))
    place = F.floor(F.try_divide(x - F.col("_low"), F.col("_width")))
    bin_number = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    edge = F.col("_low") + F.col("bin") * F.col("_width")
    return (
        ranged.withColumn("bin", bin_number)
        .groupBy("bin", "_low", "_width")
        .agg(F.sum("n").alias("n"))
        .select("bin", edge.alias("bin_low"), (edge + F.col("_width")).alias("bin_high"), "n")
    )


def length_stats(df: DataFrame, text: str) -> DataFrame:
    """Mean, exact median, minimum and maximum of the text length in characters."""
    lengths = df.select(F.lit("all").alias("scope"), F.char_length(text).alias("text_length"))
    medians = exact_quantiles(lengths, ["scope"], "text_length", {"median_length": 0.5})
    rest = lengths.groupBy("scope").agg(
        F.avg("text_length").alias("mean_length"),
        F.min("text_length").alias("min_length"),
        F.max("text_length").alias("max_length"),
    )
    return rest.join(medians, "scope").drop("scope")


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and outlier count, by falling median."""
    quartiles = exact_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        df.select(group, value)
        .join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
        .orderBy(F.col("median").desc(), group)
    )


def outcome_summary(metrics: DataFrame) -> DataFrame:
    """Completeness and tier counts of an outcome table, as one row."""
    tiers = [
        F.count_if(F.col("success_tier") == tier).alias(f"n_{tier.lower()}")
        for tier in ("Flop", "Moderate", "Hit", "Blockbuster")
    ]
    return metrics.agg(
        F.count(F.lit(1)).alias("n_games"),
        F.count_if(F.col("data_complete")).alias("n_complete"),
        F.count("steam_metacritic_score").alias("n_critic_score"),
        F.count("steamspy_owners_min").alias("n_owners"),
        F.count("estimated_revenue_usd").alias("n_revenue"),
        *tiers,
    )


def distinct_games(df: DataFrame, column: str = "game_name", approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(counter(column).alias("n_games"))


def distinct_sketches(df: DataFrame, column: str, by: Sequence[str] = (), precision: int = 12) -> DataFrame:
    """One mergeable sketch of the distinct values of ``column`` for each group: a few kilobytes however many rows.

    Sketches of batches can be stored and merged later; values are not read again.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(column).cast("string"), precision).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated number of distinct values per group of stored sketches."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, F.hll_sketch_estimate("sketch").alias("n_distinct"))


def imbalance(df: DataFrame, label: str, limit: float = 0.8) -> DataFrame:
    """Majority class, its share, and whether the labels are degenerate or imbalanced."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.try_divide(F.max("n"), F.sum("n"))
    return counts.agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_classes"),
        share.alias("majority_share"),
        ((F.count(F.lit(1)) > 1) & (share > limit)).alias("is_imbalanced"),
    )
