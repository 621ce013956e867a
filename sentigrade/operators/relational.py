"""Filters, joins and set operations over review and game tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, longer_than, normalize_name
from .ordering import keep_first

METADATA_COLUMNS = ("app_id", "developer", "publisher", "release_date", "current_price_usd")


def clean_reviews(df: DataFrame, text: str = "review_text", minimum: int = 10) -> DataFrame:
    """Drops rows without text, adds ``cleaned_text`` and keeps the ones longer than ``minimum``."""
    return (
        df.na.drop(subset=[text])
        .withColumn("cleaned_text", clean_text(text))
        .where(longer_than("cleaned_text", minimum))
    )


def dedup_reviews(
    df: DataFrame,
    keys: Sequence[str] = ("app_id", "review_text"),
    order: Sequence[str] = ("source_file", "row_id"),
) -> DataFrame:
    """One row per app and raw text: the first by file name and position in the file."""
    return keep_first(df, list(keys), list(order))


def distinct_reviews(df: DataFrame, labelled: bool = False) -> DataFrame:
    """Cleaned reviews without copies; with ``labelled`` only those whose first copy has a label.

    The same rows as cleaning before: copies share their raw text, and so its cleaned form.  Cleaned texts
    are not shuffled, and only what is kept is cleaned.
    """
    first = dedup_reviews(df.na.drop(subset=["review_text"]))
    return clean_reviews(first.where("positive IS NOT NULL") if labelled else first)


def enrich_left(df: DataFrame, metadata: DataFrame, columns: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """Adds the metadata of each app.  The side to broadcast is left to the optimizer's size check."""
    available = [c for c in columns if c in metadata.columns]
    return df.join(metadata.select(*available), "app_id", "left")


def join_suffix(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str, how: str = "inner"
) -> DataFrame:
    """Equi-join in which clashing columns of the right side get a suffix."""
    clashes = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clashes), list(on), how)


def join_by_name(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, suffix: str, how: str = "inner"
) -> DataFrame:
    """Join on the normalized title, for tables that share no app_id."""
    return join_suffix(
        left.withColumn("name_key", normalize_name(left_name)),
        right.withColumn("name_key", normalize_name(right_name)),
        ["name_key"],
        suffix,
        how,
    )


def join_games(left: DataFrame, right: DataFrame, suffix: str, how: str = "inner") -> DataFrame:
    """By app_id where both sides have it, else by title."""
    if "app_id" in left.columns and "app_id" in right.columns:
        return join_suffix(left, right, ["app_id"], suffix, how)

    def title(df: DataFrame) -> str:
        return "game_name" if "game_name" in df.columns else "app_name"

    return join_by_name(left, right, title(left), title(right), suffix, how)


def first_wins_union(frames: Sequence[DataFrame], key: str, order: Sequence[str] = ()) -> DataFrame:
    """Union in which the earliest frame wins per key; inside a frame, the first by ``order``."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for frame in tagged[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    order = list(order) or [c for c in frames[0].columns if c != key]
    return keep_first(union, [key], ["_frame", *order]).drop("_frame")


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def append_unseen(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` plus the rows of ``incoming`` with a new key; the first wins inside ``incoming``."""
    rest = [c for c in incoming.columns if c not in keys]
    fresh = keep_first(not_done(incoming, existing, keys), list(keys), rest)
    return existing.unionByName(fresh, allowMissingColumns=True)


def subset(df: DataFrame, game: str | None = None, review_type: str | None = None) -> DataFrame:
    if game is not None:
        df = df.where(F.col("game_name") == game)
    if review_type is not None:
        df = df.where(F.col("review_type") == review_type)
    return df


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Sort and limit, which the planner runs as one top-n without a full sort."""
    return df.orderBy(*order).limit(n)


def training_plan(
    seeds: DataFrame, models: Sequence[str], folds: int, done: DataFrame | None = None
) -> DataFrame:
    """Every model x seed x fold without the completed ones; ``seeds`` has one row per seed."""
    plan = (
        seeds.select("seed", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .select("model", "seed", "fold")
    )
    return plan if done is None else not_done(plan, done, ["model", "seed", "fold"])


def varying_columns(df: DataFrame, columns: Sequence[str], minimum: int = 5) -> DataFrame:
    """Per column: counts and whether it varies enough to be correlated.

    One pass over the values in long form, pre-aggregated per column: 0/1 columns need two of each
    kind, others two distinct values, which exist exactly when minimum and maximum differ.
    """
    listed = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]
    )
    x = F.col("x")
    table = (
        df.select(F.inline(listed))
        .groupBy("feature")
        .agg(
            F.count(x).alias("n"),
            F.sum(x).alias("total"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.coalesce(F.every(x.isin(0.0, 1.0)), F.lit(False)).alias("is_binary"),
        )
    )
    binary_ok = (F.col("total") >= 2) & (F.col("n") - F.col("total") >= 2)
    varies = F.when(F.col("is_binary"), binary_ok).otherwise(F.col("low") < F.col("high"))
    keep = (F.col("n") >= minimum) & F.coalesce(varies, F.lit(False))
    return table.withColumn("keep", keep)
