"""Review routing by release window, and discovery of new games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import STILL_OPEN
from ..operators.ordering import ROWS_PER_SORT, keep_first, top_per_group
from ..operators.relational import not_done

# Stand-in end of an open window, owner limit between small and large games,
# share of small games.
OPEN_WINDOW_END = 2_000_000_000
LARGE_GAME_OWNERS = 500_000
SMALL_GAME_SHARE = 0.6


def route_reviews(
    reviews: DataFrame, registry: DataFrame, max_reviews: int = 10_000, rows: int = ROWS_PER_SORT
) -> DataFrame:
    """Reviews sent to early_access and post_release, the latest ``max_reviews`` per game and type.

    Early: flagged by the store, or written inside the window.  Later: written after the window's
    end, or unflagged where no end is known; games still in early access have none.  A review can
    be both.  ``reviews`` has app_id, ts (epoch seconds), early_flag and row_id.
    """
    windows = registry.select("app_id", "start_date", "end_date")
    joined = reviews.join(windows, "app_id")
    open_end = F.when(F.col("end_date") == STILL_OPEN, F.lit(OPEN_WINDOW_END)).otherwise(F.col("end_date"))
    inside = F.coalesce(F.col("ts").between(F.col("start_date"), open_end), F.lit(False))
    early = F.coalesce(F.col("early_flag"), F.lit(False)) | inside
    later = F.when(F.col("end_date") == STILL_OPEN, F.lit(False)).otherwise(
        F.coalesce(F.col("ts") > F.col("end_date"), ~F.coalesce(F.col("early_flag"), F.lit(False)))
    )
    kinds = F.filter(
        F.array(F.when(early, F.lit("early_access")), F.when(later, F.lit("post_release"))),
        lambda kind: kind.isNotNull(),
    )
    routed = joined.withColumn("review_type", F.explode(kinds)).drop("start_date", "end_date")
    return top_per_group(
        routed,
        ["app_id", "review_type"],
        [F.col("ts").desc(), F.col("row_id")],
        max_reviews,
        ["row_id"],
        rows,
    )


def discover(
    candidates: DataFrame,
    registry: DataFrame,
    min_reviews: int = 500,
    k: int = 100,
    small_share: float = SMALL_GAME_SHARE,
    rows: int = ROWS_PER_SORT,
) -> DataFrame:
    """New games with enough reviews, a quota of small and large ones, most reviewed first."""
    single = keep_first(candidates, ["app_id"], [c for c in candidates.columns if c != "app_id"])
    enough = single.where(F.col("total_reviews") >= min_reviews)
    fresh = not_done(enough, registry, ["app_id"]).withColumn(
        "category", F.when(F.col("owners_midpoint") < LARGE_GAME_OWNERS, "indie").otherwise("aaa")
    )
    small = int(k * small_share)
    order = [F.col("total_reviews").desc(), F.col("app_id")]
    quota = F.when(F.col("category") == "indie", small).otherwise(k - small)
    picked = top_per_group(fresh, ["category"], order, max(small, k - small), ["app_id"], rows)
    # At most 2k rows are left; the smaller quota is applied to them.
    place = F.row_number().over(W.partitionBy("category").orderBy(*order))
    return picked.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place").orderBy(*order)


def add_to_registry(registry: DataFrame, candidates: DataFrame, split: str = "training") -> DataFrame:
    """Registry plus the candidates not yet in that split; their window is still to be filled in."""
    fresh = not_done(candidates, registry.where(F.col("split") == split), ["app_id"])
    single = keep_first(fresh, ["app_id"], ["total_reviews", "name"])
    added = single.select(
        "app_id",
        "name",
        F.lit(None).cast("bigint").alias("start_date"),
        F.lit(None).cast("bigint").alias("end_date"),
        F.lit(split).alias("split"),
        F.lit(True).alias("discovered"),
        "owners_midpoint",
        "total_reviews",
        "category",
    )
    return registry.unionByName(added, allowMissingColumns=True)
