"""Landed JSON documents flattened into table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import (
    blank_to_null,
    data_complete,
    estimated_revenue,
    floor_midpoint,
    parse_range,
    success_tier,
)

TOP_TAGS = 10


def _descriptions(entries: Column) -> Column:
    texts = F.filter(F.transform(entries, lambda e: e["description"]), lambda d: d != "")
    return F.coalesce(F.array_join(texts, "|"), F.lit(""))


def _price(doc: Column) -> Column:
    """Cents as dollars; free games cost 0; otherwise unknown, as with an empty price object."""
    overview = doc["price_overview"]
    cents = F.coalesce(overview["initial"].try_cast("bigint"), F.lit(0))
    return F.when(F.size(overview) > 0, cents / F.lit(100.0)).when(doc["is_free"], F.lit(0.0))


def flatten_store_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Metadata columns of a store document next to the columns of ``df``."""
    parsed = df.withColumn("_doc", F.from_json(body, schemas.STORE_JSON))
    doc = F.col("_doc")
    enabled = F.map_keys(F.map_filter(doc["platforms"], lambda name, on: F.coalesce(on, F.lit(False))))
    return parsed.select(
        *[c for c in df.columns if c != body],
        F.coalesce(F.array_join(doc["developers"], ", "), F.lit("")).alias("developer"),
        F.coalesce(F.array_join(doc["publishers"], ", "), F.lit("")).alias("publisher"),
        F.coalesce(doc["release_date"]["date"], F.lit("")).alias("release_date"),
        _price(doc).alias("current_price_usd"),
        _descriptions(doc["genres"]).alias("genres"),
        _descriptions(doc["categories"]).alias("categories"),
        F.coalesce(F.array_join(enabled, "|"), F.lit("")).alias("platforms"),
        F.coalesce(F.trim(doc["required_age"]).try_cast("int"), F.lit(0)).alias("required_age"),
        F.coalesce(doc["short_description"], F.lit("")).alias("short_description"),
    )


def top_tags(tags: Column, n: int = TOP_TAGS) -> Column:
    """Names of the ``n`` entries with the most votes; ties keep the order of the document."""

    def more_votes(a: Column, b: Column) -> Column:
        return F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0)

    ordered = F.slice(F.array_sort(F.map_entries(tags), more_votes), 1, n)
    return F.array_join(F.transform(ordered, lambda e: e["key"]), "|")


def flatten_engagement_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Owner range, counts and top tags of an engagement document."""
    parsed = df.withColumn("_doc", F.from_json(body, schemas.ENGAGEMENT_JSON))
    parsed = parsed.withColumn("_owners", parse_range(F.col("_doc.owners")))
    doc = F.col("_doc")
    return parsed.select(
        *[c for c in df.columns if c != body],
        F.col("_owners.low").alias("steamspy_owners_min"),
        F.col("_owners.high").alias("steamspy_owners_max"),
        doc["players_forever"].alias("steamspy_players_forever"),
        doc["average_forever"].alias("steamspy_avg_playtime"),
        doc["positive"].alias("steamspy_positive"),
        doc["negative"].alias("steamspy_negative"),
        blank_to_null(doc["genre"]).alias("steamspy_genre"),
        blank_to_null(top_tags(doc["tags"])).alias("steamspy_tags"),
        blank_to_null(doc["languages"]).alias("steamspy_languages"),
    )


def flatten_store_outcomes(df: DataFrame, body: str = "body") -> DataFrame:
    """Critic score, review total, release date and price of a store document."""
    parsed = df.withColumn("_doc", F.from_json(body, schemas.STORE_JSON))
    doc = F.col("_doc")
    return parsed.select(
        *[c for c in df.columns if c != body],
        doc["metacritic"]["score"].alias("steam_metacritic_score"),
        doc["recommendations"]["total"].alias("steam_total_reviews"),
        doc["release_date"]["date"].alias("steam_release_date"),
        _price(doc).alias("steam_current_price_usd"),
    )


def build_metrics(engagement: DataFrame, store: DataFrame) -> DataFrame:
    """Outcome rows from both documents of an app, with revenue, tier and completeness."""
    joined = engagement.withColumn("_engaged", F.lit(True)).join(
        store.withColumn("_stored", F.lit(True)), "app_id", "full"
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("_engaged").isNull(), "SteamSpy failed"),
            F.when(F.col("_stored").isNull(), "Steam Store failed"),
        )
    )
    revenue = estimated_revenue("steam_total_reviews", "steam_current_price_usd")
    return (
        joined.withColumn("estimated_revenue_usd", revenue)
        .withColumn("success_tier", success_tier("estimated_revenue_usd"))
        .withColumn(
            "data_complete",
            data_complete("steamspy_owners_min", "steam_total_reviews", "steam_metacritic_score"),
        )
        .withColumn("last_error", blank_to_null(F.array_join(errors, "; ")))
        .drop("_engaged", "_stored")
    )


def parse_candidates(df: DataFrame, body: str = "body") -> DataFrame:
    """Candidate games of a discovery listing: totals and the middle of the owner range."""
    parsed = df.withColumn("_doc", F.from_json(body, schemas.CANDIDATE_JSON))
    parsed = parsed.withColumn("_owners", parse_range(F.col("_doc.owners")))
    positive = F.coalesce(F.col("_doc.positive"), F.lit(0))
    negative = F.coalesce(F.col("_doc.negative"), F.lit(0))
    return parsed.select(
        "app_id",
        F.coalesce(F.col("_doc.name"), F.lit("Unknown")).alias("name"),
        (positive + negative).alias("total_reviews"),
        positive.alias("positive_reviews"),
        F.coalesce(floor_midpoint("_owners.low", "_owners.high"), F.lit(0)).alias("owners_midpoint"),
    )
