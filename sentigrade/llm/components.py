"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _low(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every ``u``; partial minima are formed before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _low(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v."""
    low = _low(edges)
    linked = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``u`` and ``root``, the smallest node it reaches, for every node with a smaller one in reach.

    ``edges`` has columns u and v, comparable and not null; loops and repeats do no harm.  Every round is
    written to the shared folder, so a lost executor costs no more than the round.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    current = materialize(ordered, label)

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = state(current)
    while seen[0]:
        current = materialize(_small_star(_large_star(current)), label)
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.select("u", F.col("v").alias("root"))
