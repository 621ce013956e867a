"""First, top-n, numbering, ranks and quantiles that stay parallel inside a hot group.

A window function sorts each of its groups in one task.  The operators here therefore use one
window per group only where a count shows the groups to be small, and otherwise work on pieces
of a group: pre-aggregated copies, salted parts, hash ranges or value ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

# Rows of one group that a single task may sort.
ROWS_PER_SORT = 1_000_000
# Leading hex digits of a hash that form its range.
HASH_DIGITS = 4


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``.

    Copies collapse on the map side before the shuffle, so a key holding a third of the rows
    sends one row per task.  The hash leads the grouping because the rows are sorted by it:
    long texts are then compared only when they are equal.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
    first = grouped.agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def with_salt(
    df: DataFrame, keys: Sequence[str], spread: Sequence[str], limit: int, rows: int = ROWS_PER_SORT
) -> DataFrame:
    """Adds ``_salt``: 0 for ordinary keys, a hash of ``spread`` for keys above ``rows`` rows.

    A key with c rows gets sqrt(c / limit) salts, which balances the salted step with the step
    that merges ``limit`` rows per salt.  The list of hot keys has at most count(df) / rows entries;
    adaptive execution broadcasts it where its measured size allows and else splits the hot parts.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .select(*keys, F.ceil(F.sqrt(F.col("_n") / limit)).cast("int").alias("_salts"))
    )
    salt = F.when(
        F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")
    ).otherwise(0)
    return df.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_salts")


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    rows: int = ROWS_PER_SORT,
) -> DataFrame:
    """The exact first ``n`` rows of every key; ``order`` must be total.

    Parts of a hot key are cut to ``n`` rows each before their survivors meet in one task.
    """
    salted = with_salt(df, keys, spread, n, rows)
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )


def number_by_hash(
    df: DataFrame, group: str, key: str, seed: int, out: str, digits: int = HASH_DIGITS
) -> DataFrame:
    """Numbers the rows of each group 0, 1, 2, ... in the order of md5(seed:key), then key.

    Groups may be huge (two labels over the whole table), so rows are numbered inside hash
    ranges, which are even by construction, and shifted by the sizes of the ranges before.
    The table of sizes has at most groups x 16^digits rows.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_range", F.substring("_hash", 1, digits))
    sizes = hashed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    inside = W.partitionBy(group, "_range").orderBy("_hash", key)
    numbered = hashed.withColumn("_number", F.row_number().over(inside))
    return (
        numbered.join(shifts, [group, "_range"])
        .withColumn(out, F.col("_number") - 1 + F.col("_shift"))
        .select(*df.columns, out)
    )


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Row count of the largest group; one column-pruned pass, pre-aggregated before the shuffle."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


@dataclass
class ValueCounts:
    """Distinct values per group with their count and the number of smaller rows."""

    table: DataFrame  # groups..., value, cnt, before
    groups: list[str]
    value: str


def value_counts_in_order(df: DataFrame, groups: Sequence[str], value: str, counted: str | None = None) -> ValueCounts:
    """Counts each distinct value and the rows below it; ``counted`` names a column with the rows a row stands for.

    Equal values collapse first, so a value that fills a third of the rows is one row.  The distinct
    values of all groups are then dealt to ranges in their order, written once so that both uses agree
    on the ranges, and counted inside a range; the sums of the ranges before shift the counts.
    """
    groups = list(groups)
    if not groups:
        raise ValueError("name at least one group column; use a constant one for the whole table")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg((F.sum(counted) if counted else F.count(F.lit(1))).alias("cnt"))
    )
    ranged = materialize(
        counts.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()), "value-ranges"
    )
    sums = ranged.groupBy(*groups, "_range").agg(F.sum("cnt").alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sums.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = W.partitionBy(*groups, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ordered = (
        ranged.withColumn("_inside", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .join(shifts, [*groups, "_range"])
        .withColumn("before", F.col("_inside") + F.col("_shift"))
        .drop("_inside", "_shift", "_range")
    )
    return ValueCounts(ordered, groups, value)


def average_rank(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    out: str,
    ties: str | None = None,
    rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Ascending average-tie rank of ``value`` inside each group; NULL values get no rank.

    ``ties`` names an extra column for the number of rows sharing the value.  ``largest`` is the
    size of the largest group where the caller has measured it already.
    """
    groups = list(groups)
    rows = ROWS_PER_SORT if rows is None else rows
    if (largest_group(df, groups) if largest is None else largest) <= rows:
        # Rank and number of equal rows share one window, so several ranks of the same groups need
        # one shuffle and one sort each.
        known = F.col(value).isNotNull()
        by_value = W.partitionBy(*groups).orderBy(F.col(value).asc_nulls_last())
        equal = F.count(value).over(by_value.rangeBetween(W.currentRow, W.currentRow))
        rank = F.rank().over(by_value) + (equal - 1) / F.lit(2.0)
        ranks = {out: F.when(known, rank)}
        if ties:
            ranks[ties] = F.when(known, equal)
        return df.withColumns(ranks)

    counts = value_counts_in_order(df, groups, value)
    columns = {out: F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)}
    if ties:
        columns[ties] = F.col("cnt")
    ranks = counts.table.select(*groups, value, *[c.alias(name) for name, c in columns.items()])
    # Adaptive execution broadcasts the ranks when the distinct values are few and otherwise
    # splits the join partitions of a value that many rows share.
    return df.join(ranks, [*groups, value], "left")


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    shares: dict[str, float],
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``shares``.

    The value at a position is the one whose [before, before + cnt) covers it, so no group is
    gathered in one place: each quantile is two conditional maxima over the ordered counts.
    """
    groups = list(groups)
    ordered = value_counts_in_order(df, groups, value).table
    sizes = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered.join(sizes, groups)
    picks, results = [], []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(share)
        for end, position in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (F.col("before") <= position) & (position < F.col("before") + F.col("cnt"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{end}"))
        fraction = (F.col("_n") - 1) * F.lit(share) - F.floor((F.col("_n") - 1) * F.lit(share))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * fraction).alias(name))
    return placed.groupBy(*groups, "_n").agg(*picks).select(*groups, *results)
