"""Pearson, Spearman and partial rank correlations of any number of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import effect_size, verdict
from ..session import materialize
from . import tails
from .ordering import average_rank, value_counts_in_order

# Different values of a column whose ranks go to every task; rows worked on at a time.
VALUES_IN_TABLE = 1000
SLICE = 4096

# The feature and outcome columns that are related to each other.
SENTIMENT_FEATURES = (
    "ea_predicted_positive_ratio",
    "ea_sentiment_std",
    "ea_mean_review_length",
    "ea_long_review_ratio",
    "ea_neg_pos_length_ratio",
    "log_ea_review_count",
)
OUTCOMES = (
    "owners_midpoint",
    "steamspy_owners_min",
    "steam_metacritic_score",
    "steamspy_avg_playtime",
    "review_score",
    "estimated_revenue_usd",
)
CONTROLLED_OUTCOMES = ("estimated_revenue_usd", "owners_midpoint", "steamspy_owners_min")
CONTROL = "log_ea_review_count"


def _moments(x: str, y: str, prefix: str) -> list[Column]:
    return [
        F.covar_pop(x, y).alias(f"{prefix}_cov"),
        F.var_pop(x).alias(f"{prefix}_vx"),
        F.var_pop(y).alias(f"{prefix}_vy"),
    ]


def _bounded(r: Column) -> Column:
    """``r`` without the rounding that carries it beyond 1; NULL stays NULL."""
    return F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)


def _r(prefix: str) -> Column:
    """Correlation from moments; NULL when a side is constant."""
    spread = F.sqrt(F.col(f"{prefix}_vx")) * F.sqrt(F.col(f"{prefix}_vy"))
    return _bounded(F.try_divide(F.col(f"{prefix}_cov"), spread))


@dataclass(frozen=True)
class _Pair:
    """A feature and an outcome over the rows ``scope``; a partial correlation has a control as well."""

    feature: str
    outcome: str
    kind: str
    scope: frozenset
    columns: tuple[str, ...]


def _values(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """The columns as a matrix, NaN where a value is unknown."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _known_together(wide: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Rows in which both columns are known, for all pairs of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), len(columns)))
        for batch in _slices(batches):
            known = (~np.isnan(_values(batch, columns))).astype(float)
            total += known.T @ known
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size)), pa.array(total.ravel().astype(np.int64))], names=["place", "n"]
        )

    found = wide.select(*columns).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    together = np.zeros(len(columns) ** 2, dtype=np.int64)
    for row in found.collect():
        together[row.place] = row.n
    return together.reshape(len(columns), len(columns))


def _scopes(columns: Sequence[str], together: np.ndarray) -> Callable[..., frozenset]:
    """What gives a name to the rows in which some columns are all known.

    Columns known in the same rows stand for each other, and a column known wherever another one is adds
    nothing, so that pairs over the same rows share a name.
    """
    size = together.diagonal()
    least = {c: i for i, c in enumerate(columns)}
    first = [min(j for j in range(len(columns)) if together[i, j] == size[i] == size[j]) for i in range(len(columns))]

    def scope(*names: str) -> frozenset:
        kept = {first[least[c]] for c in names}
        return frozenset(i for i in kept if not any(i != j and together[i, j] == size[j] for j in kept))

    return scope


def _inside(known: np.ndarray, scopes: Sequence[frozenset]) -> list[np.ndarray]:
    return [known[:, sorted(s)].all(axis=1) for s in scopes]


def _value_ranks(wide: DataFrame, columns: Sequence[str], slots: Sequence[tuple[str, frozenset]]) -> DataFrame:
    """slot, value, cnt and rank: every column once for all pairs over the same rows.

    Equal values are counted inside slices and then by key, and only different values are put in order.
    """
    place = {c: i for i, c in enumerate(columns)}
    scopes = list(dict.fromkeys(s for _, s in slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _values(batch, columns)
            inside = dict(zip(scopes, _inside(~np.isnan(x), scopes)))
            for slot, (column, scope) in enumerate(slots):
                value, count = np.unique(x[inside[scope], place[column]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), slot, dtype=np.int32)), pa.array(value), pa.array(count.astype(np.int64))],
                    names=["slot", "value", "cnt"],
                )

    counted = wide.select(*columns).mapInArrow(run, "slot int, value double, cnt long")
    ordered = value_counts_in_order(counted, ["slot"], "value", "cnt").table
    rank = F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)
    return materialize(ordered.select("slot", "value", "cnt", rank.alias("rank")), "value-ranks")


def _rows_with_ranks(
    wide: DataFrame, columns: Sequence[str], slots: Sequence[tuple[str, frozenset]], many: Sequence[int], ranks: DataFrame
) -> DataFrame:
    """``wide`` and ``_ranks``, a list of (slot, rank) for the slots with many different values."""
    place = {c: i for i, c in enumerate(columns)}
    scopes = list(dict.fromkeys(slots[k][1] for k in many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            key, x = batch.column("_id").to_numpy(), _values(batch, columns)
            inside = dict(zip(scopes, _inside(~np.isnan(x), scopes)))
            for slot in many:
                column, scope = slots[slot]
                chosen = inside[scope]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[chosen]), pa.array(np.full(chosen.sum(), slot, dtype=np.int32)), pa.array(x[chosen, place[column]])],
                    names=["_id", "slot", "value"],
                )

    long = wide.mapInArrow(run, "_id long, slot int, value double")
    ranked = long.join(ranks.where(F.col("slot").isin(list(many))).select("slot", "value", "rank"), ["slot", "value"])
    lists = ranked.groupBy("_id").agg(F.collect_list(F.struct("slot", "rank")).alias("_ranks"))
    return wide.join(lists, "_id", "left")


def _pair_sums(
    rows: DataFrame,
    columns: Sequence[str],
    slots: Sequence[tuple[str, frozenset]],
    pairs: Sequence[_Pair],
    sizes: dict[int, tuple[int, float]],
    tables: dict[int, tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """Sums of products of centred values and centred ranks, one row per pair.

    ``sizes`` has rows and mean of each slot, ``tables`` values and ranks of the slots with few different values.
    """
    place = {c: i for i, c in enumerate(columns)}
    scopes = list(dict.fromkeys(s for _, s in slots))
    number = {slot: k for k, slot in enumerate(slots)}
    at = np.array([[number[c, p.scope] for c in (p.columns * 2)[:3]] for p in pairs])
    names = ["xy_cov", "xy_vx", "xy_vy", "rxy_cov", "rxy_vx", "rxy_vy", "rxz_cov", "rxz_vy", "ryz_cov"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(pairs)))
        for batch in _slices(batches):
            values = _values(batch, columns)
            inside = dict(zip(scopes, _inside(~np.isnan(values), scopes)))
            x, r = np.zeros((len(slots), len(values))), np.zeros((len(slots), len(values)))
            if "_ranks" in batch.schema.names:
                lists = batch.column("_ranks")
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                flat = pc.list_flatten(lists)
                r[pc.struct_field(flat, "slot").to_numpy(), owner] = pc.struct_field(flat, "rank").to_numpy()
            for k, (column, scope) in enumerate(slots):
                chosen = inside[scope]
                n, mean = sizes.get(k, (0, 0.0))
                own = values[chosen, place[column]]
                x[k, chosen] = own - mean
                if k in tables:
                    r[k, chosen] = tables[k][1][np.searchsorted(tables[k][0], own)]
                r[k, chosen] -= (n + 1) / 2
            xx, rr = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", r, r)
            for j, (a, b, c) in enumerate(at):
                total[[0, 3, 6, 8], j] += x[a] @ x[b], r[a] @ r[b], r[a] @ r[c], r[b] @ r[c]
            total[[1, 2, 4, 5, 7]] += xx[at[:, 0]], xx[at[:, 1]], rr[at[:, 0]], rr[at[:, 1]], rr[at[:, 2]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), *map(pa.array, total)], names=["pair", *names])

    parts = rows.mapInArrow(run, f"pair long, {', '.join(f'{c} double' for c in names)}")
    return parts.groupBy("pair").agg(*(F.sum(c).alias(c) for c in names))


def correlate_pairs(
    df: DataFrame,
    features: Sequence[str],
    outcomes: Sequence[str],
    control: str | None = None,
    controlled: Sequence[str] = (),
    minimum: int = 5,
    rows: int | None = None,
    upper: bool = False,
) -> DataFrame:
    """Pearson, Spearman and partial Spearman of every complete (feature, outcome) pair.

    ``upper`` keeps only pairs whose feature is listed before the outcome.

    A pair takes the rows in which both are known, its partial correlation those in which the control is known
    too.  A column is ranked once for all pairs over the same rows, and rows are not repeated for pairs.  Ranks of
    columns with at most ``rows`` different values go to the tasks as a table; others are joined to the rows.
    """
    spark = df.sparkSession
    rows = VALUES_IN_TABLE if rows is None else rows
    columns = list(dict.fromkeys([*features, *outcomes, *([control] if control else [])]))
    place = {c: i for i, c in enumerate(columns)}
    number = F.monotonically_increasing_id().alias("_id")
    wide = materialize(df.select(number, *(F.col(c).cast("double").alias(f"v{place[c]}") for c in columns)), "pairs")
    names = [f"v{i}" for i in range(len(columns))]
    scope = _scopes(names, _known_together(wide, names))

    pairs = []
    for f in dict.fromkeys(features):
        for o in dict.fromkeys(outcomes):
            if upper and place[f] >= place[o]:
                continue
            x, y = names[place[f]], names[place[o]]
            pairs.append(_Pair(f, o, "plain", scope(x, y), (x, y)))
            if control and o in controlled and f != control:
                z = names[place[control]]
                pairs.append(_Pair(f, o, "partial", scope(x, y, z), (x, y, z)))
    slots = list(dict.fromkeys((c, p.scope) for p in pairs for c in p.columns))
    number_of = {slot: k for k, slot in enumerate(slots)}

    ranks = _value_ranks(wide, names, slots)
    found = ranks.groupBy("slot").agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean"), F.count(F.lit(1)).alias("values")
    ).collect()
    sizes = {r.slot: (r.n, r["mean"]) for r in found}
    few, many = [[r.slot for r in found if (r["values"] <= rows) == small] for small in (True, False)]
    listed: dict[int, list] = {k: [] for k in few}
    for r in ranks.where(F.col("slot").isin(few)).select("slot", "value", "rank").collect():
        listed[r.slot].append((r.value, r["rank"]))
    tables = {k: tuple(np.array(sorted(v)).T) for k, v in listed.items()}
    joined = _rows_with_ranks(wide, names, slots, many, ranks) if many else wide
    sums = _pair_sums(joined, names, slots, pairs, sizes, tables)

    known = [
        (j, p.feature, p.outcome, p.kind, sizes[k][0]) for j, p in enumerate(pairs) if (k := number_of[p.columns[0], p.scope]) in sizes
    ]
    told = spark.createDataFrame(known, "pair long, feature string, outcome string, kind string, n long")
    group = ["feature", "outcome", "kind"]
    sums = told.join(sums, "pair")
    # Ranks are exact, so they and not the rounded means tell whether a side is constant.
    sums = sums.withColumns({
        "xy_vx": F.when(F.col("rxy_vx") == 0, F.lit(0.0)).otherwise(F.col("xy_vx")),
        "xy_vy": F.when(F.col("rxy_vy") == 0, F.lit(0.0)).otherwise(F.col("xy_vy")),
        "rxz_vx": F.col("rxy_vx"), "ryz_vx": F.col("rxy_vy"), "ryz_vy": F.col("rxz_vy"),
    })
    plain_only, rxy, rxz, ryz = _r("xy"), _r("rxy"), _r("rxz"), _r("ryz")
    rest = F.sqrt(1 - rxz * rxz) * F.sqrt(1 - ryz * ryz)
    partial = F.when(F.col("n") < 4, F.lit(None).cast("double")).when(
        F.col("rxz_vy") == 0, rxy
    ).otherwise(_bounded(F.try_divide(rxy - rxz * ryz, rest)))
    parts = sums.select(
        *group, "n", plain_only.alias("pearson"), rxy.alias("spearman"), partial.alias("partial")
    )

    def of(kind: str, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    table = parts.groupBy("feature", "outcome").agg(
        of("plain", "n").alias("n_samples"),
        of("plain", "spearman").alias("spearman_r"),
        of("plain", "pearson").alias("pearson_r"),
        of("partial", "partial").alias("partial_r"),
        of("partial", "n").alias("partial_n"),
    )
    table = table.where(F.col("n_samples") >= minimum)
    table = table.withColumn(
        "control_var", F.when(F.col("partial_r").isNotNull(), F.lit(control).cast("string"))
    )
    return table.withColumn("effect_size", effect_size("spearman_r"))


def with_p_values(table: DataFrame) -> DataFrame:
    """Adds p of each correlation and the significance of the rank correlation."""
    p = {
        "spearman_p": ("spearman_r", "n_samples"),
        "pearson_p": ("pearson_r", "n_samples"),
        "partial_p": ("partial_r", "partial_n"),
    }
    for name, (r, n) in p.items():
        if r in table.columns:
            table = table.withColumn(name, tails.correlation_p_column(F.col(r), F.col(n)))
    return table.withColumn("significant", F.col("spearman_p") < 0.05)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and row count of two columns, over complete rows."""
    complete = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    sums = complete.agg(F.count(F.lit(1)).alias("n_samples"), *_moments("x", "y", "xy"))
    return sums.select("n_samples", _r("xy").alias("pearson_r"))


def _ranked_columns(df: DataFrame, columns: Sequence[str], rows: int | None) -> DataFrame:
    complete = df.select(
        F.lit("all").alias("scope"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    ).na.drop()
    largest = complete.count()
    for i in range(len(columns)):
        complete = average_rank(complete, ["scope"], f"v{i}", f"r{i}", rows=rows, largest=largest)
    return complete


def spearman(df: DataFrame, x: str, y: str, rows: int | None = None) -> DataFrame:
    ranked = _ranked_columns(df, [x, y], rows)
    sums = ranked.agg(F.count(F.lit(1)).alias("n_samples"), *_moments("r0", "r1", "xy"))
    return sums.select("n_samples", _r("xy").alias("spearman_r"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, rows: int | None = None) -> DataFrame:
    """Rank correlation of x and y with the ranks of z removed from both.

    The closed form equals correlating the residuals of a regression on the ranks of z.
    """
    ranked = _ranked_columns(df, [x, y, z], rows)
    sums = ranked.agg(
        F.count(F.lit(1)).alias("n_samples"),
        *_moments("r0", "r1", "xy"),
        *_moments("r0", "r2", "xz"),
        *_moments("r1", "r2", "yz"),
    )
    rxy, rxz, ryz = _r("xy"), _r("xz"), _r("yz")
    rest = F.sqrt(1 - rxz * rxz) * F.sqrt(1 - ryz * ryz)
    value = (
        F.when(F.col("n_samples") < 4, F.lit(None).cast("double"))
        .when(F.col("xz_vy") == 0, rxy)
        .otherwise(_bounded(F.try_divide(rxy - rxz * ryz, rest)))
    )
    return sums.select("n_samples", value.alias("partial_r"))


def correlate_features(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Sentiment features against outcomes, controlled for review volume where it confounds."""
    features = [c for c in SENTIMENT_FEATURES if c in df.columns]
    outcomes = [c for c in OUTCOMES if c in df.columns]
    control = CONTROL if CONTROL in df.columns else None
    return correlate_pairs(df, features, outcomes, control, CONTROLLED_OUTCOMES, rows=rows)


def correlate_metadata(df: DataFrame, features: Sequence[str], rows: int | None = None) -> DataFrame:
    """Metadata features that vary enough against outcomes, strongest first.

    The gate is one aggregate row per feature; pairs constant on either side have no correlation
    and are left out.
    """
    from .relational import varying_columns

    present = [c for c in features if c in df.columns]
    kept = {r["feature"] for r in varying_columns(df, present).where("keep").collect()}
    outcomes = [c for c in OUTCOMES if c in df.columns]
    control = CONTROL if CONTROL in df.columns else None
    table = correlate_pairs(
        df, [c for c in present if c in kept], outcomes, control, CONTROLLED_OUTCOMES, rows=rows
    )
    return table.where(F.col("spearman_r").isNotNull() & F.col("pearson_r").isNotNull())


def correlation_summary(table: DataFrame, n: int = 15) -> DataFrame:
    """Significant correlations first, then by strength: the first ``n``."""
    return table.orderBy(
        F.col("significant").desc_nulls_last(), F.abs("spearman_r").desc_nulls_last(), "feature", "outcome"
    ).limit(n)


def count_significant(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("significant")).alias("n_significant")
    )


def validate_hypothesis(game_table: DataFrame, minimum: int = 5, rows: int | None = None) -> DataFrame:
    """Does early sentiment go with later sentiment?  One row, or none below ``minimum`` games."""
    x, y = "ea_predicted_positive_ratio", "pr_actual_positive_ratio"
    table = correlate_pairs(game_table, [x], [y], minimum=minimum, rows=rows)
    table = with_p_values(table).drop("partial_r", "partial_n", "partial_p", "control_var")
    sign = F.when(F.col("spearman_r") > 0, "positive").when(F.col("spearman_r") < 0, "negative").otherwise("none")
    return table.withColumn("verdict", verdict("spearman_r", "spearman_p")).withColumn("direction", sign)


def spearman_matrix(
    df: DataFrame, columns: Sequence[str], minimum: int = 3, rows: int | None = None
) -> DataFrame:
    """Pairwise-complete rank correlations of all column pairs.

    Each pair is ranked once and mirrored; a column goes with itself unless it is constant.
    """
    table = correlate_pairs(df, columns, columns, minimum=minimum, rows=rows, upper=True)
    above = table.select("feature", "outcome", "n_samples", "spearman_r")
    below = above.select(F.col("outcome").alias("feature"), F.col("feature").alias("outcome"), "n_samples", "spearman_r")
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    own = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(c).alias("outcome"),
            F.count(value).alias("n_samples"),
            F.when(F.min(value) < F.max(value), F.lit(1.0)).alias("spearman_r"),
        )
        for c, value in zip(columns, known)
    ]
    diagonal = df.agg(F.array(*own).alias("_own")).select(F.inline("_own")).where(F.col("n_samples") >= minimum)
    return above.unionByName(below).unionByName(diagonal)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"),
    )
