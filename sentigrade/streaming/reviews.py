"""Streams over landed review files.

Every function takes explicit checkpoint and output folders; a restarted query continues where
its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import schemas
from ..functions.text import word_count
from ..operators.aggregates import LONG_TEXT
from ..operators.relational import clean_reviews
from ..session import read_if_present, remove_folder
from ..sources.readers import with_file_origin


def file_stream(
    spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", pattern: str | None = None, **options
) -> DataFrame:
    """Newly landed files of a folder; the schema is declared, as streams infer none."""
    reader = spark.readStream.format(kind).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", **options) -> DataFrame:
    """The files of a table that is one file or a folder of files.

    A stream takes a single file only by a pattern, so the last letter of ``path`` is made one.
    """
    path = path.rstrip("/")
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, kind, **options)


def review_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Review CSV files as they land, with game and review type from the file name."""
    stream = file_stream(
        spark,
        path,
        schemas.REVIEW_FILE,
        "csv",
        "*_reviews.csv",
        header=True,
        multiLine=True,
        escape='"',
        maxFilesPerTrigger=files_per_trigger,
    )
    return with_file_origin(stream)


def ingest(stream: DataFrame, output: str, checkpoint: str, text: str = "review_text") -> StreamingQuery:
    """Cleans the new files and appends them to a Parquet table, each file exactly once."""
    return (
        clean_reviews(stream, text)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(
    stream: DataFrame, time: str, keys: Sequence[str], text: str, keep_for: str = "30 days"
) -> DataFrame:
    """First arrival of each (keys, text); copies later than ``keep_for`` behind the watermark pass.

    The state holds a digest of the text, not the text.
    """
    return (
        stream.withColumn("text_digest", F.sha2(F.col(text), 256))
        .withWatermark(time, keep_for)
        .dropDuplicatesWithinWatermark([*keys, "text_digest"])
    )


def first_arrivals(
    stream: DataFrame, output: str, checkpoint: str, keys: Sequence[str], text: str, buckets: int = 64
) -> StreamingQuery:
    """Writes the first arrival of each (keys, text), however long ago that was, below ``output``.

    What has arrived is a table of digests in ``buckets`` folders by digest.  A batch keeps one row of each
    digest, drops those that earlier batches hold, reading only its own buckets, and writes the rest to a
    folder of its own.  A repeated batch looks at earlier batches only and overwrites its folder, so it
    gives the same rows.  Nothing is held between batches, so the span is bounded by storage alone.
    """
    schema = stream.withColumn("text_digest", F.sha2(F.col(text), 256)).select(*keys, "text_digest").schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("text_digest", F.sha2(F.col(text), 256))
        own = rows.select(*keys, "text_digest").distinct()
        own = own.withColumn("bucket", F.pmod(F.xxhash64(*keys, "text_digest"), F.lit(buckets)).cast("int"))
        if batch_id:
            past = read_if_present(spark, StructType([*schema.fields, *_PLACE]), f"{output}/arrivals")
            past = past.where(F.col("batch") < batch_id)
            same = [own[c].eqNullSafe(past[c]) for c in (*keys, "text_digest")]
            own = own.join(past, [own["bucket"] == past["bucket"], *same], "left_anti")
        path = f"{output}/arrivals/batch={batch_id}"
        own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


_PLACE = [StructField("batch", IntegerType()), StructField("bucket", IntegerType())]


def read_arrivals(spark: SparkSession, output: str, schema: str) -> DataFrame:
    """The digests that ``first_arrivals`` has written; ``schema`` names keys and text_digest."""
    fields = StructType.fromDDL(schema)
    found = read_if_present(spark, StructType([*fields.fields, *_PLACE]), f"{output}/arrivals")
    return found.select(*fields.fieldNames())


def append_stream(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


# Running means and squared deviations are kept of these values: name -> column of a scored review.
_SPREADS = {"p": "probability", "w": "_words"}

# Sums per game, review type and batch, from which the features below follow.
_SUMS = {
    "n": lambda: F.count(F.lit(1)),
    "n_predicted": lambda: F.sum("predicted"),
    "n_labelled": lambda: F.count("positive"),
    "n_positive": lambda: F.sum("positive"),
    "n_long": lambda: F.count_if(F.col("_words") > LONG_TEXT),
    "n_pos": lambda: F.count_if(F.col("predicted") == 1),
    "n_neg": lambda: F.count_if(F.col("predicted") == 0),
    "words_pos": lambda: F.sum(F.when(F.col("predicted") == 1, F.col("_words"))),
    "words_neg": lambda: F.sum(F.when(F.col("predicted") == 0, F.col("_words"))),
}


def _state_schema(game: str) -> str:
    sums = ", ".join(f"{c} bigint" for c in _SUMS)
    spreads = ", ".join(f"mean_{c} double, m2_{c} double" for c in _SPREADS)
    first = "first struct<row_id: bigint, app_id: bigint>"
    return f"{game} string, review_type string, {sums}, {spreads}, {first}"


def maintain_sentiment(
    scored: DataFrame, state: str, checkpoint: str, game: str = "game_name", compact_every: int = 50
) -> StreamingQuery:
    """Keeps per-game sums: every batch writes its own folder of partial sums below ``state``.

    A repeated batch overwrites its folder, so a retry counts nothing twice.  Every ``compact_every``
    batches the sums so far are merged, and reading starts from there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_words", word_count("review_text"))
        spreads = [
            measure.alias(f"{kind}_{c}")
            for c, source in _SPREADS.items()
            for kind, measure in (
                ("mean", F.avg(F.col(source).cast("double"))),
                ("m2", F.var_pop(F.col(source).cast("double")) * F.count(source)),
            )
        ]
        numbered = (F.col(c).cast("bigint").alias(c) for c in ("row_id", "app_id"))
        first = F.min(F.struct(*numbered)).alias("first")
        sums = rows.groupBy(game, "review_type").agg(*[make().alias(c) for c, make in _SUMS.items()], *spreads, first)
        sums.write.mode("overwrite").parquet(f"{state}/parts/batch_id={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            compact_partials(batch.sparkSession, state, batch_id, game)

    return (
        scored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _partials(spark: SparkSession, state: str, game: str, until: int | None = None) -> tuple[DataFrame, int | None]:
    """The last merged sums with the batches after them, and the batch the merged sums reach to."""
    schema = _state_schema(game)
    merged = read_if_present(spark, f"{schema}, upto bigint", f"{state}/merged")
    if until is not None:
        merged = merged.where(F.col("upto") < until)
    upto = merged.agg(F.max("upto")).first()[0]
    parts = read_if_present(spark, f"{schema}, batch_id bigint", f"{state}/parts")
    if until is not None:
        parts = parts.where(F.col("batch_id") <= until)
    if upto is None:
        return parts.drop("batch_id"), None
    rest = parts.where(F.col("batch_id") > upto).drop("batch_id")
    return merged.where(F.col("upto") == upto).drop("upto").unionByName(rest), upto


def merge_partials(partials: DataFrame, game: str = "game_name") -> DataFrame:
    """One row per game and review type.  Squared deviations are merged around the common mean."""
    keys = [game, "review_type"]
    n = F.col("n")
    means = partials.groupBy(*keys).agg(
        *[(F.sum(n * F.col(f"mean_{c}")) / F.sum("n")).alias(f"all_{c}") for c in _SPREADS]
    )
    return (
        partials.join(means, keys)
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            *[F.first(f"all_{c}").alias(f"mean_{c}") for c in _SPREADS],
            *[
                F.sum(F.col(f"m2_{c}") + n * F.pow(F.col(f"mean_{c}") - F.col(f"all_{c}"), F.lit(2.0))).alias(f"m2_{c}")
                for c in _SPREADS
            ],
            F.min("first").alias("first"),
        )
    )


def current_sentiment(spark: SparkSession, state: str, game: str = "game_name") -> DataFrame:
    """The sentiment features of each game as of the last batch, as the batch table has them."""
    sums = merge_partials(_partials(spark, state, game)[0], game)
    early = sums.where(F.col("review_type") == "early_access")
    n = F.col("n")
    pos_length = F.coalesce(F.try_divide("words_pos", "n_pos"), F.lit(0.0))
    neg_length = F.coalesce(F.try_divide("words_neg", "n_neg"), F.lit(0.0))
    later = sums.where(F.col("review_type") == "post_release").select(
        game, F.col("n").alias("pr_review_count"), F.try_divide("n_positive", "n_labelled").alias("pr_actual_positive_ratio")
    )
    features = early.select(
        game,
        F.col("first.app_id").alias("app_id"),
        n.alias("ea_review_count"),
        (F.col("n_predicted") / n).alias("ea_predicted_positive_ratio"),
        F.col("mean_p").alias("ea_avg_positive_probability"),
        F.sqrt(F.col("m2_p") / n).alias("ea_sentiment_std"),
        F.col("mean_w").alias("ea_mean_review_length"),
        F.sqrt(F.col("m2_w") / n).alias("ea_std_review_length"),
        (F.col("n_long") / n).alias("ea_long_review_ratio"),
        pos_length.alias("ea_mean_pos_review_length"),
        neg_length.alias("ea_mean_neg_review_length"),
        F.when(pos_length > 0, neg_length / pos_length).otherwise(0.0).alias("ea_neg_pos_length_ratio"),
        F.try_divide("n_positive", "n_labelled").alias("ea_actual_positive_ratio"),
    )
    return features.join(later, game, "left").withColumn("pr_review_count", F.coalesce("pr_review_count", F.lit(0)))


def compact_partials(spark: SparkSession, state: str, batch_id: int, game: str = "game_name") -> None:
    """Merges the sums up to a batch; readers start from there, the running stream goes on unchanged.

    What the merge before this one covered is deleted, so a reader that began before it can end.
    """
    partials, before = _partials(spark, state, game, batch_id)
    merge_partials(partials, game).write.mode("overwrite").parquet(f"{state}/merged/upto={batch_id}")
    if before is not None:
        covered = read_if_present(spark, f"{_state_schema(game)}, batch_id bigint", f"{state}/parts")
        for row in covered.where(F.col("batch_id") <= before).select("batch_id").distinct().collect():
            remove_folder(spark, f"{state}/parts/batch_id={row['batch_id']}")
        older = read_if_present(spark, f"{_state_schema(game)}, upto bigint", f"{state}/merged")
        for row in older.where(F.col("upto") < before).select("upto").distinct().collect():
            remove_folder(spark, f"{state}/merged/upto={row['upto']}")
