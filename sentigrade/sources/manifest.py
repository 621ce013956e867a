"""Change detection by content hash, and the build manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import block_digest, file_blocks

# Files of a raw folder that are no review sources.
NOT_TRACKED = ("game_metadata.csv", "game_success_metrics.csv")
HASH_BYTES = 64 * 1024 * 1024


def source_hashes(spark: SparkSession, *folders: str, by_content: bool = True) -> DataFrame:
    """path and md5 of every CSV file, read and hashed by the executors.

    A file is hashed as one value, which holds at most 2 GB (``tree_hashes`` has no limit).  ``by_content=False`` hashes size and
    modification time instead and reads no content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(list(folders))
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.concat_ws("/", "length", F.unix_millis("modificationTime"))
    value = F.md5("content") if by_content else F.md5(stamp)
    return files.where(~name.isin(*NOT_TRACKED)).select("path", value.alias("hash"))


def tree_hashes(spark: SparkSession, *folders: str, pattern: str = "*.csv", block_bytes: int = HASH_BYTES) -> DataFrame:
    """path and hash of every file of any size: the md5 of the md5s of its blocks, in order.

    Blocks of ``block_bytes`` are read and hashed apart, a large file by many tasks; how blocks are dealt to tasks makes no
    difference.  Only digests are brought together, 16 bytes for each block.
    """
    blocks = file_blocks(spark, folders, pattern, block_bytes).repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_digest(*place) for place in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes")))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(found, pa.string())], ["path", "block", "digest"])

    digests = blocks.mapInArrow(run, "path string, block long, digest string")
    ordered = F.array_sort(F.collect_list(F.struct("block", "digest")))
    joined = F.array_join(F.transform(ordered, lambda b: b.digest), "")
    name = F.element_at(F.split("path", "/"), -1)
    return digests.where(~name.isin(*NOT_TRACKED)).groupBy("path").agg(F.md5(joined).alias("hash"))


def manifest_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Every path with its state: same, changed, added or removed."""
    joined = current.withColumnRenamed("hash", "current_hash").join(
        stored.withColumnRenamed("hash", "stored_hash"), "path", "full"
    )
    state = (
        F.when(F.col("stored_hash").isNull(), "added")
        .when(F.col("current_hash").isNull(), "removed")
        .when(F.col("current_hash") == F.col("stored_hash"), "same")
        .otherwise("changed")
    )
    return joined.select("path", "current_hash", "stored_hash", state.alias("state"))


def is_stale(current: DataFrame, stored: DataFrame | None) -> bool:
    """True without a manifest, or when any source differs from it."""
    return stored is None or not manifest_diff(current, stored).where("state <> 'same'").isEmpty()


def write_manifest(hashes: DataFrame, rows: dict[str, int], path: str) -> None:
    """Below ``path``: ``sources`` with one JSON line for each file, ``record`` with time and row counts."""
    hashes.select("path", "hash").write.mode("overwrite").json(f"{path}/sources")
    counts = [F.lit(n).alias(name) for name, n in rows.items()]
    time = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("build_time")
    hashes.sparkSession.range(1).select(time, *counts).write.mode("overwrite").json(f"{path}/record")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest row, path and hash rows)."""
    schema = "build_time string, training_rows bigint, validation_rows bigint"
    record = spark.read.schema(schema).json(f"{path}/record")
    return record, spark.read.schema("path string, hash string").json(f"{path}/sources")


def status(spark: SparkSession, path: str, *folders: str) -> DataFrame:
    """Build time, rows, tracked files and staleness as one row."""
    record, stored = read_manifest(spark, path)
    stale = is_stale(source_hashes(spark, *folders), stored)
    tracked = stored.agg(F.count(F.lit(1)).cast("int").alias("tracked_files"))
    return record.select(
        "build_time",
        "training_rows",
        "validation_rows",
        F.lit(tracked.first()[0]).alias("tracked_files"),
        F.lit(stale).alias("is_stale"),
    )
