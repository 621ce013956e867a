"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_session(app_name: str = "sentigrade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    Adaptive execution measures shuffle sizes at run time: it turns small build sides into
    broadcasts, splits skewed join partitions and merges small ones.  Times are read as UTC.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the folder all executors share.

    Only a local session without that setting gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="sentigrade-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_if_present(spark: SparkSession, schema: StructType | str, path: str) -> DataFrame:
    """A Parquet folder; no rows where the folder does not exist.  A damaged one is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def store(df: DataFrame, label: str) -> Callable[[], DataFrame]:
    """Writes ``df`` to the shared folder; the result opens it anew.

    Threads that plan queries side by side each open their own, so they share no plan objects.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return lambda: spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    return store(df, label)()
