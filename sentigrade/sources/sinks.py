"""Result tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One result table; CSV has a header and writes NULL as a blank field."""
    if kind == "csv":
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.mode("overwrite").options(**kept).csv(path, header=True, nullValue="", emptyValue="", escape='"')
    else:
        df.write.mode("overwrite").format(kind).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Outcome rows as CSV in schema order, NULL as blank."""
    from .. import schemas

    names = [n for n in schemas.SUCCESS_METRICS.fieldNames() if n in df.columns]
    write_result(df.select(*names), path)


def write_dataset(df: DataFrame, path: str, name: str = "dataset") -> dict[str, int]:
    """Parquet by review type; the counts are observed while writing, without a second pass."""
    seen = Observation(name)
    observed = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("review_type") == "early_access").alias("early_access"),
        F.count_if(F.col("review_type") == "post_release").alias("post_release"),
    )
    observed.write.mode("overwrite").partitionBy("review_type").parquet(path)
    return seen.get
