"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables, check_sql


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int


QUERIES: dict[str, Query] = {}
# Named sub-queries that several check texts share.
HELPERS: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a function of the tables.

    ``doubles`` lists the result columns that are rounded on both sides before comparing, because
    engines add floating-point numbers in different orders.  The library itself does not round.
    """

    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(name, run, sql, tuple(doubles.split()), digits)
        return run

    return register


def run_query(q: Query, spark: SparkSession, folder: str) -> DataFrame:
    df = q.run(Tables(spark, folder))
    half = 0.5 * 10.0**-q.digits
    return df.withColumns(
        {
            c: F.when(F.abs(F.col(c)) < half, F.lit(0.0)).otherwise(F.round(F.col(c), q.digits))
            for c in q.doubles
        }
    )


def check_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    sql = q.sql
    if q.doubles:
        half = f"5e-{q.digits + 1}"
        rounded = ", ".join(
            f"CASE WHEN abs({c}) < {half} THEN 0e0 ELSE round({c}, {q.digits}) END AS {c}" for c in q.doubles
        )
        sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
    return check_sql(sql, HELPERS)
