"""Where queries and the SQL that each must agree with are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, ctes: str = ""):
    """Registers a query under its name, with its SQL behind the common tables that it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: str | Column, digits: int) -> Column:
    """Rounded a hair above the value (as the SQL does), so that exact halves go the same way in both engines; in doubles, as the SQL's round is."""
    return F.rint(((F.col(value) if isinstance(value, str) else value) + 1e-9) * 10.0**digits) / 10.0**digits
