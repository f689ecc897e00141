"""Queries by name, each with the SQL that states what it computes (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Digits that averages and other sums of fractions are rounded to: their last ones depend on the order of adding.
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), DIGITS) for n in names})


def micros(name: str):
    """A timestamp as microseconds since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name)).alias(name)
