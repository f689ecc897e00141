"""Checks of trip records: schema, constraints, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTS = ("tinyint", "smallint", "int", "bigint")
_FLOATS = ("float", "double")
#: Required columns and the types that each may have.
REQUIRED: dict[str, tuple[str, ...]] = (
    dict.fromkeys(("YEAR", "MONTH", "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID"), _INTS)
    | {"FL_DATE": ("date", "timestamp", "timestamp_ntz", "string")}
    | dict.fromkeys(("OP_UNIQUE_CARRIER", "TAIL_NUM", "ORIGIN", "DEST"), ("string",))
    | dict.fromkeys(("DEP_DELAY", "ARR_DELAY", "AIR_TIME", "DISTANCE"), _FLOATS)
    | dict.fromkeys(("DEP_TIME", "ARR_TIME", "CANCELLED", "FLIGHTS"), _FLOATS + _INTS)
)


def schema_errors(df: DataFrame) -> list[str]:
    """What is wrong with the columns; empty if nothing is."""
    kinds = dict(df.dtypes)
    missing = [f"missing column {c}" for c in REQUIRED if c not in kinds]
    return missing + [f"column {c} is {kinds[c]}, expected one of {', '.join(allowed)}" for c, allowed in REQUIRED.items() if c in kinds and kinds[c] not in allowed]


def distinct_with_null(name: str) -> Column:
    """Number of different values, null being one."""
    return F.count_distinct(F.col(name)) + F.max(F.col(name).isNull().cast("int"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def constraint_metrics(df: DataFrame, year: int) -> DataFrame:
    """One row of counts, extremes and percentages over the whole table, in one pass."""
    c = F.col
    active = c("CANCELLED") == 0
    nulls = {f"{n.lower()}_nulls": F.count_if(c(n).isNull()) for n in ("TAIL_NUM", "DEP_TIME", "ARR_TIME", "AIR_TIME")}
    extremes = {f"{n.lower()}_{f.__name__}": f(n) for n in ("DEP_DELAY", "ARR_DELAY") for f in (F.min, F.max)}
    measures = {
        "total_rows": F.count("*"),
        "year_matches": F.count_if(c("YEAR") == year),
        "year_min": F.min("YEAR"),
        "year_max": F.max("YEAR"),
        "month_valid": F.count_if(c("MONTH").between(1, 12)),
        "month_min": F.min("MONTH"),
        "month_max": F.max("MONTH"),
        "cancelled_valid": F.count_if(c("CANCELLED").isin(0, 1)),
        "n_cancelled": F.sum("CANCELLED"),
        "origin_non_empty": F.count_if(active & (F.length("ORIGIN") > 0)),
        "dest_non_empty": F.count_if(active & (F.length("DEST") > 0)),
        **nulls,
        **extremes,
        "n_unique_origins": distinct_with_null("ORIGIN"),
        "n_unique_dests": distinct_with_null("DEST"),
        "n_unique_carriers": distinct_with_null("OP_UNIQUE_CARRIER"),
    }
    out = df.agg(*(m.alias(n) for n, m in measures.items()))
    total = c("total_rows")
    derived = {f"{n}_pct": percent(total - c(m), total) for n, m in (("year_mismatch", "year_matches"), ("month_invalid", "month_valid"), ("cancelled_invalid", "cancelled_valid"))}
    derived |= {"cancellation_rate": percent(c("n_cancelled"), total)} | {f"{n[:-1]}_pct": percent(c(n), total) for n in nulls}
    return out.select("*", *(F.coalesce(v, F.lit(0.0)).alias(n) for n, v in derived.items()))


def air_time_logic(df: DataFrame) -> DataFrame:
    """How often cancelled trips have no time in the air, and others a positive one; percentages are null without such trips."""
    cancelled, active = F.col("CANCELLED") == 1, F.col("CANCELLED") == 0
    out = df.agg(
        F.count_if(cancelled).alias("n_cancelled"),
        F.count_if(active).alias("n_not_cancelled"),
        F.count_if(cancelled & F.col("AIR_TIME").isNull()).alias("cancelled_airtime_null"),
        F.count_if(active & (F.col("AIR_TIME") > 0)).alias("active_airtime_positive"),
    )
    return out.select("*", percent(F.col("cancelled_airtime_null"), F.col("n_cancelled")).alias("cancelled_airtime_null_pct"), percent(F.col("active_airtime_positive"), F.col("n_not_cancelled")).alias("active_airtime_positive_pct"))


def time_metrics(df: DataFrame) -> DataFrame:
    """Checks of dep_minutes, arr_minutes, dep_ts and arr_ts."""
    c = F.col
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(c("dep_ts").isNull()).alias("dep_ts_nulls"),
        F.count_if(c("arr_ts").isNull()).alias("arr_ts_nulls"),
        F.count_if(c("dep_minutes").between(0, 1439)).alias("dep_minutes_valid"),
        F.count_if(c("arr_minutes").between(0, 1439)).alias("arr_minutes_valid"),
        F.count_if(c("arr_ts") < c("dep_ts")).alias("arrival_before_departure"),
        F.count_if(c("arr_ts").cast("date") > c("dep_ts").cast("date")).alias("next_day_arrivals"),
    )


def summary(df: DataFrame) -> DataFrame:
    """Rows, first and last date, and numbers of different carriers, origins and destinations."""
    return df.agg(F.count("*").alias("rows"), F.min("FL_DATE").alias("first_date"), F.max("FL_DATE").alias("last_date"), distinct_with_null("OP_UNIQUE_CARRIER").alias("carriers"), distinct_with_null("ORIGIN").alias("origins"), distinct_with_null("DEST").alias("dests"))


def quality_report(df: DataFrame) -> DataFrame:
    """(column, nulls, null_pct) of every column, from one pass."""
    counted = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counted.unpivot("_rows", list(df.columns), "column", "nulls").select("column", "nulls", percent(F.col("nulls"), F.col("_rows")).alias("null_pct"))


def delay_summary(df: DataFrame) -> DataFrame:
    """(delay, mean, median) of departure and arrival delays; medians are exact."""
    both = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("delay"), F.col(n).alias("v")) for n in ("DEP_DELAY", "ARR_DELAY")))).alias("x")).select("x.*")
    return both.groupBy("delay").agg(F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"))
