"""Clock times as HHMM numbers, and timestamps of departure and arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hhmm_to_minutes(hhmm: Column | str) -> Column:
    """Minutes since midnight of an HHMM number (1430 is 870, 2400 is 1440); null stays null."""
    whole = (F.col(hhmm) if isinstance(hhmm, str) else hhmm).cast("int")
    return F.floor(whole / 100).cast("int") * 60 + whole % 100


def as_date(df: DataFrame, name: str) -> Column:
    """A date from a column of dates, timestamps or strings."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.try_to_date(F.col(name)), F.try_to_timestamp(F.col(name), F.lit("M/d/yyyy h:mm:ss a")).cast("date"))
    return F.col(name).cast("date")


def at_minute(day: Column, minutes: Column) -> Column:
    """Timestamp (without zone) so many minutes after the start of a day."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def add_time_features(df: DataFrame, apply_midnight_roll: bool = True) -> DataFrame:
    """Adds dep_minutes, arr_minutes, dep_ts and arr_ts from FL_DATE, DEP_TIME, ARR_TIME and AIR_TIME.

    An arrival before its departure on the clock, with time in the air, is on the next day.
    """
    df = df.withColumns({"dep_minutes": hhmm_to_minutes("DEP_TIME"), "arr_minutes": hhmm_to_minutes("ARR_TIME")})
    day = as_date(df, "FL_DATE")
    rolled = (F.col("arr_minutes") < F.col("dep_minutes")) & (F.col("AIR_TIME") > 0)
    extra = F.when(rolled, 1440).otherwise(0) if apply_midnight_roll else F.lit(0)
    return df.withColumns({"dep_ts": at_minute(day, F.col("dep_minutes")), "arr_ts": at_minute(day, F.col("arr_minutes") + extra)})


def whole_minutes(start: Column | str, end: Column | str) -> Column:
    """Minutes from start to end, cut towards zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.timestamp_diff("MINUTE", a, b)
