from __future__ import annotations

import datetime as dt

from tripweave.functions.time import add_time_features, hhmm_to_minutes, whole_minutes

DAY = dt.date(2024, 1, 15)


def _timed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "FL_DATE date, DEP_TIME int, ARR_TIME int, AIR_TIME double")
    return add_time_features(df, **kw).collect()


def test_clock_numbers_become_minutes(spark):
    df = spark.createDataFrame([(0,), (100,), (1430,), (2359,), (2400,), (None,)], "t int")
    assert [r[0] for r in df.select(hhmm_to_minutes("t")).collect()] == [0, 60, 870, 1439, 1440, None]


def test_arrival_before_departure_is_next_day(spark):
    late, same, at_midnight = _timed(spark, [(DAY, 2300, 100, 120.0), (DAY, 1000, 1200, 120.0), (DAY, 2330, 2400, 30.0)])
    assert late.arr_ts == dt.datetime(2024, 1, 16, 1, 0) and late.dep_ts == dt.datetime(2024, 1, 15, 23, 0)
    assert same.arr_ts == dt.datetime(2024, 1, 15, 12, 0)
    assert at_midnight.arr_ts == dt.datetime(2024, 1, 16, 0, 0)


def test_roll_needs_air_time_and_can_be_switched_off(spark):
    assert _timed(spark, [(DAY, 2300, 100, None)])[0].arr_ts.date() == DAY
    assert _timed(spark, [(DAY, 2300, 100, 120.0)], apply_midnight_roll=False)[0].arr_ts.date() == DAY


def test_nulls_stay_null(spark):
    row = _timed(spark, [(DAY, None, None, None)])[0]
    assert row.dep_ts is None and row.arr_ts is None


def test_string_dates(spark):
    df = spark.createDataFrame([("2024-01-15", 100, 200, 60.0), ("1/15/2024 12:00:00 AM", 100, 200, 60.0)], "FL_DATE string, DEP_TIME int, ARR_TIME int, AIR_TIME double")
    assert {r.dep_ts for r in add_time_features(df).collect()} == {dt.datetime(2024, 1, 15, 1, 0)}


def test_whole_minutes_cut_towards_zero(spark):
    a, b = dt.datetime(2024, 1, 1, 0, 0, 30), dt.datetime(2024, 1, 1, 0, 2, 29)
    row = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz").select(whole_minutes("a", "b"), whole_minutes("b", "a")).first()
    assert tuple(row) == (1, -1)
