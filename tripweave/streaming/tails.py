"""Aircraft's next legs from a stream of flights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "src_id long, dst_id long, tail string, ground_time_minutes long"
#: The last flight given out, and those held back, one array for each of their numbers.
_STATE = "last_id long, last_dep long, last_arr long, ids array<long>, deps array<long>, arrs array<long>"


def next_legs(flights: DataFrame, lateness: str = "6 hours", timeout: str = "2 days") -> DataFrame:
    """Edges from each flight to the aircraft's next one, as flights (flight_id, tail, dep_ts, arr_ts) come in.

    A flight is held back until the watermark (the latest departure less `lateness`) passes its departure, so flights may
    come in any order within that time; later ones are dropped. State per aircraft: the flights held back, and the last
    one before them, which goes `timeout` after its departure. The rule is that of the batch operator: the next
    departure must be later than this arrival. All times are event times, so a replay gives the same edges.
    """
    rows = flights.filter("tail is not null and dep_ts is not null and arr_ts is not null")
    rows = rows.withColumns({"dep": F.col("dep_ts").cast("timestamp"), "arr_us": F.unix_micros(F.col("arr_ts").cast("timestamp")), "dep_us": F.unix_micros(F.col("dep_ts").cast("timestamp"))})
    hold = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_id, last_dep, last_arr, ids, deps, arrs = state.get if state.exists else (None, None, None, [], [], [])
        waiting = list(zip(deps, ids, arrs, strict=True))
        if not state.hasTimedOut:
            for part in batches:
                waiting += zip(part["dep_us"].tolist(), part["flight_id"].tolist(), part["arr_us"].tolist(), strict=True)
        waiting.sort()
        now = state.getCurrentWatermarkMs()
        out = []
        while waiting and waiting[0][0] < now * 1000:
            dep, flight, arr = waiting.pop(0)
            if last_id is not None and dep > last_arr:
                out.append((last_id, flight, key[0], (dep - last_arr) // 60_000_000))
            last_id, last_dep, last_arr = flight, dep, arr
        wake = waiting[0][0] // 1000 + 1 if waiting else last_dep // 1000 + hold
        if waiting or wake > now:
            state.update((last_id, last_dep, last_arr, [w[1] for w in waiting], [w[0] for w in waiting], [w[2] for w in waiting]))
            state.setTimeoutTimestamp(max(wake, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["src_id", "dst_id", "tail", "ground_time_minutes"])

    watched = rows.withWatermark("dep", lateness).select("flight_id", "tail", "dep", "dep_us", "arr_us")
    return watched.groupBy("tail").applyInPandasWithState(step, EDGE, _STATE, "append", "EventTimeTimeout")


def volumes(flights: DataFrame, window: str = "1 hour", lateness: str = "6 hours") -> DataFrame:
    """(origin, window, flights) of each window of departure times, given out once the watermark has passed it."""
    rows = flights.filter("dep_ts is not null").withColumn("dep", F.col("dep_ts").cast("timestamp")).withWatermark("dep", lateness)
    return rows.groupBy("origin", F.window("dep", window)).agg(F.count("*").alias("flights"))
