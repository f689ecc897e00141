"""Networks from trip records: airports and routes, trip to trip, carrier layers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.config import Edges, Scope
from tripweave.functions.keys import dense_ids, joined_key, running, uniform
from tripweave.functions.time import whole_minutes
from tripweave.sources.shared import written

ROUTE_METRICS = {"mean_dep_delay": "DEP_DELAY", "mean_arr_delay": "ARR_DELAY", "cancel_rate": "CANCELLED", "mean_distance": "DISTANCE"}
EDGE_TYPES = ("tail_next_leg", "route_knn", "airport_transfer_knn")


# Airports and routes


def airport_nodes(trips: DataFrame) -> DataFrame:
    """(code, city, state, airport_id, node_id): each airport once, numbered from 0 by code.

    City and state are the least that any trip gives; the airport id comes from departures alone, since a trip
    has only its origin's.
    """
    ends = trips.select(F.explode(F.array(*(F.struct(F.col(f"{e}").alias("code"), F.col(f"{e}_CITY_NAME").alias("city"), F.col(f"{e}_STATE_NM").alias("state"), (F.col("ORIGIN_AIRPORT_ID") if e == "ORIGIN" else F.lit(None)).cast("int").alias("airport_id")) for e in ("ORIGIN", "DEST")))).alias("x")).select("x.*")
    nodes = ends.filter(F.col("code").isNotNull()).groupBy("code").agg(*(F.min(c).alias(c) for c in ("city", "state", "airport_id")))
    return nodes.withColumn("node_id", (F.row_number().over(Window.orderBy("code")) - 1).cast("long"))


def route_aggregates(trips: DataFrame, *keys: str, metrics: dict[str, str] = ROUTE_METRICS) -> DataFrame:
    return trips.groupBy(*keys).agg(F.sum("FLIGHTS").alias("flight_count"), *(F.avg(c).alias(n) for n, c in metrics.items()))


def with_node_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with src_id and dst_id; those at unknown codes go. Nodes are joined by value, so Spark may broadcast them if few."""
    ids = nodes.select("code", "node_id")
    src, dst = ids.toDF("ORIGIN", "src_id"), ids.toDF("DEST", "dst_id")
    return edges.join(src, "ORIGIN").join(dst, "DEST")


def airport_edges(trips: DataFrame, nodes: DataFrame, metrics: dict[str, str] = ROUTE_METRICS) -> DataFrame:
    """One row per route with the number of flights, the means of the metrics, and both ends' node ids."""
    edges = with_node_ids(route_aggregates(trips, "ORIGIN", "DEST", metrics=metrics), nodes)
    return edges.select("ORIGIN", "DEST", "flight_count", *metrics, "src_id", "dst_id")


def top_routes(edges: DataFrame, n: int = 20) -> DataFrame:
    """The n routes with most flights, by rank; of equal ones the first by name."""
    best = edges.orderBy(F.desc("flight_count"), "ORIGIN", "DEST").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("flight_count"), "ORIGIN", "DEST"))
    return best.select(rank.alias("rank"), F.concat("ORIGIN", F.lit(" → "), "DEST").alias("route"), "flight_count")


def edge_integrity(edges: DataFrame) -> DataFrame:
    """One row: edges, self loops, repeated pairs, missing ends, negative weights."""
    pairs = edges.groupBy("src_id", "dst_id").agg(F.count("*").alias("n"), F.count_if(F.col("flight_count") < 0).alias("negative"))
    missing = F.col("src_id").isNull() | F.col("dst_id").isNull()
    return pairs.agg(
        F.sum("n").alias("edges"),
        F.coalesce(F.sum(F.when(F.col("src_id") == F.col("dst_id"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing_ends"),
        F.sum("negative").alias("negative_weights"),
    )


# Trip to trip


def airport_volumes(trips: DataFrame) -> DataFrame:
    """(code, trips): departures and arrivals."""
    return trips.select(F.explode(F.array("ORIGIN", "DEST")).alias("code")).filter(F.col("code").isNotNull()).groupBy("code").agg(F.count("*").alias("trips"))


def top_airports(trips: DataFrame, k: int) -> DataFrame:
    return airport_volumes(trips).orderBy(F.desc("trips"), "code").limit(k)


def scope(trips: DataFrame, settings: Scope) -> DataFrame:
    """full: all trips; top_airports: those with an end at one of the k busiest; sample: those whose key draws below sample_frac."""
    if settings.mode == "full":
        return trips
    if settings.mode == "top_airports":
        best = F.broadcast(top_airports(trips, settings.top_airports_k).select(F.col("code").alias("_code")))  # k rows
        flagged = trips.join(best.withColumnRenamed("_code", "_o"), F.col("ORIGIN") == F.col("_o"), "left").join(best.withColumnRenamed("_code", "_d"), F.col("DEST") == F.col("_d"), "left")
        return flagged.filter("_o is not null or _d is not null").drop("_o", "_d")
    if settings.mode == "sample":
        return trips.filter(uniform(flight_key()) < settings.sample_frac)
    raise ValueError(f"unknown scope: {settings.mode}")


def flight_key() -> Column:
    """Date, carrier, number, ends and departure time; absent parts show as empty, so that no two trips meet in a null key."""
    names = ("FL_DATE", "OP_UNIQUE_CARRIER", "OP_CARRIER_FL_NUM", "ORIGIN", "DEST")
    time = F.coalesce(F.col("DEP_TIME").cast("int").cast("string"), F.lit(""))
    return joined_key(*(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names), time)


def flight_nodes(trips: DataFrame) -> DataFrame:
    """One row per flight key, numbered from 0 by departure; of trips with one key, the first by tail, arrival and delay."""
    picked = trips.select(
        flight_key().alias("flight_key"), "FL_DATE", "MONTH", F.col("OP_UNIQUE_CARRIER").alias("carrier"), F.col("OP_CARRIER_FL_NUM").alias("flight_num"), F.col("TAIL_NUM").alias("tail"),
        F.col("ORIGIN").alias("origin"), F.col("DEST").alias("dest"), "dep_ts", "arr_ts", F.col("DEP_DELAY").alias("dep_delay"), F.col("ARR_DELAY").alias("arr_delay"), F.col("CANCELLED").alias("cancelled"), F.col("DISTANCE").alias("distance"), F.col("AIR_TIME").alias("air_time"),
    )
    order = ("tail", "arr_ts", "dep_delay", "arr_delay", "distance", "air_time", "cancelled", "dep_ts")
    first = F.row_number().over(Window.partitionBy("flight_key").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return dense_ids(picked.withColumn("_n", first).filter("_n = 1").drop("_n"), F.to_date("dep_ts"), "dep_ts", "flight_key", name="flight_id")


def _edges(df: DataFrame, src: str, dst: str, kind: str, minutes: Column, same: Column, tail: Column) -> DataFrame:
    return df.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), F.lit(kind).alias("edge_type"), minutes.cast("long").alias("ground_time_minutes"), same.cast("boolean").alias("same_carrier"), tail.cast("string").alias("tail"))


def tail_edges(flights: DataFrame) -> DataFrame:
    """Each aircraft's flight to its next one, if that departs after this one's arrival; a pair that doesn't is not replaced."""
    by = Window.partitionBy("tail").orderBy("dep_ts", "flight_id")
    rows = flights.filter("tail is not null and dep_ts is not null and arr_ts is not null").select("tail", "flight_id", "carrier", "arr_ts", *(F.lead(c).over(by).alias(f"next_{c}") for c in ("flight_id", "dep_ts", "carrier")))
    return _edges(rows.filter("next_dep_ts > arr_ts"), "flight_id", "next_flight_id", "tail_next_leg", whole_minutes("arr_ts", "next_dep_ts"), F.col("carrier") == F.col("next_carrier"), F.col("tail"))


def route_knn_edges(flights: DataFrame, k: int = 3) -> DataFrame:
    """Each flight to the next k departures of its route; one sort for all k."""
    by = Window.partitionBy("origin", "dest").orderBy("dep_ts", "flight_id")
    later = F.array(*(F.struct(F.lead("flight_id", i).over(by).alias("id"), F.lead("dep_ts", i).over(by).alias("dep_ts")) for i in range(1, k + 1)))
    rows = flights.filter("dep_ts is not null").select("flight_id", "dep_ts", later.alias("later")).select("flight_id", "dep_ts", F.explode("later").alias("x")).select("flight_id", "dep_ts", F.col("x.id").alias("next_id"), F.col("x.dep_ts").alias("next_dep_ts"))
    return _edges(rows.filter("next_id is not null"), "flight_id", "next_id", "route_knn", whole_minutes("dep_ts", "next_dep_ts"), F.lit(None), F.lit(None))


def connections(flights: DataFrame, window: tuple[int, int], same_carrier_only: bool = False) -> DataFrame:
    """(arrival, departure, minutes): flights that arrive at an airport, with those that leave it within the window (both ends count).

    An interval join as an equal one: departures are dealt into buckets of the window's length, and an arrival is
    matched in the two buckets that its window can touch, so neither side is compared as a whole. The exact test follows.
    """
    least, most = window
    span = max(most - least, 1)
    minute = lambda c: F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    cols = ("airport", "carrier") if same_carrier_only else ("airport",)
    arrivals = flights.filter("arr_ts is not null").select(F.col("flight_id").alias("arrival"), F.col("dest").alias("airport"), F.col("carrier"), "arr_ts")
    first = F.floor((minute("arr_ts") + least) / span)
    arrivals = arrivals.withColumn("bucket", F.explode(F.array(first, first + 1, first + 2) if least < 0 else F.array(first, first + 1)))
    departures = flights.filter("dep_ts is not null").select(F.col("flight_id").alias("departure"), F.col("origin").alias("airport"), F.col("carrier"), "dep_ts", F.floor(minute("dep_ts") / span).alias("bucket"))
    if not same_carrier_only:
        arrivals, departures = arrivals.drop("carrier"), departures.drop("carrier")
    found = arrivals.join(departures, [*cols, "bucket"]).withColumn("minutes", whole_minutes("arr_ts", "dep_ts"))
    wait = F.col("dep_ts") - F.col("arr_ts")
    inside = (wait >= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(least))) & (wait <= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(most)))
    return found.filter(inside & (F.col("arrival") != F.col("departure"))).select("arrival", "departure", "minutes", "dep_ts")


def transfer_knn_edges(flights: DataFrame, k: int = 2, same_carrier_only: bool = True, window: tuple[int, int] = (30, 240)) -> DataFrame:
    """Each arrival to the k departures with the shortest change within the window.

    Whole minutes rise with the time of departure, so these are the first k departures of its airport from the window's start on, itself aside. Departures are numbered in
    the order of airport, time and id, together with the arrivals' earliest times, and an arrival is joined with the numbers that follow its own: k + 1 rows each, however many
    departures the window holds. Numbers are dealt by ranges, so no task orders an airport.
    """
    cols = ("airport", "carrier") if same_carrier_only else ("airport",)
    known = lambda t: t.dropna(subset=list(cols))
    least, most = (F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m)) for m in window)
    none = F.lit(None).cast("long")
    arrivals = known(flights.filter("arr_ts is not null").select(F.col("dest").alias("airport"), "carrier", (F.col("arr_ts") + least).alias("at"), none.alias("departure"), F.col("flight_id").alias("arrival")))
    departures = known(flights.filter("dep_ts is not null").select(F.col("origin").alias("airport"), "carrier", F.col("dep_ts").alias("at"), F.col("flight_id").alias("departure"), none.alias("arrival")))
    events = written(arrivals.unionByName(departures).select(*cols, "at", "departure", "arrival"), "events")
    # At one time arrivals come first: a change of just the least length counts.
    order = [*map(F.col, cols), F.col("at"), F.col("departure").asc_nulls_first(), F.col("arrival")]
    placed = written(running(events, order, n=F.col("departure").isNotNull().cast("long")), "placed")
    wanted = placed.filter("arrival is not null").select("arrival", "at", *cols, F.explode(F.sequence(F.col("n") + 1, F.col("n") + k + 1)).alias("n"))
    found = wanted.join(placed.filter("departure is not null").select("n", F.col("at").alias("dep_ts"), F.col("departure"), *(F.col(c).alias(f"_{c}") for c in cols)), "n")
    same = functools.reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in cols))
    inside = F.col("dep_ts") - F.col("at") <= most - least
    found = found.filter(same & inside & (F.col("arrival") != F.col("departure"))).withColumn("arr_ts", F.col("at") - least)
    by = Window.partitionBy("arrival").orderBy("n")  # k + 1 rows
    best = found.withColumn("_at", F.row_number().over(by)).filter(F.col("_at") <= k)
    return _edges(best, "arrival", "departure", "airport_transfer_knn", whole_minutes("arr_ts", "dep_ts"), F.lit(same_carrier_only), F.lit(None))


def _united(flights: DataFrame, settings: Edges) -> DataFrame:
    parts = []
    if settings.include_tail_sequence:
        parts.append(tail_edges(flights))
    if settings.include_same_route_knn:
        parts.append(route_knn_edges(flights, settings.route_knn_k))
    if settings.include_airport_transfer_knn:
        parts.append(transfer_knn_edges(flights, settings.airport_transfer_knn_k, settings.transfer_same_carrier_only, settings.transfer_window_minutes))
    if not parts:
        raise ValueError("no kind of edge is switched on")
    return functools.reduce(DataFrame.unionByName, parts)


def flight_edges(flights: DataFrame, settings: Edges) -> DataFrame:
    """The edges of all kinds that are switched on; a pair that several kinds give has the first kind's."""
    united = _united(flights, settings)
    place = F.array_position(F.array(*map(F.lit, EDGE_TYPES)), F.col("edge_type"))
    values = F.struct(place.alias("place"), "edge_type", "ground_time_minutes", "same_carrier", "tail")
    return united.groupBy("src_id", "dst_id").agg(F.min(values).alias("x")).select("src_id", "dst_id", "x.edge_type", "x.ground_time_minutes", "x.same_carrier", "x.tail")


def flight_edge_kinds(flights: DataFrame, settings: Edges) -> DataFrame:
    """(src_id, dst_id, edge_type) of flight_edges(): without the other columns a pair's rows are numbers, which are summed up by hashing."""
    kinds = F.array(*map(F.lit, EDGE_TYPES))
    placed = _united(flights, settings).select("src_id", "dst_id", F.array_position(kinds, F.col("edge_type")).cast("int").alias("place"))
    return placed.groupBy("src_id", "dst_id").agg(F.min("place").alias("place")).select("src_id", "dst_id", F.element_at(kinds, F.col("place")).alias("edge_type"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"))


def connection_graph(flights: DataFrame, window: tuple[int, int] = (30, 240)) -> DataFrame:
    """(src_id, dst_id, edge_type): passengers' changes within the window (pax) and aircraft's next legs (tail)."""
    pax = connections(flights, window).select(F.col("arrival").alias("src_id"), F.col("departure").alias("dst_id"), F.lit("pax").alias("edge_type"))
    return pax.unionByName(tail_edges(flights).select("src_id", "dst_id", F.lit("tail").alias("edge_type")))


# Carrier layers


def layer_edges(trips: DataFrame, nodes: DataFrame, layer: str = "OP_UNIQUE_CARRIER") -> DataFrame:
    """Routes within each carrier's layer."""
    metrics = {n: c for n, c in ROUTE_METRICS.items() if n != "cancel_rate"}
    edges = with_node_ids(route_aggregates(trips.filter(F.col(layer).isNotNull()), layer, "ORIGIN", "DEST", metrics=metrics), nodes)
    return edges.select("src_id", "dst_id", F.col(layer).alias("src_layer"), F.col(layer).alias("dst_layer"), F.lit("intra_layer").alias("edge_type"), "ORIGIN", "DEST", "flight_count", *metrics)


def interlayer_edges(trips: DataFrame, nodes: DataFrame, enabled: bool = True, layer: str = "OP_UNIQUE_CARRIER") -> DataFrame:
    """One row for each airport and each two carriers that depart there (the first by name is the source); none if not enabled."""
    at = trips.filter(F.col(layer).isNotNull()).groupBy(F.col("ORIGIN").alias("airport"), F.col(layer).alias("carrier")).count().drop("count")
    other = at.toDF("airport", "other")
    pairs = at.join(other, "airport").filter("carrier < other").join(nodes.select(F.col("code").alias("airport"), "node_id"), "airport")
    rows = pairs.select(F.col("node_id").alias("src_id"), F.col("node_id").alias("dst_id"), F.col("carrier").alias("src_layer"), F.col("other").alias("dst_layer"), F.lit("inter_layer").alias("edge_type"), "airport", F.lit(1).cast("long").alias("transfer_count"))
    return rows if enabled else rows.limit(0)


def multilayer_edges(trips: DataFrame, nodes: DataFrame, interlayer: bool = False) -> DataFrame:
    """All layers' edges, aligned by name."""
    inside = layer_edges(trips, nodes)
    return inside.unionByName(interlayer_edges(trips, nodes), allowMissingColumns=True) if interlayer else inside


def layer_summary(edges: DataFrame) -> DataFrame:
    """(layer, edge_count, total_flights, avg_dep_delay, avg_arr_delay, node_count); delays are means of the routes' means."""
    sums = edges.groupBy(F.col("src_layer").alias("layer")).agg(F.count("*").alias("edge_count"), F.sum("flight_count").alias("total_flights"), F.avg("mean_dep_delay").alias("avg_dep_delay"), F.avg("mean_arr_delay").alias("avg_arr_delay"))
    ends = edges.select(F.col("src_layer").alias("layer"), "src_id", "dst_id").unpivot("layer", ["src_id", "dst_id"], "end", "node")
    return sums.join(ends.groupBy("layer").agg(F.count_distinct("node").alias("node_count")), "layer", "left")
