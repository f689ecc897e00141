"""Queries over trips: loading, validation, networks, carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.config import Costs, Edges, Scope
from tripweave.functions.time import hhmm_to_minutes
from tripweave.operators import business, graph, networks, validation
from tripweave.plans import sqltext as S
from tripweave.plans.registry import micros, query, rounded
from tripweave.sources import manifests, records, tables


@query(f"WITH {S.TRIPS} SELECT OP_UNIQUE_CARRIER, ORIGIN, DEST, OP_CARRIER_FL_NUM, DEP_DELAY FROM trips WHERE YEAR = 1998 AND CANCELLED = 0 AND OP_UNIQUE_CARRIER IN ('1-URGENT', '2-HIGH')")
def load_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.filtered(tables.trips(spark, sf_dir), 1998, False, ("1-URGENT", "2-HIGH")).select("OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "OP_CARRIER_FL_NUM", "DEP_DELAY")


@query("SELECT 0::BIGINT AS errors")
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.from_rows(spark, [(len(validation.schema_errors(tables.trips(spark, sf_dir))),)], "errors long")


@query(f"SELECT substr(sha256('{','.join(sorted(records.COLUMNS))}'), 1, 16) AS hash, {len(records.COLUMNS)}::BIGINT AS columns")
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = tables.trips(spark, sf_dir)
    return manifests.from_rows(spark, [(manifests.schema_hash(trips), len(trips.columns))], "hash string, columns long")


_NULLS = ("tail_num", "dep_time", "arr_time", "air_time")


@query(f"""WITH {S.TRIPS}, m AS (SELECT count(*) AS total_rows, count(*) FILTER (YEAR = 1998) AS year_matches, min(YEAR) AS year_min, max(YEAR) AS year_max, count(*) FILTER (MONTH BETWEEN 1 AND 12) AS month_valid, min(MONTH) AS month_min, max(MONTH) AS month_max,
  count(*) FILTER (CANCELLED IN (0, 1)) AS cancelled_valid, sum(CANCELLED) AS n_cancelled, count(*) FILTER (CANCELLED = 0 AND length(ORIGIN) > 0) AS origin_non_empty, count(*) FILTER (CANCELLED = 0 AND length(DEST) > 0) AS dest_non_empty,
  {', '.join(f'count(*) FILTER ({n.upper()} IS NULL) AS {n}_nulls' for n in _NULLS)}, min(DEP_DELAY) AS dep_delay_min, max(DEP_DELAY) AS dep_delay_max, min(ARR_DELAY) AS arr_delay_min, max(ARR_DELAY) AS arr_delay_max,
  {', '.join(f'count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique_{n}' for c, n in (('ORIGIN', 'origins'), ('DEST', 'dests'), ('OP_UNIQUE_CARRIER', 'carriers')))} FROM trips)
SELECT *, round(100.0 * (total_rows - year_matches) / total_rows, 6) AS year_mismatch_pct, round(100.0 * (total_rows - month_valid) / total_rows, 6) AS month_invalid_pct, round(100.0 * (total_rows - cancelled_valid) / total_rows, 6) AS cancelled_invalid_pct,
  round(100.0 * n_cancelled / total_rows, 6) AS cancellation_rate, {', '.join(f'round(100.0 * {n}_nulls / total_rows, 6) AS {n}_null_pct' for n in _NULLS)} FROM m""")
def constraint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.constraint_metrics(tables.trips(spark, sf_dir), 1998), "year_mismatch_pct", "month_invalid_pct", "cancelled_invalid_pct", "cancellation_rate", *(f"{n}_null_pct" for n in _NULLS))


@query(f"""WITH {S.TRIPS}, m AS (SELECT count(*) FILTER (CANCELLED = 1) AS n_cancelled, count(*) FILTER (CANCELLED = 0) AS n_not_cancelled, count(*) FILTER (CANCELLED = 1 AND AIR_TIME IS NULL) AS cancelled_airtime_null, count(*) FILTER (CANCELLED = 0 AND AIR_TIME > 0) AS active_airtime_positive FROM trips)
SELECT *, round(100.0 * cancelled_airtime_null / n_cancelled, 6) AS cancelled_airtime_null_pct, round(100.0 * active_airtime_positive / n_not_cancelled, 6) AS active_airtime_positive_pct FROM m""")
def air_time_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.air_time_logic(tables.trips(spark, sf_dir)), "cancelled_airtime_null_pct", "active_airtime_positive_pct")


@query(f"WITH {S.TRIPS} SELECT count(*) AS rows, min(FL_DATE)::VARCHAR AS first_date, max(FL_DATE)::VARCHAR AS last_date, count(DISTINCT OP_UNIQUE_CARRIER) + max((OP_UNIQUE_CARRIER IS NULL)::INT) AS carriers, count(DISTINCT ORIGIN) + max((ORIGIN IS NULL)::INT) AS origins, count(DISTINCT DEST) + max((DEST IS NULL)::INT) AS dests FROM trips")
def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(tables.trips(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(f"""WITH {S.TRIPS} {' UNION ALL '.join(f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS nulls, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_pct FROM trips" for c in records.COLUMNS)}""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.quality_report(tables.trips(spark, sf_dir)), "null_pct")


@query(f"""WITH {S.TRIPS} {' UNION ALL '.join(f"SELECT '{c}' AS delay, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median FROM trips" for c in ('DEP_DELAY', 'ARR_DELAY'))}""")
def delay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.delay_summary(tables.trips(spark, sf_dir)), "mean", "median")


@query(f"WITH {S.TIMED} SELECT OP_CARRIER_FL_NUM, TAIL_NUM, dep_minutes, arr_minutes, epoch_us(dep_ts) AS dep_ts, epoch_us(arr_ts) AS arr_ts FROM timed")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.timed_trips(spark, sf_dir).select("OP_CARRIER_FL_NUM", "TAIL_NUM", "dep_minutes", "arr_minutes", micros("dep_ts"), micros("arr_ts"))


@query(f"""WITH {S.TIMED} SELECT count(*) AS total_rows, count(*) FILTER (dep_ts IS NULL) AS dep_ts_nulls, count(*) FILTER (arr_ts IS NULL) AS arr_ts_nulls, count(*) FILTER (dep_minutes BETWEEN 0 AND 1439) AS dep_minutes_valid, count(*) FILTER (arr_minutes BETWEEN 0 AND 1439) AS arr_minutes_valid,
  count(*) FILTER (arr_ts < dep_ts) AS arrival_before_departure, count(*) FILTER (arr_ts::DATE > dep_ts::DATE) AS next_day_arrivals FROM timed""")
def time_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.time_metrics(tables.timed_trips(spark, sf_dir))


@query(f"WITH {S.TRIPS} SELECT DISTINCT trunc(DEP_TIME)::INT AS hhmm, trunc(DEP_TIME)::INT // 100 * 60 + trunc(DEP_TIME)::INT % 100 AS minutes FROM trips")
def hhmm_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trips(spark, sf_dir).select(F.col("DEP_TIME").cast("int").alias("hhmm")).distinct().withColumn("minutes", hhmm_to_minutes("hhmm"))


_ENDS = "ends AS (SELECT ORIGIN AS code, ORIGIN_CITY_NAME AS city, ORIGIN_STATE_NM AS state, ORIGIN_AIRPORT_ID AS airport_id FROM trips UNION ALL SELECT DEST, DEST_CITY_NAME, DEST_STATE_NM, NULL FROM trips)"
_NODES = f"{_ENDS}, nodes AS (SELECT code, min(city) AS city, min(state) AS state, min(airport_id) AS airport_id, row_number() OVER (ORDER BY code) - 1 AS node_id FROM ends WHERE code IS NOT NULL GROUP BY code)"
_MEANS = "sum(FLIGHTS) AS flight_count, round(avg(DEP_DELAY), 6) AS mean_dep_delay, round(avg(ARR_DELAY), 6) AS mean_arr_delay"


@query(f"WITH {S.TRIPS}, {_NODES} SELECT * FROM nodes")
def airport_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.airport_nodes(tables.trips(spark, sf_dir))


def _airports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trips = tables.trips(spark, sf_dir)
    return trips, networks.airport_nodes(trips)


@query(f"""WITH {S.TRIPS}, {_NODES} SELECT r.*, o.node_id AS src_id, d.node_id AS dst_id FROM (SELECT ORIGIN, DEST, {_MEANS}, round(avg(CANCELLED), 6) AS cancel_rate, round(avg(DISTANCE), 6) AS mean_distance FROM trips GROUP BY ORIGIN, DEST) r
  JOIN nodes o ON ORIGIN = o.code JOIN nodes d ON DEST = d.code""")
def airport_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(networks.airport_edges(*_airports(spark, sf_dir)), *networks.ROUTE_METRICS)


@query(f"WITH {S.TRIPS}, r AS (SELECT ORIGIN || ' → ' || DEST AS route, ORIGIN, DEST, sum(FLIGHTS) AS flight_count FROM trips GROUP BY ORIGIN, DEST) SELECT row_number() OVER (ORDER BY flight_count DESC, ORIGIN, DEST)::INT AS rank, route, flight_count FROM r ORDER BY rank LIMIT 20")
def airport_top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.top_routes(networks.route_aggregates(tables.trips(spark, sf_dir), "ORIGIN", "DEST"))


@query(f"""WITH {S.TRIPS}, r AS (SELECT ORIGIN, DEST, count(*) AS n FROM trips GROUP BY 1, 2) SELECT count(*) AS edges, count(*) FILTER (ORIGIN = DEST) AS self_loops, 0::BIGINT AS repeated, 0::BIGINT AS missing_ends, 0::BIGINT AS negative_weights FROM r""")
def edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.edge_integrity(networks.airport_edges(*_airports(spark, sf_dir)))


@query(f"""WITH {S.TRIPS}, vol AS (SELECT code, count(*) AS n FROM (SELECT ORIGIN AS code FROM trips UNION ALL SELECT DEST FROM trips) GROUP BY code ORDER BY n DESC, code LIMIT 5)
SELECT ORIGIN, DEST, count(*) AS trips FROM trips WHERE ORIGIN IN (SELECT code FROM vol) OR DEST IN (SELECT code FROM vol) GROUP BY ORIGIN, DEST""")
def top_airport_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.scope(tables.trips(spark, sf_dir), Scope("top_airports", top_airports_k=5)).groupBy("ORIGIN", "DEST").agg(F.count("*").alias("trips"))


@query(f"WITH {S.TRIPS} SELECT ORIGIN, DEST, count(*) AS trips FROM trips WHERE {S.uniform(S.KEY)} < 0.1 GROUP BY ORIGIN, DEST")
def hash_sample_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.scope(tables.trips(spark, sf_dir), Scope("sample", sample_frac=0.1)).groupBy("ORIGIN", "DEST").agg(F.count("*").alias("trips"))


@query(f"WITH {S.FLIGHTS} SELECT flight_key, flight_id, tail, carrier, origin, dest, epoch_us(dep_ts) AS dep_ts, epoch_us(arr_ts) AS arr_ts, arr_delay FROM flights")
def flight_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flights(spark, sf_dir).select("flight_key", "flight_id", "tail", "carrier", "origin", "dest", micros("dep_ts"), micros("arr_ts"), "arr_delay")


def _flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.flight_nodes(tables.timed_trips(spark, sf_dir))


_EDGE = "src_id, dst_id, edge_type, ground_time_minutes, same_carrier, tail"


@query(f"WITH {S.FLIGHTS}, {S.tail_edges('flights')} SELECT {_EDGE} FROM tail_e")
def tail_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.tail_edges(tables.kept(_flights(spark, sf_dir), "flights"))


@query(f"WITH {S.FLIGHTS}, {S.route_edges('flights', 3)} SELECT {_EDGE} FROM route_e")
def route_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.route_knn_edges(tables.kept(_flights(spark, sf_dir), "flights"), 3)


_BEST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY arrival ORDER BY minutes, dep_ts, departure) AS n FROM conn), transfer_e AS (SELECT arrival AS src_id, departure AS dst_id, 'airport_transfer_knn' AS edge_type, minutes AS ground_time_minutes, {same} AS same_carrier, NULL::VARCHAR AS tail FROM ranked WHERE n <= 2)"


@query(f"WITH {S.LEGS}, {S.connections('legs', 30, 240, True)}, {_BEST.format(same='true')} SELECT {_EDGE} FROM transfer_e")
def transfer_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.transfer_knn_edges(tables.kept(tables.legs(spark, sf_dir), "legs"), 2, True, (30, 240))


@query(f"WITH {S.LEGS}, {S.connections('legs', 30, 90, False)}, {S.tail_edges('legs')} SELECT arrival AS src_id, departure AS dst_id, 'pax' AS edge_type FROM conn UNION ALL SELECT src_id, dst_id, 'tail' FROM tail_e")
def connection_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.connection_graph(tables.kept(tables.legs(spark, sf_dir), "legs"), (30, 90))


_ALL_KINDS = f"{S.LEGS}, {S.connections('legs', 30, 240, True)}, {_BEST.format(same='true')}, {S.tail_edges('legs')}, {S.route_edges('legs', 3)}, every AS (SELECT 1 AS k, * FROM tail_e UNION ALL SELECT 2, * FROM route_e UNION ALL SELECT 3, * FROM transfer_e), one AS (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY k, ground_time_minutes) AS n FROM every)"


def _leg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.flight_edges(tables.kept(tables.legs(spark, sf_dir), "legs"), Edges(include_airport_transfer_knn=True))


@query(f"WITH {_ALL_KINDS} SELECT {_EDGE} FROM one WHERE n = 1")
def flight_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg_edges(spark, sf_dir)


@query(f"WITH {_ALL_KINDS} SELECT edge_type, count(*) AS edges FROM one WHERE n = 1 GROUP BY edge_type")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.edge_type_counts(_leg_edges(spark, sf_dir))


_LAYERS = f"{_NODES}, inside AS (SELECT OP_UNIQUE_CARRIER AS layer, ORIGIN, DEST, sum(FLIGHTS) AS flight_count, avg(DEP_DELAY) AS md, avg(ARR_DELAY) AS ma, avg(DISTANCE) AS mi FROM trips GROUP BY 1, 2, 3)"
_BETWEEN = "here AS (SELECT DISTINCT ORIGIN AS airport, OP_UNIQUE_CARRIER AS carrier FROM trips), across AS (SELECT node_id AS src_id, node_id AS dst_id, a.carrier AS src_layer, b.carrier AS dst_layer, 'inter_layer' AS edge_type, a.airport, 1::BIGINT AS transfer_count FROM here a JOIN here b ON a.airport = b.airport AND a.carrier < b.carrier JOIN nodes ON code = a.airport)"


@query(f"""WITH {S.TRIPS}, {_LAYERS}, {_BETWEEN} SELECT o.node_id AS src_id, d.node_id AS dst_id, layer AS src_layer, layer AS dst_layer, 'intra_layer' AS edge_type, ORIGIN, DEST, flight_count, round(md, 6) AS mean_dep_delay, round(ma, 6) AS mean_arr_delay, round(mi, 6) AS mean_distance, NULL::VARCHAR AS airport, NULL::BIGINT AS transfer_count
  FROM inside JOIN nodes o ON ORIGIN = o.code JOIN nodes d ON DEST = d.code UNION ALL SELECT src_id, dst_id, src_layer, dst_layer, edge_type, NULL, NULL, NULL, NULL, NULL, NULL, airport, transfer_count FROM across""")
def multilayer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(networks.multilayer_edges(*_airports(spark, sf_dir), interlayer=True), "mean_dep_delay", "mean_arr_delay", "mean_distance")


@query(f"WITH {S.TRIPS}, {_NODES}, {_BETWEEN} SELECT * FROM across")
def interlayer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.interlayer_edges(*_airports(spark, sf_dir))


@query(f"""WITH {S.TRIPS}, {_LAYERS} SELECT layer, count(*) AS edge_count, sum(flight_count) AS total_flights, round(avg(md), 6) AS avg_dep_delay, round(avg(ma), 6) AS avg_arr_delay,
  (SELECT count(DISTINCT x) FROM (SELECT ORIGIN AS x FROM inside i WHERE i.layer = o.layer UNION SELECT DEST FROM inside i WHERE i.layer = o.layer)) AS node_count FROM inside o GROUP BY layer""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(networks.layer_summary(networks.layer_edges(*_airports(spark, sf_dir))), "avg_dep_delay", "avg_arr_delay")


# Carriers

_OPS = "ops AS (SELECT OP_UNIQUE_CARRIER AS carrier, count(*) AS flight_count, avg(DEP_DELAY) FILTER (CANCELLED = 0) AS mean_dep_delay, avg(ARR_DELAY) FILTER (CANCELLED = 0) AS mean_arr_delay, sum(CANCELLED) / count(*) AS cancellation_rate, avg(DISTANCE) AS mean_distance FROM trips GROUP BY 1)"
_HUBS = """hc AS (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY n DESC, ORIGIN) AS r FROM (SELECT OP_UNIQUE_CARRIER AS carrier, ORIGIN, count(*) AS n FROM trips GROUP BY 1, 2)),
hubs AS (SELECT carrier, sum(n)::BIGINT AS total_flights, 100.0 * sum(n) FILTER (r = 1) / sum(n) AS hub_top1_pct, 100.0 * sum(n) FILTER (r <= 3) / sum(n) AS hub_top3_pct, max(ORIGIN) FILTER (r = 1) AS primary_hub, (sum(n) FILTER (r = 1))::BIGINT AS primary_hub_flights FROM hc GROUP BY carrier)"""
_COST = """c0 AS (SELECT OP_UNIQUE_CARRIER AS carrier, coalesce(sum(ARR_DELAY) FILTER (CANCELLED = 0 AND ARR_DELAY > 0), 0.0) AS total_delay_minutes, sum(CANCELLED) AS total_cancellations FROM trips GROUP BY 1),
cost AS (SELECT *, total_delay_minutes * 75 AS delay_cost, total_cancellations * 10000 AS cancellation_cost, total_delay_minutes * 75 + total_cancellations * 10000 AS total_cost FROM c0)"""
_OPS_OUT = "carrier, flight_count, round(mean_dep_delay, 6) AS mean_dep_delay, round(mean_arr_delay, 6) AS mean_arr_delay, round(cancellation_rate, 6) AS cancellation_rate, round(mean_distance, 6) AS mean_distance"
_OPS_NAMES = ("mean_dep_delay", "mean_arr_delay", "cancellation_rate", "mean_distance")
_HUB_OUT = "round(hub_top1_pct, 6) AS hub_top1_pct, round(hub_top3_pct, 6) AS hub_top3_pct, primary_hub, primary_hub_flights"


@query(f"WITH {S.TRIPS}, {_OPS} SELECT {_OPS_OUT} FROM ops")
def carrier_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(business.carrier_operations(tables.trips(spark, sf_dir)), *_OPS_NAMES)


@query(f"WITH {S.TRIPS}, {_HUBS} SELECT carrier, total_flights, {_HUB_OUT} FROM hubs")
def hub_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(business.hub_concentration(tables.trips(spark, sf_dir)), "hub_top1_pct", "hub_top3_pct")


@query(f"WITH {S.TRIPS}, {_COST} SELECT * FROM cost")
def disruption_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.disruption_cost(tables.trips(spark, sf_dir), Costs())


_COST_OUT = "total_delay_minutes, total_cancellations, delay_cost, cancellation_cost, total_cost"


@query(f"""WITH {S.NATION_GRAPH}, {S.pagerank(40, True)}, {_OPS}, {_HUBS}, {_COST} SELECT {_OPS_OUT}, {_HUB_OUT}, {_COST_OUT}, round(pagerank, 6) AS primary_hub_pagerank, in_degree AS primary_hub_betweenness
  FROM ops JOIN hubs USING (carrier) JOIN cost USING (carrier) LEFT JOIN v ON primary_hub = code LEFT JOIN pr USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS in_degree FROM e GROUP BY dst) USING (id)""")
def airline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = tables.nation_graph(spark, sf_dir)
    nations = graph.Graph(tables.kept(nations.vertices, "vertices"), tables.kept(nations.edges, "edges"))
    # The nation graph is complete, so betweenness says nothing there: in-degree stands in its place.
    centrality = graph.pagerank(nations, weighted=True).join(graph.degrees(nations), "id").join(nations.vertices, "id").select("code", "pagerank", F.col("in_degree").alias("betweenness"))
    return rounded(business.airline_summary(tables.trips(spark, sf_dir), Costs(), centrality), *_OPS_NAMES, "hub_top1_pct", "hub_top3_pct", "primary_hub_pagerank")


@query(f"WITH {S.TRIPS}, {_HUBS}, {_COST} SELECT round(corr(hub_top1_pct, delay_cost), 6) AS r_delay_cost, round(corr(hub_top1_pct, total_cost), 6) AS r_total_cost, CASE WHEN corr(hub_top1_pct, delay_cost) > 0.3 THEN 'concentration costs more' WHEN corr(hub_top1_pct, delay_cost) < -0.3 THEN 'concentration costs less' ELSE 'no clear trade-off' END AS trade_off FROM hubs JOIN cost USING (carrier)")
def hub_cost_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(business.hub_cost_correlation(business.airline_summary(tables.trips(spark, sf_dir), Costs())), "r_delay_cost", "r_total_cost")


@query(f"WITH {S.TRIPS}, {_OPS}, {_COST} SELECT count(*) AS carriers, sum(flight_count)::BIGINT AS flights, round(avg(cancellation_rate), 6) AS mean_cancellation_rate, sum(total_cost) AS total_cost, (SELECT carrier FROM ops ORDER BY flight_count DESC, carrier DESC LIMIT 1) AS largest_carrier FROM ops JOIN cost USING (carrier)")
def carrier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(business.totals(business.airline_summary(tables.trips(spark, sf_dir), Costs())), "mean_cancellation_rate")


@query(f"WITH {S.TRIPS} SELECT OP_UNIQUE_CARRIER AS carrier, {', '.join(f'count(*) FILTER (MONTH = {m}) AS m{m}' for m in range(1, 13))} FROM trips GROUP BY 1")
def carrier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = tables.trips(spark, sf_dir).groupBy(F.col("OP_UNIQUE_CARRIER").alias("carrier")).pivot("MONTH", list(range(1, 13))).agg(F.count(F.lit(1)))
    return pivot.select("carrier", *(F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"m{m}") for m in range(1, 13)))


@query("""WITH x AS (SELECT 'nation-' || s_nationkey AS step, CASE WHEN s_suppkey % 7 = 0 THEN 'figure_{n}' ELSE 'supplier-' || s_suppkey END AS name FROM supplier), p AS (SELECT DISTINCT 'supplier-' || l_suppkey AS name FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount < 0.02),
m AS (SELECT step, contains(x.name, '{') AS symbolic, p.name IS NULL AND NOT contains(x.name, '{') AS missing FROM x LEFT JOIN p USING (name)) SELECT step, count(*) AS artifacts, count(*) FILTER (missing) AS missing, round(count(*) FILTER (missing) / count(*), 6) AS missing_rate FROM m GROUP BY step""")
def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the artifacts of their nation's step (every seventh is known by a placeholder only); those with a certain kind of line are there."""
    named = F.when(F.col("s_suppkey") % 7 == 0, "figure_{n}").otherwise(F.concat(F.lit("supplier-"), "s_suppkey"))
    expected = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation-"), "s_nationkey").alias("step"), named.alias("name"))
    there = tables.table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_returnflag = 'R' and l_discount < 0.02").select(F.concat(F.lit("supplier-"), "l_suppkey").alias("name"))
    return rounded(manifests.missing_rates(manifests.inventory(expected, there)), "missing_rate")
