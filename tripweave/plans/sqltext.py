"""Common parts of the DuckDB SQL that states what each query computes."""

from __future__ import annotations

NATIONS = "nat AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"

TRIPS = f"""{NATIONS},
lines AS (
  SELECT *, (l_partkey % 24) * 60 + l_orderkey % 60 AS dm, ((l_partkey % 24) * 60 + l_orderkey % 60 + trunc(l_quantity)::BIGINT * 5) % 1440 AS am
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
trips AS (
  SELECT year(l_shipdate)::INT AS YEAR, month(l_shipdate)::INT AS MONTH, l_shipdate::DATE AS FL_DATE, o_orderpriority AS OP_UNIQUE_CARRIER, l_suppkey::VARCHAR AS TAIL_NUM,
    l_orderkey::INT AS OP_CARRIER_FL_NUM, s_nationkey::INT AS ORIGIN_AIRPORT_ID, o.n_name AS ORIGIN, 'City of ' || o.n_name AS ORIGIN_CITY_NAME, o.r_name AS ORIGIN_STATE_NM,
    d.n_name AS DEST, 'City of ' || d.n_name AS DEST_CITY_NAME, d.r_name AS DEST_STATE_NM,
    CASE WHEN l_returnflag <> 'R' THEN (dm // 60 * 100 + dm % 60)::DOUBLE END AS DEP_TIME, CASE WHEN l_returnflag <> 'R' THEN l_quantity - 25 END AS DEP_DELAY,
    CASE WHEN l_returnflag <> 'R' THEN (am // 60 * 100 + am % 60)::DOUBLE END AS ARR_TIME, CASE WHEN l_returnflag <> 'R' THEN l_quantity - 29 + l_linenumber END AS ARR_DELAY,
    (l_returnflag = 'R')::INT::DOUBLE AS CANCELLED, CASE WHEN l_returnflag <> 'R' THEN l_quantity * 5 END AS AIR_TIME, 1.0::DOUBLE AS FLIGHTS, l_extendedprice AS DISTANCE
  FROM lines JOIN nat o ON s_nationkey = o.n_nationkey JOIN nat d ON c_nationkey = d.n_nationkey)"""

TIMED = f"""{TRIPS},
clock AS (SELECT *, trunc(DEP_TIME)::INT // 100 * 60 + trunc(DEP_TIME)::INT % 100 AS dep_minutes, trunc(ARR_TIME)::INT // 100 * 60 + trunc(ARR_TIME)::INT % 100 AS arr_minutes FROM trips),
timed AS (
  SELECT *, FL_DATE::TIMESTAMP + to_minutes(dep_minutes) AS dep_ts,
    FL_DATE::TIMESTAMP + to_minutes(arr_minutes + CASE WHEN arr_minutes < dep_minutes AND AIR_TIME > 0 THEN 1440 ELSE 0 END) AS arr_ts
  FROM clock)"""

KEY = "coalesce(FL_DATE::VARCHAR, '') || '|' || coalesce(OP_UNIQUE_CARRIER, '') || '|' || coalesce(OP_CARRIER_FL_NUM::VARCHAR, '') || '|' || coalesce(ORIGIN, '') || '|' || coalesce(DEST, '') || '|' || coalesce(trunc(DEP_TIME)::INT::VARCHAR, '')"

FLIGHTS = f"""{TIMED},
keyed AS (SELECT {KEY} AS flight_key, FL_DATE, MONTH, OP_UNIQUE_CARRIER AS carrier, OP_CARRIER_FL_NUM AS flight_num, TAIL_NUM AS tail, ORIGIN AS origin, DEST AS dest, dep_ts, arr_ts, DEP_DELAY AS dep_delay, ARR_DELAY AS arr_delay, CANCELLED AS cancelled, DISTANCE AS distance, AIR_TIME AS air_time FROM timed),
firsts AS (SELECT *, row_number() OVER (PARTITION BY flight_key ORDER BY tail NULLS FIRST, arr_ts NULLS FIRST, dep_delay NULLS FIRST, arr_delay NULLS FIRST, distance NULLS FIRST, air_time NULLS FIRST, cancelled NULLS FIRST, dep_ts NULLS FIRST) AS n FROM keyed),
flights AS (SELECT * EXCLUDE (n), row_number() OVER (ORDER BY dep_ts NULLS FIRST, flight_key) - 1 AS flight_id FROM firsts WHERE n = 1)"""

LEGS = """
legs0 AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dest FROM events),
legs AS (SELECT event_id, user_id::VARCHAR AS tail, event_type AS origin, dest, 'C' || (user_id % 7)::VARCHAR AS carrier, ts AS dep_ts, ts + to_minutes(trunc(value)::INT) AS arr_ts, value - 100 AS arr_delay, 0.0::DOUBLE AS cancelled,
  row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1 AS flight_id FROM legs0)"""


def minutes(a: str, b: str) -> str:
    """Whole minutes from a to b, cut towards zero."""
    return f"trunc((epoch_us({b}) - epoch_us({a})) / 60000000)::BIGINT"


def tail_edges(flights: str) -> str:
    return f"""
tail_pairs AS (SELECT tail, flight_id, carrier, arr_ts, lead(flight_id) OVER w AS nid, lead(dep_ts) OVER w AS ndep, lead(carrier) OVER w AS ncar FROM {flights} WHERE tail IS NOT NULL AND dep_ts IS NOT NULL AND arr_ts IS NOT NULL WINDOW w AS (PARTITION BY tail ORDER BY dep_ts, flight_id)),
tail_e AS (SELECT flight_id AS src_id, nid AS dst_id, 'tail_next_leg' AS edge_type, {minutes('arr_ts', 'ndep')} AS ground_time_minutes, carrier = ncar AS same_carrier, tail FROM tail_pairs WHERE ndep > arr_ts)"""


def route_edges(flights: str, k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT flight_id, dep_ts, lead(flight_id, {i}) OVER w AS nid, lead(dep_ts, {i}) OVER w AS ndep FROM {flights} WHERE dep_ts IS NOT NULL WINDOW w AS (PARTITION BY origin, dest ORDER BY dep_ts, flight_id)" for i in range(1, k + 1))
    return f"""
route_pairs AS ({parts}),
route_e AS (SELECT flight_id AS src_id, nid AS dst_id, 'route_knn' AS edge_type, {minutes('dep_ts', 'ndep')} AS ground_time_minutes, NULL::BOOLEAN AS same_carrier, NULL::VARCHAR AS tail FROM route_pairs WHERE nid IS NOT NULL)"""


def connections(flights: str, least: int, most: int, same: bool) -> str:
    also = " AND a.carrier = d.carrier" if same else ""
    return f"""
conn AS (SELECT a.flight_id AS arrival, d.flight_id AS departure, {minutes('a.arr_ts', 'd.dep_ts')} AS minutes, d.dep_ts FROM {flights} a JOIN {flights} d ON a.dest = d.origin{also}
  AND d.dep_ts >= a.arr_ts + to_minutes({least}) AND d.dep_ts <= a.arr_ts + to_minutes({most}) AND a.flight_id <> d.flight_id)"""




def steps(key: str) -> str:
    return f"""
step0 AS (SELECT {key} AS src, lead({key}) OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS dst, month(l_shipdate) AS month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
steps AS (SELECT * FROM step0 WHERE dst IS NOT NULL AND src <> dst)"""


ROUTES = f"""{steps('l_suppkey')},
v AS (SELECT s_suppkey AS id FROM supplier),
e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM steps GROUP BY src, dst)"""

NATION_GRAPH = f"""{TRIPS},
v AS (SELECT n_nationkey::BIGINT AS id, n_name AS code, CASE WHEN n_regionkey = 0 THEN 0 ELSE n_nationkey % 3 + 1 END::BIGINT AS community FROM nation),
e AS (SELECT ORIGIN_AIRPORT_ID::BIGINT AS src, n_nationkey::BIGINT AS dst, sum(FLIGHTS) AS weight FROM trips JOIN nation ON DEST = n_name GROUP BY 1, 2)"""

DEGREES = """
deg AS (SELECT id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree, coalesce(iw, 0.0) AS in_strength, coalesce(ow, 0.0) AS out_strength FROM v
  LEFT JOIN (SELECT dst, count(*) AS i, sum(weight) AS iw FROM e GROUP BY dst) ON id = dst LEFT JOIN (SELECT src, count(*) AS o, sum(weight) AS ow FROM e GROUP BY src) ON id = src)"""


def uniform(*parts: str) -> str:
    """The draw in [0, 1) of functions.keys.uniform()."""
    return f"(('0x' || substr(md5({" || '|' || ".join(f'({p})::VARCHAR' for p in parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def pagerank(iterations: int, weighted: bool) -> str:
    """Over v and e; the table pr has id and pagerank."""
    value = "weight" if weighted else "1.0::DOUBLE"
    text = f"tr AS MATERIALIZED (SELECT src, dst, x / sum(x) OVER (PARTITION BY src) AS share FROM (SELECT src, dst, sum({value}) AS x FROM e GROUP BY src, dst)), p0 AS (SELECT id, 1 / (1 - 0.85::DOUBLE) AS r FROM v)"
    for k in range(iterations):
        text += f", p{k + 1} AS MATERIALIZED (SELECT v.id, 1 + 0.85::DOUBLE * coalesce(i, 0) AS r FROM v LEFT JOIN (SELECT dst, sum(share * r) AS i FROM tr JOIN p{k} ON src = id GROUP BY dst) ON dst = v.id)"
    return text + f", pr AS (SELECT id, r / (SELECT sum(r) FROM p{iterations}) AS pagerank FROM p{iterations})"


def betweenness(levels: int, starts: str = "true", scale: str = "1") -> str:
    """Over v and e (all distances at most `levels`); the table bt has id and betweenness, from the starts m.s that pass a test."""
    text = "arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE src <> dst), d0 AS MATERIALIZED (SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS n FROM v)"
    for k in range(levels):
        text += f", f{k} AS MATERIALIZED (SELECT s, dst AS t, {k + 1} AS d, sum(n) AS n FROM d{k} JOIN arcs ON t = src WHERE d = {k} AND NOT EXISTS (SELECT 1 FROM d{k} o WHERE o.s = d{k}.s AND o.t = dst) GROUP BY s, dst), d{k + 1} AS MATERIALIZED (SELECT * FROM d{k} UNION ALL SELECT * FROM f{k})"
    last = f"d{levels}"
    return text + f""", bt AS MATERIALIZED (SELECT v.id, coalesce(b, 0.0) * {scale} AS betweenness FROM v LEFT JOIN (SELECT m.t AS id, sum(m.n * r.n / w.n) AS b FROM {last} m JOIN {last} r ON m.t = r.s JOIN {last} w ON w.s = m.s AND w.t = r.t
  WHERE m.d + r.d = w.d AND m.s <> m.t AND r.s <> r.t AND {starts} GROUP BY m.t) x ON x.id = v.id)"""


#: Over legs: the edges along which delays spread (fe: src, dst, edge_type, p).
FLIGHT_EDGES = f"""{tail_edges('legs')}, {route_edges('legs', 3)},
fe AS MATERIALIZED (SELECT src_id AS src, dst_id AS dst, arg_min(edge_type, k) AS edge_type, CASE WHEN min(k) = 1 THEN 0.60 ELSE 0.25 END AS p FROM (SELECT 1 AS k, * FROM tail_e UNION ALL SELECT 2, * FROM route_e) GROUP BY 1, 2)"""


def spread(runs: str, edges: str = "fe") -> str:
    """Over seeded (run, id) and a table of runs: the live edges, and rc (run, id) of all that they reach from the seeds."""
    return f"""live AS MATERIALIZED (SELECT run, src, dst FROM {edges}, {runs} WHERE {uniform('42', 'run', 'src', 'dst', 'edge_type')} < p),
rc AS (SELECT run, id FROM seeded UNION SELECT rc.run, dst FROM rc JOIN live ON rc.run = live.run AND rc.id = src)"""
