"""Queries over graphs: centrality, communities, robustness, cascades, link prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.config import Edges
from tripweave.operators import cascade, communities, graph, linkpred, networks, robustness
from tripweave.operators.graph import Graph
from tripweave.plans import sqltext as S
from tripweave.plans.registry import query, rounded
from tripweave.sources import tables
from tripweave.sources.shared import alone


def _routes(spark: SparkSession, sf_dir: str) -> Graph:
    """The route graph, written once: what follows reads it several times."""
    g = tables.route_graph(spark, sf_dir)
    return Graph(g.vertices, alone(spark, "edges", lambda: g.edges))


def _nations(spark: SparkSession, sf_dir: str) -> Graph:
    g = tables.nation_graph(spark, sf_dir)
    return Graph(tables.kept(g.vertices, "vertices"), tables.kept(g.edges, "edges"))


# Centrality


@query(f"WITH {S.ROUTES}, {S.DEGREES} SELECT * FROM deg")
def degree_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(tables.route_graph(spark, sf_dir))


@query(f"WITH {S.ROUTES}, {S.DEGREES} SELECT out_degree AS degree, count(*) AS vertices FROM deg GROUP BY 1")
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_distribution(graph.degrees(tables.route_graph(spark, sf_dir)), "out_degree")


_WEAK = "both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), weak AS (SELECT id AS a, id AS b FROM v UNION SELECT a, dst FROM weak JOIN both_ways ON b = src)"
_STRONG = "reach AS (SELECT id AS a, id AS b FROM v UNION SELECT a, dst FROM reach JOIN e ON b = src), strong AS (SELECT x.a, max(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query(f"""WITH RECURSIVE {S.ROUTES}, {S.DEGREES}, {_WEAK}, {_STRONG}, w AS (SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM weak GROUP BY a) GROUP BY 1), g AS (SELECT component, count(*) AS n FROM strong GROUP BY 1)
SELECT count(*) AS vertices, sum(out_degree)::BIGINT AS edges, round(avg(in_degree), 6) AS mean_in_degree, max(in_degree) AS max_in_degree, round(avg(out_degree), 6) AS mean_out_degree, max(out_degree) AS max_out_degree,
  round(sum(out_degree) / (count(*) * (count(*) - 1)), 6) AS density, (SELECT count(*) FROM w) AS weak_components, (SELECT max(n) FROM w) AS largest_weak, (SELECT count(*) FROM g) AS strong_components, (SELECT max(n) FROM g) AS largest_strong FROM deg""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.graph_summary(_routes(spark, sf_dir)), "mean_in_degree", "mean_out_degree", "density")


#: SQL makes a fixed number of steps; on these graphs it is more than brings the ranks to rest.
_STEPS = 40


@query(f"WITH {S.ROUTES}, {S.pagerank(_STEPS, False)} SELECT id, round(pagerank, 9) AS pagerank FROM pr")
def pagerank_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_routes(spark, sf_dir)).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH {S.ROUTES}, {S.pagerank(_STEPS, True)} SELECT id, round(pagerank, 9) AS pagerank FROM pr")
def pagerank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_routes(spark, sf_dir), weighted=True).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH RECURSIVE {S.ROUTES}, {_WEAK} SELECT a AS id, min(b) AS component FROM weak GROUP BY a")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(_routes(spark, sf_dir))


@query(f"WITH RECURSIVE {S.ROUTES}, {_STRONG} SELECT a AS id, component FROM strong")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_routes(spark, sf_dir))


@query(f"WITH RECURSIVE {S.ROUTES}, {_WEAK}, c AS (SELECT a, min(b) AS component FROM weak GROUP BY a) SELECT max(n) AS lcc, count(*) AS components FROM (SELECT component, count(*) AS n FROM c GROUP BY 1)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(graph.weak_components(_routes(spark, sf_dir))).agg(F.max("size").alias("lcc"), F.count("*").alias("components"))


_LEVELS = 8


@query(f"WITH {S.ROUTES}, {S.betweenness(_LEVELS)} SELECT id, round(betweenness, 6) AS betweenness FROM bt")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.betweenness(_routes(spark, sf_dir)), "betweenness")


_SAMPLED = S.uniform("42", "'source'", "m.s")
_SCALE = f"(SELECT count(*) / count(*) FILTER ({S.uniform('42', chr(39) + 'source' + chr(39), 'id')} < 0.4) FROM v)"


@query(f"WITH {S.ROUTES}, {S.betweenness(_LEVELS, _SAMPLED + ' < 0.4', _SCALE)} SELECT id, round(betweenness, 6) AS betweenness FROM bt")
def betweenness_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.betweenness_estimate(_routes(spark, sf_dir), 0.4), "betweenness")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _routes(spark, sf_dir)
    return tables.kept(graph.degrees(g).join(rounded(graph.betweenness(g), "betweenness"), "id"), "metrics")


_METRICS = f"{S.ROUTES}, {S.DEGREES}, {S.betweenness(_LEVELS)}, met AS MATERIALIZED (SELECT deg.*, round(betweenness, 6) AS betweenness FROM deg JOIN bt USING (id))"
_NAMES = ("in_degree", "out_degree", "out_strength", "betweenness")


@query(f"WITH {_METRICS}, long AS ({' UNION ALL '.join(f'''SELECT '{m}' AS metric, id, {m}::DOUBLE AS value FROM met''' for m in _NAMES)}) SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, id)::INT AS rank, id, value FROM long QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, id) <= 20")
def top20_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_by_metric(_metrics(spark, sf_dir), "id", list(_NAMES), 20)


def _mean_rank(c: str, order: str = "") -> str:
    return f"(rank() OVER (ORDER BY {c} {order}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@query(f"""WITH {_METRICS}, r AS (SELECT id, {_mean_rank('in_strength')} / count(*) OVER () AS d, {_mean_rank('betweenness')} / count(*) OVER () AS b FROM met),
k AS (SELECT id, CASE WHEN b > 0.95 AND d > 0.95 THEN 'mega_hub' WHEN b > 0.90 AND d < 0.75 THEN 'connector' END AS kind, round(d, 6) AS degree_pct, round(b, 6) AS betweenness_pct FROM r) SELECT * FROM k""")
def connectors_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.connectors(_metrics(spark, sf_dir), "id", "in_strength", others=True), "degree_pct", "betweenness_pct")


@query(f"WITH {_METRICS} SELECT id, round(({' + '.join(_mean_rank(m, 'DESC') for m in _NAMES)}) / {len(_NAMES)}, 6) AS composite FROM met")
def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.composite_rank(_metrics(spark, sf_dir), "id", list(_NAMES)), "composite")


_COMPOSITE = f"({' + '.join(_mean_rank(m, 'DESC') for m in _NAMES)}) / {len(_NAMES)}"


@query(f"WITH {_METRICS}, c AS (SELECT *, {_COMPOSITE} AS composite FROM met) SELECT row_number() OVER (ORDER BY composite, id)::INT AS rank, id, round(composite, 6) AS composite, {', '.join(f'{m}::DOUBLE AS {m}' for m in _NAMES)} FROM c ORDER BY rank LIMIT 15")
def composite_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.composite_top(_metrics(spark, sf_dir), "id", list(_NAMES), 15)
    return rounded(found.select("rank", "id", "composite", *(F.col(m).cast("double").alias(m) for m in _NAMES)), "composite")


@query(f"WITH {_METRICS} {' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM met''' for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:])}")
def metric_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.correlations(_metrics(spark, sf_dir), list(_NAMES)), "r")


# Communities of nations, given by region


@query(f"""WITH {S.NATION_GRAPH}, i AS (SELECT count(*) AS n FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id WHERE a.community = b.community), s AS (SELECT sum(n * (n - 1)) AS p FROM (SELECT community, count(*) AS n FROM v GROUP BY 1))
SELECT round((i.n - 0.01 * p)::DOUBLE, 6) AS quality FROM i, s""")
def cpm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir)
    return rounded(communities.cpm_quality(g, g.vertices), "quality")


@query(f"""WITH {S.NATION_GRAPH}, m AS (SELECT a.community AS ca, b.community AS cb FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id), d AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM m UNION ALL SELECT cb FROM m) GROUP BY c)
SELECT round((SELECT count(*) FROM m WHERE ca = cb) / (SELECT count(*) FROM m) - sum(k * k) / pow(2 * (SELECT count(*) FROM m), 2), 6) AS modularity FROM d""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir)
    return rounded(communities.modularity(g, g.vertices), "modularity")


_MEMBERS = f"{S.NATION_GRAPH}, {S.pagerank(_STEPS, True)}, mem AS (SELECT v.id, v.community, v.code, r_name AS state, round(pagerank, 9) AS rank FROM v JOIN nat ON n_nationkey = v.id JOIN pr ON pr.id = v.id)"


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = _nations(spark, sf_dir)
    states = tables.nations(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("id"), F.col("r_name").alias("state"))
    ranks = graph.pagerank(g, weighted=True).select("id", F.round("pagerank", 9).alias("pagerank"))
    return g.vertices.select("id", "community"), g.vertices.join(states, "id").select("id", "code", "state"), ranks


_STATES = "sn AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, state) AS r FROM (SELECT community, state, count(*) AS n FROM mem GROUP BY 1, 2))"


@query(f"""WITH {_MEMBERS}, {_STATES}, top AS (SELECT community, string_agg(code, ', ' ORDER BY rank DESC, code) AS t FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY rank DESC, code) AS n FROM mem) WHERE n <= 5 GROUP BY 1)
SELECT community, count(*) AS size, any_value(t) AS top_airports, (SELECT string_agg(state, ', ' ORDER BY r) FROM sn WHERE sn.community = mem.community AND r <= 3) AS top_states FROM mem JOIN top USING (community) GROUP BY community""")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.airport_summary(*_members(spark, sf_dir))


@query(f"""WITH {_MEMBERS}, {_STATES}, top AS (SELECT community, string_agg(code, ', ' ORDER BY code) AS t FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY code) AS n FROM mem) WHERE n <= 10 GROUP BY 1),
c AS (SELECT community, count(*) AS size, any_value(t) AS sample FROM mem JOIN top USING (community) GROUP BY community)
SELECT community, size, state AS top_state, n AS top_count, sample, round(n / size, 3) AS top_share, CASE WHEN round(n / size, 3) >= 0.9 THEN 'ISOLATED' WHEN round(n / size, 3) >= 0.3 THEN 'Regional' ELSE 'Mixed' END AS label FROM c JOIN sn USING (community) WHERE r = 1""")
def geo_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.geographic_composition(*_members(spark, sf_dir)[:2])


@query(f"""WITH {S.NATION_GRAPH}, c AS (SELECT ORIGIN AS code, OP_UNIQUE_CARRIER AS carrier, count(*) AS n FROM trips WHERE ORIGIN < 'R' GROUP BY 1, 2), k AS (SELECT community, carrier, sum(n)::BIGINT AS count FROM v LEFT JOIN c USING (code) WHERE carrier IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, (sum(count) OVER (PARTITION BY community))::BIGINT AS total, row_number() OVER (PARTITION BY community ORDER BY count DESC, carrier) AS r FROM k)
SELECT d.community, carrier, count, total, round(count / total, 6) AS share FROM (SELECT DISTINCT community FROM v) d LEFT JOIN t ON d.community = t.community AND r = 1""")
def community_airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carrier with most departures from each community's nations; of nations from R on no trips are known."""
    g = _nations(spark, sf_dir)
    departures = tables.trips(spark, sf_dir).filter("ORIGIN < 'R'").groupBy(F.col("ORIGIN").alias("code"), F.col("OP_UNIQUE_CARRIER").alias("carrier")).agg(F.count("*").alias("count"))
    return rounded(communities.airline_by_community(g.vertices, g.vertices.select("id", "code"), departures), "share")


@query(f"""WITH {S.TRIPS}, c AS (SELECT ORIGIN_STATE_NM AS community, OP_UNIQUE_CARRIER AS carrier, count(*) AS count FROM trips GROUP BY 1, 2)
SELECT community, carrier, count, (sum(count) OVER (PARTITION BY community))::BIGINT AS total, round(count / sum(count) OVER (PARTITION BY community), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY community ORDER BY count DESC, carrier) = 1""")
def dominant_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.trips(spark, sf_dir).select(F.col("ORIGIN_STATE_NM").alias("community"), F.col("OP_UNIQUE_CARRIER").alias("carrier"))
    return rounded(communities.dominant(rows, "community", "carrier"), "share")


def _top(c: str) -> str:
    return f"(SELECT {c} FROM lc x WHERE x.community = lc.community AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS dominant_{c}"


@query(f"WITH {S.LEGS}, lc AS (SELECT *, event_id % 10 AS community FROM legs) SELECT community, count(*) AS size, {_top('carrier')}, {_top('origin')}, {_top('dest')} FROM lc GROUP BY community")
def flight_community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = tables.legs(spark, sf_dir).withColumnRenamed("flight_id", "id")
    flights = tables.kept(flights, "legs")
    return communities.flight_summary(flights.select("id", (F.col("event_id") % 10).alias("community")), flights)


@query()
def leiden_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.leiden_cpm(_routes(spark, sf_dir), resolution=0.1, runs=4)


@query()
def nested_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.nested(_routes(spark, sf_dir), resolution=0.1)


# Robustness

_ORDER = "ord AS (SELECT 'degree' AS strategy, 0::BIGINT AS trial, id, row_number() OVER (ORDER BY in_degree + out_degree DESC, id) AS step FROM deg)"
_STRENGTH = "SELECT 'strength' AS strategy, 0::BIGINT AS trial, id, row_number() OVER (ORDER BY in_strength + out_strength DESC, id) AS step FROM deg"
_BETWEEN = "SELECT 'betweenness' AS strategy, 0::BIGINT AS trial, id, row_number() OVER (ORDER BY round(betweenness, 9) DESC, id) AS step FROM bt"


@query(f"WITH {S.ROUTES}, {S.DEGREES}, {S.betweenness(_LEVELS)}, {_ORDER} SELECT * FROM ord UNION ALL {_STRENGTH} UNION ALL {_BETWEEN} UNION ALL SELECT 'random', 0, id, row_number() OVER (ORDER BY {S.uniform('42', '0', 'id')} DESC, id) FROM v")
def removal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _routes(spark, sf_dir)
    a, b, c, d = (robustness.removal_order(g, s) for s in ("degree", "strength", "betweenness", "random"))
    return a.union(b).union(c).union(d)


_RANDOM = f"ord AS (SELECT 'random' AS strategy, t AS trial, id, row_number() OVER (PARTITION BY t ORDER BY {S.uniform('42', 't', 'id')} DESC, id) AS step FROM v, range(0, 5) r(t))"


_POINTS = "steps_ AS MATERIALIZED (SELECT DISTINCT (n // 2) * k // 10 AS step FROM (SELECT count(*) AS n FROM v), range(0, 11) t(k))"
_SWEEP = f"""{_POINTS},
al AS MATERIALIZED (SELECT o.strategy, o.trial, s.step, o.id FROM ord o, steps_ s WHERE o.step > s.step),
un AS MATERIALIZED (SELECT DISTINCT o.strategy, o.trial, s.step, a, b FROM (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) x JOIN ord o ON o.id = a JOIN ord p ON p.id = b AND p.trial = o.trial AND p.strategy = o.strategy JOIN steps_ s ON o.step > s.step AND p.step > s.step),
rc AS (SELECT strategy, trial, step, id AS a, id AS b FROM al UNION SELECT rc.strategy, rc.trial, rc.step, rc.a, un.b FROM rc JOIN un ON rc.b = un.a AND rc.step = un.step AND rc.trial = un.trial AND rc.strategy = un.strategy),
sz AS (SELECT strategy, trial, step, max(n) AS lcc FROM (SELECT strategy, trial, step, a, count(*) AS n FROM rc GROUP BY ALL) GROUP BY ALL),
cv AS MATERIALIZED (SELECT strategy, trial, step, lcc::BIGINT AS lcc, lcc / (SELECT count(*) FROM v) AS lcc_fraction, step / (SELECT count(*) FROM v) AS fraction_removed FROM sz)"""


def _steps(g: Graph) -> list[int]:
    return robustness.sample_steps(int(g.vertices.count() * 0.5), 10)


def _targeted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Graph]:
    g = _routes(spark, sf_dir)
    return robustness.curves(g, robustness.removal_order(g, "degree"), _steps(g)), g


@query(f"WITH RECURSIVE {S.ROUTES}, {S.DEGREES}, {_ORDER}, {_SWEEP} SELECT strategy, trial, step, lcc, round(lcc_fraction, 6) AS lcc_fraction, round(fraction_removed, 6) AS fraction_removed FROM cv")
def targeted_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_targeted(spark, sf_dir)[0], "lcc_fraction", "fraction_removed")


_STRONG_SWEEP = """al AS MATERIALIZED (SELECT o.step AS at, s.step, o.id FROM ord o, steps_ s WHERE o.step > s.step),
un AS MATERIALIZED (SELECT s.step, src, dst FROM e JOIN ord o ON o.id = src JOIN ord p ON p.id = dst JOIN steps_ s ON o.step > s.step AND p.step > s.step),
rc AS (SELECT step, id AS a, id AS b FROM al UNION SELECT rc.step, a, dst FROM rc JOIN un ON b = src AND rc.step = un.step),
sz AS (SELECT step, max(n) AS lcc FROM (SELECT x.step, x.a, count(*) AS n FROM rc x JOIN rc y ON x.step = y.step AND x.a = y.b AND x.b = y.a GROUP BY ALL) GROUP BY step)"""


@query(f"""WITH RECURSIVE {S.ROUTES}, {S.DEGREES}, {_ORDER}, {_POINTS},
{_STRONG_SWEEP} SELECT 'degree' AS strategy, 0::BIGINT AS trial, step, lcc, round(lcc / (SELECT count(*) FROM v), 6) AS lcc_fraction, round(step / (SELECT count(*) FROM v), 6) AS fraction_removed FROM sz""")
def strong_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _routes(spark, sf_dir)
    return rounded(robustness.curves(g, robustness.removal_order(g, "degree"), _steps(g), strong=True), "lcc_fraction", "fraction_removed")


@query(f"WITH RECURSIVE {S.ROUTES}, {_RANDOM}, {_SWEEP} SELECT strategy, step, round(fraction_removed, 6) AS fraction_removed, round(avg(lcc_fraction), 6) AS lcc_fraction, round(stddev_samp(lcc_fraction), 6) AS lcc_std FROM cv GROUP BY strategy, step, fraction_removed")
def random_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _routes(spark, sf_dir)
    return rounded(robustness.averaged(robustness.curves(g, robustness.random_orders(g, 5), _steps(g))), "fraction_removed", "lcc_fraction", "lcc_std")


@query(f"WITH RECURSIVE {S.ROUTES}, {S.DEGREES}, {_ORDER}, {_SWEEP} SELECT strategy, step AS k, lcc, round(lcc_fraction, 6) AS lcc_fraction, round(1 - lcc / ((SELECT count(*) FROM v) - step), 6) AS disconnected_fraction, (SELECT count(*) FROM v) - step AS remaining FROM cv")
def critical_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve, g = _targeted(spark, sf_dir)
    return rounded(robustness.critical(curve, g.vertices.count()), "lcc_fraction", "disconnected_fraction")


_EFFORT = robustness.Effort(("degree", "weighted_degree", "betweenness"), trials=5, points=10, share=0.5)
_ALL_ORDERS = f"{S.ROUTES}, {S.DEGREES}, {S.betweenness(_LEVELS)}, {_ORDER.replace('ord AS', 'o1 AS')}, {_RANDOM.replace('ord AS', 'o2 AS')}, ord AS MATERIALIZED (SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL {_STRENGTH} UNION ALL {_BETWEEN}), {_SWEEP}"
_NAMED = "CASE WHEN strategy = 'random' THEN strategy ELSE 'targeted_' || strategy END AS strategy"


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.analysed(_routes(spark, sf_dir), "suppliers", _EFFORT)


@query(f"WITH RECURSIVE {_ALL_ORDERS} SELECT 'suppliers' AS graph, {_NAMED}, trial, step, lcc, round(lcc_fraction, 6) AS lcc_fraction, round(fraction_removed, 6) AS fraction_removed FROM cv")
def robustness_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_analysed(spark, sf_dir), "lcc_fraction", "fraction_removed")


_BOTH = f"{_ALL_ORDERS}, mean_cv AS MATERIALIZED (SELECT {_NAMED}, step, fraction_removed AS x, avg(lcc_fraction) AS y FROM cv GROUP BY ALL)"
_MEASURES = """seg AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS area, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS slope FROM mean_cv WINDOW w AS (PARTITION BY strategy ORDER BY step)),
ms AS (SELECT strategy, sum(area) AS auc, coalesce(min(x) FILTER (y <= 0.5), 1.0) AS critical_fraction, arg_min(slope, step) AS initial_slope, arg_max(y, step) AS final_lcc FROM seg GROUP BY 1)"""


@query(f"WITH RECURSIVE {_BOTH}, {_MEASURES} SELECT 'suppliers' AS graph, strategy, round(auc, 6) AS auc, round(critical_fraction, 6) AS critical_fraction, round(initial_slope, 6) AS initial_slope, round(final_lcc, 6) AS final_lcc FROM ms")
def robustness_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness.curve_measures(robustness.averaged(_analysed(spark, sf_dir))), "auc", "critical_fraction", "initial_slope", "final_lcc")


@query(f"WITH RECURSIVE {_BOTH}, {_MEASURES} SELECT 'suppliers' AS graph, strategy, round((SELECT auc FROM ms WHERE strategy = 'random') / auc, 6) AS ratio, round((SELECT auc FROM ms WHERE strategy = 'random') - auc, 6) AS difference FROM ms WHERE strategy <> 'random'")
def vulnerability_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness.vulnerability(robustness.curve_measures(robustness.averaged(_analysed(spark, sf_dir)))), "ratio", "difference")


# Cascades


@query(f"""WITH {S.LEGS}, p AS (SELECT arr_delay, lead(arr_delay) OVER (PARTITION BY tail ORDER BY dep_ts, flight_id) AS nx FROM legs WHERE tail IS NOT NULL AND arr_delay IS NOT NULL AND cancelled = 0)
SELECT count(*) FILTER (arr_delay >= 15 AND nx IS NOT NULL) AS delayed, count(*) FILTER (arr_delay >= 15 AND nx >= 15) AS passed_on, round(count(*) FILTER (arr_delay >= 15 AND nx >= 15) / count(*) FILTER (arr_delay >= 15 AND nx IS NOT NULL), 6) AS beta FROM p""")
def empirical_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cascade.empirical_beta(tables.legs(spark, sf_dir)), "beta")


_RUNS = 20
_FLIGHTS = f"{S.LEGS}, {S.FLIGHT_EDGES}, v AS (SELECT flight_id AS id FROM legs)"


def _seeded(runs: int) -> str:
    return f"seeded AS MATERIALIZED (SELECT run, id FROM (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY {S.uniform('42', chr(39) + 'seed' + chr(39), 'run', 'id')}, id) AS n FROM v, range(0, {runs}) r(run)) WHERE n <= greatest(1, (SELECT count(*) // 100 FROM v)))"


_CASCADES = f"{_FLIGHTS}, {_seeded(_RUNS)}, {S.spread(f'range(0, {_RUNS}) r(run)')}"


def _flight_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flights, and the edges along which their delays spread, each kind with its own probability."""
    legs = alone(spark, "legs", lambda: tables.legs(spark, sf_dir, ("arr_delay", "cancelled")).drop("event_id"))
    return legs, alone(spark, "spreading", lambda: cascade.spreading_edges(networks.flight_edge_kinds(legs, Edges())))


def _seeded_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    legs, edges = _flight_network(spark, sf_dir)
    vertices = legs.select(F.col("flight_id").alias("id"))
    return edges, alone(spark, "seeds", lambda: cascade.random_seeds(vertices, _RUNS, 0.01)), vertices


@query(f"WITH RECURSIVE {_CASCADES} SELECT run, id FROM rc")
def cascade_live_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.cascades(*_seeded_network(spark, sf_dir)[:2])


@query(f"""WITH RECURSIVE {_FLIGHTS}, {_seeded(3)}, live AS MATERIALIZED (SELECT run, src, dst FROM fe, range(0, 3) r(run) WHERE {S.uniform('42', 'run', 'src', 'dst', 'edge_type')} < p),
rc(run, id, level, parent) USING KEY (run, id) AS (SELECT run, id, 0::BIGINT, NULL::BIGINT FROM seeded UNION SELECT rc.run, dst, any_value(level) + 1, min(src) FROM rc JOIN live ON rc.run = live.run AND rc.id = src WHERE NOT EXISTS (SELECT 1 FROM recurring.rc k WHERE k.run = rc.run AND k.id = dst) GROUP BY rc.run, dst) SELECT run, id, level, parent FROM rc""")
def cascade_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which flight each delayed one was reached first, and over how many edges."""
    legs, edges = _flight_network(spark, sf_dir)
    seeds = cascade.random_seeds(legs.select(F.col("flight_id").alias("id")), 3, 0.01)
    return cascade.cascades(edges, seeds, parents=True)


_SIZES = "cs AS (SELECT run, count(*) AS c FROM rc GROUP BY run)"


@query(f"WITH RECURSIVE {_CASCADES}, {_SIZES} SELECT run, (SELECT count(*) FROM seeded s WHERE s.run = cs.run) AS seed_size, c AS cascade_size, round(c / (SELECT count(*) FROM v), 6) AS fraction_delayed FROM cs")
def cascade_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sizes(spark, sf_dir), "fraction_delayed")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds, vertices = _seeded_network(spark, sf_dir)
    return cascade.counted_sizes(edges, seeds, vertices.count())


@query(f"WITH RECURSIVE {_CASCADES}, {_SIZES}, n AS (SELECT count(*) AS n FROM v) SELECT count(*) AS runs, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, min(c) AS min, max(c) AS max, {', '.join(f'round(quantile_cont(c, {p / 100}), 6) AS p{p}' for p in (50, 90, 99))}, round(avg(c / n), 6) AS mean_fraction, round(quantile_cont(c / n, 0.99), 6) AS p99_fraction FROM cs, n")
def cascade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cascade.cascade_statistics(_sizes(spark, sf_dir)), "mean", "std", "p50", "p90", "p99", "mean_fraction", "p99_fraction")


@query(f"WITH {S.LEGS} SELECT flight_id AS id FROM legs WHERE origin = 'click' AND hour(dep_ts) = 6 AND minute(dep_ts) = 0")
def scenario_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.scheduled_seeds(tables.legs(spark, sf_dir), "click", 6)


_STARTS = f"""busy AS (SELECT origin FROM legs WHERE origin IS NOT NULL GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 20),
starts AS MATERIALIZED (SELECT origin AS start, flight_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY {S.uniform('42', 'flight_id')}, flight_id) AS n FROM legs) WHERE n <= 100 AND origin IN (SELECT origin FROM busy))"""


def _influence(runs: int) -> str:
    """Over starts (start, id): the table inf with the mean size of the cascades from each."""
    return f"""runs AS MATERIALIZED (SELECT DISTINCT start, start::VARCHAR || ':' || t AS run FROM starts, range(0, {runs}) r(t)), seeded AS MATERIALIZED (SELECT DISTINCT run, id FROM starts JOIN runs USING (start)),
{S.spread('runs')}, inf AS (SELECT start, avg(n) AS influence FROM (SELECT run, count(*) AS n FROM rc GROUP BY run) JOIN runs USING (run) GROUP BY start)"""


@query(f"WITH RECURSIVE {S.LEGS}, {S.FLIGHT_EDGES}, {_STARTS}, {_influence(5)} SELECT row_number() OVER (ORDER BY influence DESC, start)::INT AS rank, start, round(influence, 6) AS influence FROM inf ORDER BY rank LIMIT 20")
def airport_superspreaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cascades from up to 100 flights out of each of the 20 busiest airports."""
    legs, edges = _flight_network(spark, sf_dir)
    return rounded(cascade.spreaders(edges, cascade.sampled_seeds(legs.filter("origin is not null"), 20, 100), runs=5, top=20), "influence")


_LONE = f"starts AS MATERIALIZED (SELECT id AS start, id FROM (SELECT id, row_number() OVER (ORDER BY {S.uniform('42', chr(39) + 'seed' + chr(39), '0', 'id')}, id) AS n FROM v) WHERE n <= least((SELECT count(*) FROM v), greatest(20, (SELECT count(*) // 1000 FROM v))))"


@query(f"WITH RECURSIVE {_FLIGHTS}, {_LONE}, {_influence(5)} SELECT id, round(coalesce(influence, 0.0), 6) AS influence FROM v LEFT JOIN inf ON id = start")
def flight_superspreaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cascades from a sample of flights, each alone; 0 for the others."""
    legs, edges = _flight_network(spark, sf_dir)
    return rounded(cascade.flight_spreaders(edges, legs.select(F.col("flight_id").alias("id")), runs=5, share=0.001, least=20), "influence")


_SUPPLIERS = f"""{_METRICS}, fe AS MATERIALIZED (SELECT src, dst, 'route_knn' AS edge_type, 0.02 AS p FROM e), {_LONE.replace('greatest(20, (SELECT count(*) // 1000 FROM v))', 'greatest(50, (SELECT count(*) // 100 FROM v))')}, {_influence(3)},
a AS (SELECT id FROM v LEFT JOIN inf ON id = start ORDER BY coalesce(influence, 0) DESC, id LIMIT 20), b AS (SELECT id FROM met ORDER BY betweenness DESC, id LIMIT 20)"""


@query(f"WITH RECURSIVE {_SUPPLIERS} SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b FROM a FULL JOIN b ON a.id = b.id")
def top20_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 suppliers whose delays spread most against the 20 of greatest betweenness."""
    g = _routes(spark, sf_dir)
    edges = tables.kept(g.edges.select("src", "dst", F.lit("route_knn").alias("edge_type"), F.lit(0.02).alias("p")), "spreading")
    influence = cascade.flight_spreaders(edges, g.vertices, runs=3, share=0.01, least=50)
    between = rounded(graph.betweenness(g), "betweenness")
    a, b = (df.orderBy(F.desc(c), "id").limit(20) for df, c in ((influence, "influence"), (between, "betweenness")))
    return cascade.overlap(a, b, "id")


@query(f"WITH RECURSIVE {_SUPPLIERS} SELECT count(*) AS shared, round(count(*) / 20, 6) AS rate FROM a JOIN b USING (id)")
def overlap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cascade.overlap_rate(top20_overlap(spark, sf_dir)), "rate")


@query(f"WITH RECURSIVE {_CASCADES}, {_SIZES}, g AS (SELECT run % 4 AS scenario, sum(c)::BIGINT AS total, round(avg(c), 6) AS mean, max(c) AS most, count(*) AS runs FROM cs GROUP BY 1) SELECT row_number() OVER (ORDER BY total DESC, scenario)::INT AS rank, * FROM g")
def superspreader_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cascade.rolled_up(_sizes(spark, sf_dir).withColumn("scenario", F.col("run") % 4), "scenario"), "mean")


@query(f"WITH RECURSIVE {_CASCADES}, {_SIZES} SELECT c AS cascade_size, count(*) AS runs FROM cs GROUP BY 1")
def cascade_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).groupBy("cascade_size").agg(F.count("*").alias("runs"))


@query(f"WITH {S.ROUTES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM e GROUP BY 1, 2")
def undirected_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.route_graph(spark, sf_dir).undirected()


@query(f"WITH {S.NATION_GRAPH}, b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT src, dst, CASE WHEN src = dst THEN sum(weight) / 2 ELSE sum(weight) END AS weight FROM b GROUP BY src, dst")
def symmetrized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nation_graph(spark, sf_dir).symmetrized()


# Link prediction

_TRAIN, _TEST = tuple(range(1, 10)), (10, 11, 12)
#: SQL makes a fixed number of draws, which on this sparse graph are more than are taken.
_SPLIT = f"""{S.steps('l_partkey')}, rt AS (SELECT month, lpad(src::VARCHAR, 9, '0') AS o, lpad(dst::VARCHAR, 9, '0') AS d FROM steps), tr0 AS (SELECT DISTINCT o, d FROM rt WHERE month <= 9), te0 AS (SELECT DISTINCT o, d FROM rt WHERE month >= 10),
nd AS MATERIALIZED (SELECT code, row_number() OVER (ORDER BY code) - 1 AS id FROM (SELECT o AS code FROM tr0 UNION SELECT d FROM tr0 UNION SELECT o FROM te0 UNION SELECT d FROM te0)),
tr AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM tr0 JOIN nd a ON o = a.code JOIN nd b ON d = b.code), nw AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM (SELECT * FROM te0 EXCEPT SELECT * FROM tr0) JOIN nd a ON o = a.code JOIN nd b ON d = b.code),
nn AS (SELECT count(*) AS n, (SELECT count(*) FROM nw) AS w FROM nd), dr AS MATERIALIZED (SELECT k, floor({S.uniform('42', "'u'", 'k')} * n)::BIGINT AS u, floor({S.uniform('42', "'v'", 'k')} * n)::BIGINT AS v FROM nn, range(0, (SELECT 4 * count(*) + 1000 FROM nw)) t(k)),
neg AS MATERIALIZED (SELECT u, v FROM dr WHERE u <> v AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.u = dr.u AND tr.v = dr.v) AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.u = dr.u AND nw.v = dr.v) GROUP BY u, v ORDER BY min(k) LIMIT (SELECT 2 * count(*) FROM nw))"""
_SCORES = """prs AS (SELECT u, v, 1::BIGINT AS label FROM nw UNION ALL SELECT u, v, 0 FROM neg), dg AS (SELECT u, count(*) AS k FROM tr GROUP BY u),
cm AS (SELECT p.u, p.v, count(*) AS cn, sum(CASE WHEN k > 1 THEN 1 / ln(k) ELSE 0 END) AS aa FROM prs p JOIN tr a ON a.u = p.u JOIN tr b ON b.u = p.v AND b.v = a.v LEFT JOIN dg ON dg.u = a.v GROUP BY p.u, p.v),
sc AS MATERIALIZED (SELECT p.u, p.v, label, coalesce(cn, 0)::DOUBLE AS common_neighbors, CASE WHEN coalesce(x.k, 0) + coalesce(y.k, 0) - coalesce(cn, 0) > 0 THEN coalesce(cn, 0) / (coalesce(x.k, 0) + coalesce(y.k, 0) - coalesce(cn, 0)) ELSE 0.0 END AS jaccard, round(coalesce(aa, 0.0), 9) AS adamic_adar, (coalesce(x.k, 0) * coalesce(y.k, 0))::DOUBLE AS preferential_attachment
  FROM prs p LEFT JOIN cm ON cm.u = p.u AND cm.v = p.v LEFT JOIN dg x ON x.u = p.u LEFT JOIN dg y ON y.u = p.v)"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return linkpred.month_split(tables.part_trips(spark, sf_dir), _TRAIN, _TEST)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, train, new = _split(spark, sf_dir)
    pairs = new.withColumn("label", F.lit(1).cast("long")).union(linkpred.negatives(nodes, train, new, 2).withColumn("label", F.lit(0).cast("long")))
    return linkpred.heuristics(pairs, train).withColumn("adamic_adar", F.round("adamic_adar", 9))


@query(f"WITH {_SPLIT} SELECT 'train' AS part, u, v FROM tr UNION ALL SELECT 'new', u, v FROM nw")
def month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, new = _split(spark, sf_dir)
    return train.select(F.lit("train").alias("part"), "u", "v").union(new.select(F.lit("new"), "u", "v"))


@query(f"WITH {_SPLIT} SELECT u, v FROM neg")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkpred.negatives(*_split(spark, sf_dir), ratio=2)


@query(f"WITH {_SPLIT}, {_SCORES} SELECT u, v, label, common_neighbors, round(jaccard, 6) AS jaccard, round(adamic_adar, 6) AS adamic_adar, preferential_attachment FROM sc")
def pair_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir), "jaccard", "adamic_adar")


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS method, label, {m} AS s FROM sc" for m in linkpred.HEURISTICS)


@query(f"""WITH {_SPLIT}, {_SCORES}, lg AS ({_LONG}), g AS (SELECT method, s, sum(label) AS p, count(*) - sum(label) AS n FROM lg GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY method ORDER BY s DESC))
SELECT method, sum(p)::BIGINT AS positives, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS ap FROM c GROUP BY method""")
def heuristic_auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkpred.auc_ap(_scored(spark, sf_dir), list(linkpred.HEURISTICS)), "auc", "ap")


@query(f"WITH {_SPLIT}, {_SCORES}, t AS (SELECT * FROM sc ORDER BY round(adamic_adar, 6) DESC, u, v LIMIT 100) SELECT round(avg((u < 10 OR v < 10)::INT), 6) AS share FROM t")
def prediction_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the best predictions that touch one of ten named nodes."""
    best = linkpred.top_predictions(rounded(_scored(spark, sf_dir), "adamic_adar"), 100, "adamic_adar")
    return rounded(linkpred.touching(best, (F.col("u") < 10) | (F.col("v") < 10)), "share")


@query(f"WITH {_SPLIT}, {_SCORES} SELECT row_number() OVER (ORDER BY round(adamic_adar, 6) DESC, u, v)::INT AS rank, u, v, round(adamic_adar, 6) AS score FROM sc ORDER BY rank LIMIT 100")
def top_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkpred.top_predictions(rounded(_scored(spark, sf_dir), "adamic_adar"), 100, "adamic_adar")


# Vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("WITH p AS (SELECT a.vec_id AS u, b.vec_id AS v, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT u, v, round(list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2]))), 5) AS l1, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 6) AS l2, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8), 6) AS cosine, round(x[1] * y[1], 9) AS first FROM p")
def embedding_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _vectors(spark, sf_dir)
    found = linkpred.pair_features(table.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), table)
    return found.select("u", "v", F.round("l1", 5).alias("l1"), F.round("l2", 6).alias("l2"), F.round("cosine", 6).alias("cosine"), F.round(F.col("hadamard")[0], 9).alias("first"))


@query("WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8), 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) SELECT query, neighbor, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbor)::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbor) <= 10")
def cosine_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a stated query; all are searched."""
    table = _vectors(spark, sf_dir)
    return rounded(linkpred.neighbors(table, table.filter("id % 20 = 0"), 10), "similarity")


@query("WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT count(*) AS vectors, round(min(n), 6) AS least, round(avg(n), 6) AS mean, round(max(n), 6) AS most, count(*) FILTER (n < 1e-6) AS near_zero FROM n")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkpred.vector_norms(_vectors(spark, sf_dir)), "least", "mean", "most")


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.kept(linkpred.walks(_routes(spark, sf_dir), walk_length=20, num_walks=5), "walks")


@query(f"""WITH RECURSIVE {S.ROUTES}, cum AS MATERIALIZED (SELECT src, dst, weight, sum(weight) OVER (PARTITION BY src ORDER BY dst) AS upto, sum(weight) OVER (PARTITION BY src) AS total FROM e),
w AS (SELECT t AS walk, id AS start, 0::BIGINT AS step, id AS vertex FROM v, range(0, 5) r(t) UNION ALL SELECT walk, start, step + 1, dst FROM w JOIN cum ON src = vertex AND upto > {S.uniform('42', 'walk', 'start', 'step + 1')} * total AND upto - weight <= {S.uniform('42', 'walk', 'start', 'step + 1')} * total WHERE step < 19) SELECT walk, start, step, vertex FROM w""")
def node2vec_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir).select("walk", "start", F.posexplode("path").alias("step", "vertex")).withColumn("step", F.col("step").cast("long"))


@query()
def skip_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkpred.skip_gram(_walks(spark, sf_dir), dimensions=16, window=5, iterations=2)


@query()
def linkpred_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and AP of logistic regression on vectors and heuristics; routes of months 1 to 6 train, months 7 to 9 label, months 10 to 12 test."""
    trips = tables.kept(tables.part_trips(spark, sf_dir), "trips")
    nodes = trips.select(F.explode(F.array("ORIGIN", "DEST")).alias("code")).distinct()
    nodes = tables.kept(nodes.withColumn("id", F.col("code").cast("long")), "nodes")
    parts = {}
    for name, before, months in (("train", tuple(range(1, 7)), (7, 8, 9)), ("test", _TRAIN, _TEST)):
        codes, known, new = linkpred.month_split(trips, before, months)
        known, new, codes = (tables.kept(df, name) for df in (known, new, codes))
        pairs = new.withColumn("label", F.lit(1).cast("long")).union(linkpred.negatives(codes, known, new, 1).withColumn("label", F.lit(0).cast("long")))
        g = Graph(codes.select("id"), known.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight")))
        table = linkpred.skip_gram(tables.kept(linkpred.walks(g, walk_length=20, num_walks=5), "walks"), dimensions=16, window=5, iterations=2)
        parts[name] = tables.kept(linkpred.heuristics(linkpred.pair_features(pairs, table), known), name)
    scored = linkpred.predict(linkpred.fit(parts["train"], iterations=50), parts["test"])
    return rounded(linkpred.auc_ap(scored, ["score", *linkpred.HEURISTICS]), "auc", "ap")


@query(f"WITH {S.LEGS}, {S.FLIGHT_EDGES} SELECT edge_type, count(*) AS edges, count(*) FILTER ({S.uniform('42', '0', 'src', 'dst', 'edge_type')} < p) AS live FROM fe GROUP BY edge_type")
def flight_cascade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the leg edges that a delay would take in one run add up to, by kind."""
    edges = _flight_network(spark, sf_dir)[1]
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_if(cascade.uniform(F.lit(42), F.lit(0), "src", "dst", "edge_type") < F.col("p")).alias("live"))
