from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.functions.keys import numbered, ranked_within, running
from tripweave.operators import communities, graph, robustness
from tripweave.operators.components import components
from tripweave.operators.graph import Graph
from tripweave.sources.shared import written


def make(spark, n, edges):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
    return Graph(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double"))


def by_id(df, column):
    return {r.id: r[column] for r in df.collect()}


@pytest.fixture
def kite(spark):
    """Two loops that share an edge, and a tail."""
    return make(spark, 6, [(0, 1, 2), (1, 2, 1), (2, 0, 4), (1, 3, 3), (3, 0, 1), (3, 4, 5)])


@pytest.fixture
def tables_only(monkeypatch):
    """Graphs are never small, so that all goes the way of large ones."""

    def on():
        monkeypatch.setattr(Graph, "small", lambda self, most=0: False)

    return on


def test_degrees(kite):
    found = graph.degrees(kite)
    assert by_id(found, "in_degree") == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0} and by_id(found, "out_degree") == {0: 1, 1: 2, 2: 1, 3: 2, 4: 0, 5: 0}
    assert by_id(found, "in_strength") == {0: 5, 1: 2, 2: 1, 3: 3, 4: 5, 5: 0} and by_id(found, "out_strength")[3] == 6


def plain_pagerank(n, edges, weighted, d=0.85):
    ranks = [1 / n] * n
    out = [sum(w if weighted else 1 for a, _, w in edges if a == v) for v in range(n)]
    for _ in range(400):
        spare = sum(r for r, o in zip(ranks, out, strict=True) if not o)
        ranks = [(1 - d + d * spare) / n + d * sum(ranks[a] * (w if weighted else 1) / out[a] for a, b, w in edges if b == v) for v in range(n)]
    return dict(enumerate(ranks))


@pytest.mark.parametrize("weighted", [False, True])
def test_pagerank_comes_to_rest(kite, tables_only, weighted):
    edges = [(0, 1, 2), (1, 2, 1), (2, 0, 4), (1, 3, 3), (3, 0, 1), (3, 4, 5)]
    expected = plain_pagerank(6, edges, weighted)
    fast = by_id(graph.pagerank(kite, weighted=weighted), "pagerank")
    assert fast == pytest.approx(expected, abs=1e-11) and sum(fast.values()) == pytest.approx(1)
    tables_only()
    assert by_id(graph.pagerank(kite, weighted=weighted, tolerance=1e-9), "pagerank") == pytest.approx(expected, abs=1e-8)


def test_components(spark, kite):
    g = make(spark, 7, [(0, 1), (1, 2), (5, 4)])
    assert by_id(graph.weak_components(g), "component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    assert graph.component_sizes(graph.weak_components(g)).agg({"size": "max"}).first()[0] == 3
    assert by_id(graph.strong_components(kite), "component") == {0: 3, 1: 3, 2: 3, 3: 3, 4: 4, 5: 5}
    row = graph.graph_summary(kite).first()
    assert (row.vertices, row.edges, row.weak_components, row.largest_weak, row.strong_components, row.largest_strong) == (6, 6, 2, 5, 3, 4)


def plain_strong(n, edges):
    """The greatest vertex that each one reaches and is reached by."""
    reach = [{v} for v in range(n)]
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return {v: max(u for u in reach[v] if v in reach[u]) for v in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_components_on_either_side_of_the_size(spark, tables_only, seed):
    rng = random.Random(seed)
    n = 40
    # loops of several sizes, chains up and down between them, and some edges anywhere
    edges = {(a, a + 1) for a in range(n - 1) if rng.random() < 0.7} | {(rng.randrange(n), rng.randrange(n)) for _ in range(6 + 8 * seed)}
    g = make(spark, n, sorted(edges))
    weak, strong = by_id(graph.weak_components(g), "component"), by_id(graph.strong_components(g), "component")
    assert strong == plain_strong(n, edges) and len(set(strong.values())) > 1
    tables_only()
    assert by_id(graph.weak_components(g), "component") == weak
    assert by_id(graph.strong_components(g), "component") == strong


def test_long_chains_are_trimmed_at_once(spark, monkeypatch):
    chain = make(spark, 300, [(i, i + 1) for i in range(299)] + [(3, 1), (200, 199)])
    spread = []
    monkeypatch.setattr(graph, "_spread", lambda *a, f=graph._spread: spread.append(a[0].count()) or f(*a))
    found = by_id(graph.strong_components_in_tables(chain), "component")
    assert found == {i: 3 if 1 <= i <= 3 else 200 if i in (199, 200) else i for i in range(300)}
    assert spread == [5]  # only what lies between the ends of a fall is searched


def test_long_path_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5)], "a long, b long")
    assert {r.component for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_betweenness_all_ways(spark, monkeypatch):
    g = make(spark, 6, [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (3, 5), (5, 0), (1, 1)])
    fast = by_id(graph.betweenness(g), "betweenness")
    slow = by_id(graph._betweenness_by_levels(g.vertices, g.edges.filter("src <> dst").select("src", "dst"), g.vertices), "betweenness")
    assert fast == pytest.approx(slow) and max(fast.values()) > 0
    rng = random.Random(1)
    crowd = make(spark, 25, sorted({(rng.randrange(24), rng.randrange(24)) for _ in range(90)}))  # dense enough for a matrix, one vertex alone
    by_matrix = by_id(graph.betweenness(crowd), "betweenness")
    monkeypatch.setattr(graph, "DENSE_VERTICES", 0)
    assert by_matrix == pytest.approx(by_id(graph.betweenness(crowd), "betweenness")) and max(by_matrix.values()) > 5
    path = by_id(graph.betweenness(make(spark, 4, [(0, 1), (1, 2), (2, 3)])), "betweenness")
    assert path == {0: 0, 1: 2, 2: 2, 3: 0}


def test_betweenness_of_large_graphs_by_component(spark, monkeypatch, tables_only):
    rng = random.Random(3)
    edges = sorted({(b + rng.randrange(8), b + rng.randrange(8)) for b in (0, 10, 20) for _ in range(30)} | {(20 + rng.randrange(9), 20 + rng.randrange(9)) for _ in range(60)})
    g = make(spark, 31, edges)
    expected = by_id(graph.betweenness(g), "betweenness")
    tables_only()
    levels = []
    monkeypatch.setattr(graph, "_betweenness_by_levels", lambda v, e, s, f=graph._betweenness_by_levels: levels.append({r.src for r in e.collect()}) or f(v, e, s))
    monkeypatch.setattr(graph, "TASK_WORK", 50)  # several tasks a component
    assert by_id(graph.betweenness(g), "betweenness") == pytest.approx(expected) and not levels
    monkeypatch.setattr(graph, "DENSE_VERTICES", 0)
    monkeypatch.setattr(graph, "KERNEL_EDGES", 35)  # the last component is too large
    assert by_id(graph.betweenness(g), "betweenness") == pytest.approx(expected) and max(expected.values()) > 3
    assert len(levels) == 1 and min(levels[0]) >= 20


def test_estimated_betweenness(spark):
    g = make(spark, 30, [(i, (i * 5 + k) % 30) for i in range(30) for k in (1, 2, 7)])
    whole = by_id(graph.betweenness(g), "betweenness")
    assert by_id(graph.betweenness_estimate(g, 1.0), "betweenness") == pytest.approx(whole)
    half = by_id(graph.betweenness_estimate(g, 0.5), "betweenness")
    starts = {r.id for r in graph.sampled_sources(g, 0.5).collect()}
    assert 5 < len(starts) < 25 and set(half) == set(whole)
    sampled = by_id(graph.betweenness(g, spark.createDataFrame([(i,) for i in starts], "id long")), "betweenness")
    assert half == pytest.approx({i: x * 30 / len(starts) for i, x in sampled.items()})
    assert set(by_id(graph.betweenness_estimate(g, 0.0), "betweenness").values()) == {0.0}


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("b", 2.0, 5), ("c", 2.0, 5), ("d", 3.0, 5)], "k string, x double, y int")
    found = {r.k: (r.x, r.y) for r in graph.mean_ranks(df, "k", ["x", "y"]).collect()}
    assert found == {"a": (1, 4), "b": (2.5, 2), "c": (2.5, 2), "d": (4, 2)}
    assert [r.composite for r in graph.composite_rank(df, "k", ["x"]).orderBy("k").collect()] == [4, 2.5, 2.5, 1]
    assert [(r["rank"], r.k, r.x) for r in graph.composite_top(df, "k", ["x", "y"], 3).orderBy("rank").collect()] == [(1, "d", 3.0), (2, "a", 1.0), (3, "b", 2.0)]
    assert [r.k for r in graph.top_by_metric(df, "k", ["x"], 2).orderBy("rank").collect()] == ["d", "b"]
    many = spark.createDataFrame([(i, float(i * 37 % 50), i % 7) for i in range(400)], "k int, x double, y int")
    ranks = graph.mean_ranks(many, "k", ["x", "y"], descending=True).collect()
    for m in ("x", "y"):
        values = {r.k: r[m] for r in many.collect()}
        assert all(r[m] == sum(v > values[r.k] for v in values.values()) + (sum(v == values[r.k] for v in values.values()) + 1) / 2 for r in ranks)


def test_connectors_and_hubs(spark):
    rows = [(i, float(i), float((i * 3) % 40)) for i in range(37)] + [(37, 3.0, 50.0), (38, 40.0, 60.0), (39, 41.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, in_degree double, betweenness double")
    pct = lambda values, v: (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2) / len(values)
    d, b = [r[1] for r in rows], [r[2] for r in rows]
    kinds = {i: "mega_hub" if pct(b, y) > 0.95 and pct(d, x) > 0.95 else "connector" if pct(b, y) > 0.9 and pct(d, x) < 0.75 else None for i, x, y in rows}
    assert {r.id: r.kind for r in graph.connectors(df, "id").collect()} == {i: k for i, k in kinds.items() if k} and set(kinds.values()) == {"mega_hub", "connector", None}
    assert {r.id: r.kind for r in graph.connectors(df, "id", others=True).collect()} == kinds


def test_running_sums(spark):
    rows = [(i * 31 % 100, i % 5) for i in range(100)]
    df = written(spark.createDataFrame(rows, "at int, n int"), "rows")
    found = {r["at"]: r.upto for r in running(df, [F.col("at").desc()], upto=F.col("n")).collect()}
    assert found == {a: sum(n for b, n in rows if b >= a) for a, _ in rows}
    assert [r["at"] for r in numbered(df, "at").orderBy("id").collect()] == list(range(100))
    ranks = {r["at"]: r.r for r in ranked_within(df, ["n"], [F.col("at")], "r").collect()}
    assert ranks == {a: sum(m == n and b <= a for b, m in rows) for a, n in rows}


def test_quality_and_detection(spark):
    clique = lambda a: [(a + i, a + j) for i in range(4) for j in range(4) if i != j]
    g = make(spark, 8, clique(0) + clique(4) + [(0, 4)])
    halves = spark.createDataFrame([(i, i // 4) for i in range(8)], "id long, community long")
    assert communities.cpm_quality(g, halves, 0.1).first()[0] == pytest.approx(24 - 0.1 * 24)
    assert 0.4 < communities.modularity(g, halves).first()[0] < 0.5
    found = communities.leiden_cpm(g, 0.1, runs=3)
    groups = by_id(found, "community")
    assert groups == {i: i // 4 * 4 for i in range(8)}  # named by the least of each
    again = by_id(communities.leiden_cpm(g, 0.1, runs=3), "community")
    assert again == by_id(communities.leiden_cpm(g, 0.1, runs=3), "community")


def test_draws_are_spark_s(spark):
    ids = [0, 1, -5, 1 << 40, 7]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    expected = {r.id: r.h for r in df.select("id", F.xxhash64(*communities._longs(42, 3, 9), "id").alias("h")).collect()}
    assert dict(zip(ids, communities.draws(np.array(ids), 42, 3, 9).tolist(), strict=True)) == expected


@pytest.mark.parametrize("case", [(40, 3, 0.1, 1), (20, 5, 0.3, 2)])
def test_communities_are_the_same_at_every_size(spark, tables_only, case):
    n, k, resolution, n_runs = case
    edges = sorted({(min(a, b), max(a, b)) for i in range(n) for a, b in [(i, (i * (4 * j + 3) + j) % n) for j in range(1, k + 1)] if a != b})
    g = make(spark, n, edges)
    quality = lambda groups: sum(groups[a] == groups[b] for a, b in edges) - resolution * sum(groups[a] == groups[b] for a in range(n) for b in range(n) if a != b)
    fast = by_id(communities.leiden_cpm(g, resolution, runs=n_runs), "community")
    runs = [communities.run_in_memory(np.arange(n), *(np.array(x) for x in zip(*edges, strict=True)), np.ones(len(edges)), resolution, 42 + r) for r in range(n_runs)]
    qualities = [quality(dict(enumerate(m.tolist()))) for m in runs]
    assert quality(fast) == pytest.approx(max(qualities))
    tables_only()
    assert by_id(communities.leiden_cpm(g, resolution, runs=n_runs), "community") == fast
    for c in set(fast.values()):  # every community is connected
        own = [i for i in fast if fast[i] == c]
        found, todo = {own[0]}, [own[0]]
        while todo:
            at = todo.pop()
            near = {b if a == at else a for a, b in edges if at in (a, b)} & set(own) - found
            found |= near
            todo += near
        assert c == min(own) and found == set(own)


def test_communities_of_large_graphs_by_component(spark, monkeypatch):
    sizes = ((0, 12, 1), (50, 9, 1), (70, 8, 5))
    edges = sorted({(b + min(x, y), b + max(x, y)) for b, n, k in sizes for i in range(n) for x, y in [(i, (i * (4 * j + 3) + j) % n) for j in range(1, k + 1)] if x != y})
    g, tables = make(spark, 80, edges), []
    take = lambda g, runs=2: by_id(communities.leiden_cpm(g, 0.1, runs=runs), "community")
    expected = take(g)
    for b, n, _ in sizes:  # each component by itself
        own = Graph(g.vertices.filter(F.col("id").between(b, b + n - 1)), g.edges.filter(F.col("src").between(b, b + n - 1)))
        assert take(own) == {i: c for i, c in expected.items() if b <= i < b + n}
    monkeypatch.setattr(Graph, "small", lambda self, most=0: False)
    monkeypatch.setattr(communities, "_run_in_tables", lambda v, *a, f=communities._run_in_tables: tables.append(v.count()) or f(v, *a))
    assert take(g) == expected and not tables
    monkeypatch.setattr(graph, "DENSE_VERTICES", 0)
    once = take(g, 1)
    monkeypatch.setattr(graph, "KERNEL_EDGES", 14)
    assert take(g, 1) == once and tables == [8]


def test_curves(spark, tables_only):
    wheel = make(spark, 7, [(0, i) for i in range(1, 6)] + [(5, 6)])
    order = robustness.removal_order(wheel, "highest_degree")
    assert by_id(order, "step")[0] == 1 and by_id(order, "step")[5] == 2
    steps = [0, 1, 2, 7]
    expected = {0: 7, 1: 2, 2: 1, 7: 0}
    assert {r.step: r.lcc for r in robustness.curves(wheel, order, steps).collect()} == expected
    tables_only()
    assert {r.step: r.lcc for r in robustness.curves(wheel, order, steps).collect()} == expected


def test_curves_of_large_graphs_in_one_pass(spark, tables_only, monkeypatch):
    rng = random.Random(5)
    g = make(spark, 60, sorted({(rng.randrange(58), rng.randrange(58)) for _ in range(90)}))
    orders = written(robustness.random_orders(g, 3).union(robustness.removal_order(g, "degree")), "orders")
    take = lambda: sorted(map(tuple, robustness.curves(g, orders, [0, 3, 10, 25, 40, 60]).collect()))
    small = take()
    tables_only()
    by_step = robustness._curves_by_components
    monkeypatch.setattr(robustness, "_curves_by_components", None)  # components at each step are found anew
    assert take() == small and len(small) == 24
    monkeypatch.setattr(robustness, "_curves_by_components", by_step)
    monkeypatch.setattr(robustness, "KERNEL_EDGES", 0)  # orders that can't be held
    assert take() == small


@pytest.mark.parametrize("seed", range(2))
def test_strong_curves_on_either_side_of_the_size(spark, tables_only, seed):
    rng = random.Random(seed)
    n = 16
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(28)} | {(i, i + 1) for i in range(4)})
    g = make(spark, n, edges)
    orders = robustness.removal_order(g, "degree").union(robustness.random_orders(g, 2))
    gone = {}
    for r in orders.collect():
        gone.setdefault((r.strategy, r.trial), {})[r.id] = r.step
    steps = [0, 2, 5, 9, 16]

    def largest(step, order):
        alive = [v for v in range(n) if order[v] > step]
        names = plain_strong(n, [(a, b) for a, b in edges if order[a] > step and order[b] > step])
        return max((sum(names[u] == names[v] for u in alive) for v in alive), default=0)

    expected = {(*k, s): largest(s, order) for k, order in gone.items() for s in steps}
    take = lambda: {(r.strategy, r.trial, r.step): r.lcc for r in robustness.curves(g, orders, steps, strong=True).collect()}
    assert take() == expected and max(expected.values()) > 2
    tables_only()
    assert take() == expected


def test_strong_curve_of_a_path(spark, tables_only):
    path = make(spark, 5, [(i, i + 1) for i in range(4)])
    order = robustness.removal_order(path, "degree")
    take = lambda: [r.lcc for r in robustness.curves(path, order, [0, 1], strong=True).orderBy("step").collect()]
    assert take() == [1, 1]
    tables_only()
    assert take() == [1, 1]


def test_analysis_by_an_effort(spark):
    g = make(spark, 20, [(i, (i * 3 + k) % 20) for i in range(20) for k in (1, 4)])
    rows = robustness.analysed(g, "ring", robustness.Effort(("degree", "weighted_degree", "betweenness", "unheard of"), 2, 5, 0.5)).collect()
    assert {(r.graph, r.strategy, r.trial) for r in rows} == {("ring", "targeted_degree", 0), ("ring", "targeted_strength", 0), ("ring", "targeted_betweenness", 0), ("ring", "random", 0), ("ring", "random", 1)}
    assert {r.step for r in rows} == {0, 2, 4, 6, 8, 10}
    other = robustness.analysed(g, "other", robustness.LARGE, seed=1)
    both = robustness.averaged(other.unionByName(robustness.analysed(g, "ring", robustness.LARGE)))
    measures = robustness.curve_measures(both).collect()
    assert {(r.graph, r.strategy) for r in measures} == {(a, b) for a in ("ring", "other") for b in ("random", "targeted_degree")}
    assert {r.graph for r in robustness.vulnerability(robustness.curve_measures(both)).collect()} == {"ring", "other"}
    assert robustness.SMALL.points == 50 and robustness.MIDDLE.strategies == ("degree",)


def test_curve_measures(spark):
    rows = [("degree", 0, 0.0, 1.0), ("degree", 1, 0.5, 0.4), ("degree", 2, 1.0, 0.0), ("random", 0, 0.0, 1.0), ("random", 1, 0.5, 0.8), ("random", 2, 1.0, 0.6)]
    found = {r.strategy: r for r in robustness.curve_measures(spark.createDataFrame(rows, "strategy string, step long, fraction_removed double, lcc_fraction double")).collect()}
    assert found["degree"].auc == pytest.approx(0.45) and found["degree"].critical_fraction == 0.5 and found["degree"].initial_slope == pytest.approx(-1.2)
    assert found["random"].critical_fraction == 1.0 and found["random"].final_lcc == 0.6
    ratio = robustness.vulnerability(spark.createDataFrame(found.values())).first()
    assert ratio.ratio == pytest.approx(0.8 / 0.45)


def test_nested_communities(spark):
    triangles = make(spark, 6, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)])
    assert {(r.id, r.community, r.level) for r in communities.nested(triangles, 6, 0.01).collect()} == {(i, 0, 0) for i in range(6)}
    halves = communities.nested(triangles, resolution=0.08).collect()
    assert {(r.id, r.community) for r in halves} == {(i, i // 3 * 3) for i in range(6)} 
    alone = communities.nested(triangles, 1, 0.4).collect()
    assert {r.community for r in alone} == set(range(6)) and all(r.level > 0 for r in alone)
    assert communities.nested(make(spark, 0, []), 1).count() == 0


def test_random_orders_are_seeded(spark):
    g = make(spark, 10, [(0, 1)])
    a, b = (sorted(map(tuple, robustness.random_orders(g, 3).collect())) for _ in range(2))
    assert a == b and len(a) == 30
    assert robustness.sample_steps(10, 4) == [0, 2, 5, 7, 10]


def test_betweenness_of_one_component_that_is_shared(spark, monkeypatch):
    rng = random.Random(7)
    crowd = {(a, b) for a in range(70) for b in range(70) if a != b and rng.random() < 0.08}  # dense, and large enough for a matrix of its own
    sparse = {(100 + i, 100 + (i + k) % 120) for i in range(120) for k in (1, 3)} | {(225, 226), (226, 227)}
    g = make(spark, 230, sorted(crowd | sparse))
    arrays = [np.array(x) for x in zip(*sorted(crowd | sparse))]
    expected = dict(enumerate(sum(graph._dependencies(v, *graph._adjacency(*arrays, 230)) for v in range(230))))
    # As if the edges were more than KERNEL_EDGES: a component of fewer than SHARED_EDGES isn't searched in tables.
    monkeypatch.setattr(Graph, "small", lambda self, most=10: self.edges.count() <= most)
    monkeypatch.setattr(graph, "KERNEL_EDGES", 10)
    monkeypatch.setattr(graph, "_betweenness_by_levels", None)
    monkeypatch.setattr(graph, "in_parts", None)
    assert by_id(graph.betweenness(g), "betweenness") == pytest.approx(expected) and expected[226] == 1
    held = graph._searched(*arrays)
    assert sorted((len(names), dense) for names, _, dense in held) == [(70, True), (123, False)]
    assert [graph._dependencies_of(np.arange(230), held, batch).value.sum() for batch in (3, 512)] == pytest.approx([sum(expected.values())] * 2)


def test_communities_of_one_component_that_is_shared(spark, monkeypatch):
    edges = sorted({(min(x, y), max(x, y)) for i in range(40) for k in (1, 2, 5) for x, y in [(i, (i * 3 + k) % 40)] if x != y})
    g = make(spark, 42, edges)
    expected = by_id(communities.leiden_cpm(g, 0.1, runs=2), "community")
    monkeypatch.setattr(Graph, "small", lambda self, most=10: self.edges.count() <= most)
    monkeypatch.setattr(communities, "_best_in_parts", None)
    assert by_id(communities.leiden_cpm(g, 0.1, runs=2), "community") == expected and len(set(expected.values())) < 42


@pytest.mark.parametrize("weights", [(1.0, 2.0, 3.0), (0.25, 0.1, 1.5), (1.0, 0.0, -1.0)])
def test_sums_around_vertices_are_kept_up(monkeypatch, weights):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(150)})
    a, b = (np.array(x) for x in zip(*pairs))
    w, now = np.array([rng.choice(weights) for _ in pairs]), np.arange(30)
    for cells in (4_000_000, 90):
        monkeypatch.setattr(communities, "CELLS", cells)
        around = communities._Around(30, a, b, w)
        for turn in range(25):
            expected = {(v, int(now[v])): 0.0 for v in range(30)}
            for x, y, z in zip(a.tolist(), b.tolist(), w.tolist()):
                for v, u in ((x, y), (y, x)):
                    expected[v, int(now[u])] = expected.get((v, int(now[u])), 0.0) + z
            v, c, found = around.of(now)
            assert list(zip(v.tolist(), c.tolist())) == sorted(expected) and found == pytest.approx([expected[k] for k in sorted(expected)])
            now = now.copy()
            for _ in range(8 if turn < 4 else 1):
                now[rng.randrange(30)] = now[rng.randrange(30)]
