from __future__ import annotations

import datetime as dt
import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripweave.config import Costs, Edges
from tripweave.functions import draws
from tripweave.functions.draws import live_bits, masks
from tripweave.functions.keys import below, uniform
from tripweave.operators import business, cascade, graph, linkpred, networks
from tripweave.operators.graph import Graph
from tripweave.sources import tables
from tripweave.sources.shared import alone, written


def test_cascade_against_search(spark):
    edges = [(i, (i * 7 + k) % 40, "route_knn", 0.3) for i in range(40) for k in (1, 2, 5)]
    df = spark.createDataFrame(edges, "src long, dst long, edge_type string, p double")
    seeds = spark.createDataFrame([(r, r) for r in range(6)], "run long, id long")
    live = {(r.run, r.src, r.dst) for r in df.crossJoin(seeds.select("run")).filter(cascade.uniform(F.lit(42), "run", "src", "dst", "edge_type") < F.col("p")).collect()}
    for r in range(6):
        reached, todo = {r}, [r]
        while todo:
            v = todo.pop()
            fresh = {b for run, a, b in live if run == r and a == v} - reached
            reached |= fresh
            todo += fresh
        assert {x.id for x in cascade.cascades(df, seeds).filter(F.col("run") == r).collect()} == reached


def plain_parents(live, seeds):
    """{id: (level, parent)} by breadth, each reached first from the least of the level before."""
    found, now, depth = {s: (0, None) for s in seeds}, sorted(seeds), 0
    while now:
        depth += 1
        fresh = {}
        for a in now:
            for x, b in live:
                if x == a and b not in found:
                    fresh.setdefault(b, (depth, a))
        found |= fresh
        now = sorted(fresh)
    return found


def test_parents_on_either_side_of_the_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i * 3 + k) % 30, "route_knn" if k < 3 else "tail_next_leg", 0.5) for i in range(30) for k in (1, 2, 4)], "src long, dst long, edge_type string, p double")
    runs = {"a:0": [3], "a:1": [3, 7], "b": [29]}
    seeds = spark.createDataFrame([(r, i) for r, own in runs.items() for i in own], "run string, id long")
    live = {r: [(x.src, x.dst) for x in df.filter(cascade.uniform(F.lit(42), F.lit(r), "src", "dst", "edge_type") < F.col("p")).collect()] for r in runs}
    expected = {(r, i, *x) for r, own in runs.items() for i, x in plain_parents(live[r], own).items()}
    take = lambda: {(x.run, x.id, x.level, x.parent) for x in cascade.cascades(df, seeds, parents=True).collect()}
    assert take() == expected and max(x[2] for x in expected) > 1
    monkeypatch.setattr(cascade, "_fits", lambda *a: False)
    assert take() == expected
    assert {(x.run, x.id) for x in cascade.cascades(df, seeds).collect()} == {x[:2] for x in expected}


def test_draws_are_those_of_spark(spark):
    edges = [(i * 997, -i if i % 5 == 0 else i * i, "route_knn" if i % 3 else "tail_next_leg", (i % 11) / 10) for i in range(400)]
    df = spark.createDataFrame(edges, "src long, dst long, edge_type string, p double")
    heads = ["42|7|", "42|click:13|", f"42|{'long' * 12}|"]
    found = masks(heads, pa.array([f"{a}|{b}|{t}" for a, b, t, _ in edges]), np.array([e[3] for e in edges]))
    for k, head in enumerate(heads):
        live = {(r.src, r.dst) for r in df.filter(cascade.uniform(F.lit(42), F.lit(head.split("|")[1]), "src", "dst", "edge_type") < F.col("p")).collect()}
        assert {e[:2] for e, m in zip(edges, found.tolist(), strict=True) if m >> k & 1} == live


def test_only_wanted_draws_are_made(monkeypatch):
    rows, p = pa.array([f"{i * 997}|{i}|route_knn" for i in range(300)]), np.arange(300) % 11 / 10
    heads, wanted = ["42|7|", "42|click:13|", f"42|{'long' * 12}|"], (np.arange(300) % 8).astype(np.uint64)
    expected, made = masks(heads, rows, p), []
    monkeypatch.setattr(draws, "first_words", lambda w, n, f=draws.first_words: made.append(n) or f(w, n))
    assert (live_bits(heads, rows, p, wanted) == (expected & wanted)).all()
    assert sum(made) == sum(int(w) >> k & 1 for w in wanted for k in (0, 1))  # the third are of two blocks


@pytest.mark.parametrize("far", [1, 10**15])
def test_cascades_of_large_graphs_by_masks(spark, monkeypatch, far):
    rows = [(i * far, (i * 7 + k) % 80 * far, "route_knn" if k < 5 else "tail_next_leg", 0.5) for i in range(80) for k in (1, 2, 5)]
    df = spark.createDataFrame(rows, "src long, dst long, edge_type string, p double")
    seeds = spark.createDataFrame([(f"s:{r}", (r * i) % 83 * far) for r in range(70) for i in (1, 3)], "run string, id long")  # more runs than a mask has bits; some seeds without an edge
    take = lambda: sorted((r.run, r.id) for r in cascade.cascades(df, seeds).collect())
    expected = take()
    assert len(expected) > 1_000
    monkeypatch.setattr(cascade, "_fits", lambda *a: False)
    real = cascade._by_masks
    for held in (cascade.HELD_EDGES, 0):
        ways = []
        monkeypatch.setattr(cascade, "HELD_EDGES", held)
        monkeypatch.setattr(cascade, "_by_masks", lambda *a, f=real, w=ways, **k: w.append(1) or f(*a, **k))
        assert take() == expected and ways
        sizes = {r.run: r.n for r in cascade.run_sizes(df, seeds).collect()}
        assert sizes == {run: sum(r == run for r, _ in expected) for run in {r for r, _ in expected}} and len(ways) == 2


def test_sizes_are_counted_without_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i * 7 + k) % 80, "route_knn", 0.5) for i in range(80) for k in (1, 2, 5)], "src long, dst long, edge_type string, p double")
    seeds = spark.createDataFrame([(r, (r * i) % 83) for r in range(6) for i in (1, 3)], "run long, id long")
    spread = lambda x: sorted(map(tuple, x.collect()))
    expected = spread(cascade.cascade_sizes(cascade.cascades(df, seeds), seeds, 80))
    monkeypatch.setattr(cascade, "_fits", lambda *a: False)
    monkeypatch.setattr(cascade, "cascades", None)
    assert len(expected) == 6 and spread(cascade.counted_sizes(df, seeds, 80)) == expected


def test_seeds_are_the_lowest_draws(spark):
    vertices = spark.createDataFrame([(i,) for i in range(500)], "id long")
    found = {}
    for r in cascade.random_seeds(vertices, 3, 0.02).collect():
        found.setdefault(r.run, set()).add(r.id)
    draw = lambda run, i: int(hashlib.md5(f"42|seed|{run}|{i}".encode()).hexdigest()[:8], 16)
    assert found == {run: set(sorted(range(500), key=lambda i: (draw(run, i), i))[:10]) for run in range(3)}
    assert cascade.random_seeds(vertices.limit(3), 2, 0.01).count() == 2 and cascade.random_seeds(vertices, 1, 1.0).count() == 500


def test_spreaders_of_a_sample(spark):
    edges = spark.createDataFrame([(i, i + 1, "tail_next_leg", 1.0) for i in range(9)], "src long, dst long, edge_type string, p double")
    vertices = spark.createDataFrame([(i,) for i in range(10)], "id long")
    found = {r.id: r.influence for r in cascade.flight_spreaders(edges, vertices, 2, 0.1, 4).collect()}
    assert len(found) == 10 and sum(v > 0 for v in found.values()) == 4 and all(v in (0, 10 - i) for i, v in found.items())
    assert {r.id: r.influence for r in cascade.flight_spreaders(edges, vertices, 2).collect()} == {i: 10 - i for i in range(10)}


def test_transmission(spark):
    df = spark.createDataFrame([(1, 2, "tail_next_leg"), (1, 3, "route_knn"), (1, 4, "airport_transfer_knn")], "src_id long, dst_id long, edge_type string")
    assert {r.dst: r.p for r in cascade.spreading_edges(df).collect()} == {2: 0.60, 3: 0.25}
    assert {r.p for r in cascade.spreading_edges(df, single=True).collect()} == {0.25}


def test_beta_skips_flights_before_pairing(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(0, "N", t(1), 20.0, 0.0), (1, "N", t(2), 50.0, 1.0), (2, "N", t(3), 30.0, 0.0), (3, "N", t(4), 0.0, 0.0), (4, "N", t(5), None, 0.0)]
    df = spark.createDataFrame(rows, "flight_id long, tail string, dep_ts timestamp_ntz, arr_delay double, cancelled double")
    row = cascade.empirical_beta(df).first()
    assert (row.delayed, row.passed_on, row.beta) == (2, 1, 0.5)
    assert cascade.empirical_beta(df.limit(0)).first().beta is None


def test_statistics(spark):
    row = cascade.cascade_statistics(spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.2), (2, 3, 0.3), (3, 10, 1.0)], "run long, cascade_size long, fraction_delayed double")).first()
    assert (row.mean, row.p50, row.p90, row["min"], row["max"]) == (4.0, 2.5, pytest.approx(7.9), 1, 10)
    assert (row.mean_fraction, row.p99_fraction) == (pytest.approx(0.4), pytest.approx(0.979))
    assert cascade.cascade_statistics(spark.createDataFrame([(0, 5, 0.5)], "run long, cascade_size long, fraction_delayed double")).first()["std"] == 0


def test_month_split_has_no_leak(spark):
    rows = [(4, "KEF", "OSL", "X"), (5, "OSL", "HEL", "X"), (6, "HEL", "RIX", "Y"), (5, "KEF", "OSL", "Y"), (7, "KEF", "OSL", "X"), (7, "RIX", "KEF", "X"), (8, "HEL", "VNO", "Z"), (8, "OSL", "RIX", "Y"), (9, "AAA", "BBB", "X"), (7, None, "KEF", "X")]
    trips = spark.createDataFrame(rows, "MONTH int, ORIGIN string, DEST string, OP_UNIQUE_CARRIER string")
    nodes, train, new = linkpred.month_split(trips, (4, 5, 6), (7, 8))
    code = {r.id: r.code for r in nodes.collect()}
    named = lambda df: {code[r.u] + code[r.v] for r in df.collect()}
    assert code == dict(enumerate(["HEL", "KEF", "OSL", "RIX", "VNO"]))
    assert named(train) == {"KEFOSL", "OSLHEL", "HELRIX"} and named(new) == {"RIXKEF", "HELVNO", "OSLRIX"}
    assert "VNO" not in {r.code for r in linkpred.month_split(trips, (4, 5, 6), (7, 8), ("X", "Y"))[0].collect()}


def test_no_new_routes_in_the_test_period(spark):
    trips = spark.createDataFrame([(1, "A", "B"), (2, "B", "A"), (10, "A", "B")], "MONTH int, ORIGIN string, DEST string")
    nodes, train, new = linkpred.month_split(trips, (1, 2), (10,))
    assert train.count() == 2 and new.count() == 0 and linkpred.negatives(nodes, train, new).count() == 0
    scored = linkpred.heuristics(new.withColumn("label", F.lit(1)), train)
    assert scored.count() == 0 and linkpred.top_predictions(scored, 5, "jaccard").count() == 0
    found = linkpred.auc_ap(scored, list(linkpred.HEURISTICS)).collect()
    assert {(r.method, r.positives, r.auc, r.ap) for r in found} == {(m, 0, 0.0, 0.0) for m in linkpred.HEURISTICS}


def plain_negatives(n, taken, wanted, seed=42):
    """The first different free pairs that draws 0, 1, ... name."""
    end = lambda name, k: int(int(hashlib.md5(f"{seed}|{name}|{k}".encode()).hexdigest()[:8], 16) / (1 << 32) * n)
    found, k, wanted = [], 0, min(wanted, n * (n - 1) - len({p for p in taken if p[0] != p[1]}))
    while len(found) < wanted:
        pair = (end("u", k), end("v", k))
        if pair[0] != pair[1] and pair not in taken and pair not in found:
            found.append(pair)
        k += 1
    return set(found)


@pytest.mark.parametrize("n", [5, 60, 400])
@pytest.mark.parametrize("ratio", [1, 3, 500])
def test_negatives_by_one_rule(spark, n, ratio):
    pairs = lambda p: spark.createDataFrame(p, "u long, v long")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    train, positives = [(i, (i + 1) % n) for i in range(n)] + [(2, 2)], [(i, (i + 3) % n) for i in range(min(n, 20))]
    found = [tuple(r) for r in linkpred.negatives(nodes, pairs(train), pairs(positives), ratio).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_negatives(n, {*train, *positives}, ratio * len(positives))


def test_heuristics_by_sets(spark):
    import math

    rng = __import__("random").Random(2)
    train = {(0, i) for i in range(1, 40)} | {(rng.randrange(40), rng.randrange(40)) for _ in range(150)}
    out = {v: {b for a, b in train if a == v} for v in range(41)}
    pairs = sorted({(rng.randrange(41), rng.randrange(41)) for _ in range(120)} | {(0, 1), (1, 0)})
    frame = lambda p: spark.createDataFrame(p, "u long, v long")
    for r in linkpred.heuristics(frame(pairs), frame(sorted(train) * 2)).collect():
        a, b = out[r.u], out[r.v]
        assert r.common_neighbors == len(a & b) and r.jaccard == pytest.approx(len(a & b) / len(a | b) if a | b else 0) and r.preferential_attachment == len(a) * len(b)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(out[w])) for w in a & b if len(out[w]) > 1))


def test_auc_and_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0, 1.0), (0, 0.8, 0.0, 1.0), (1, 0.7, 1.0, 1.0), (0, 0.1, 0.0, 1.0)], "label int, a double, perfect double, flat double")
    found = {r.method: r for r in linkpred.auc_ap(df, ["a", "perfect", "flat"]).collect()}
    assert found["a"].auc == 0.75 and found["a"].ap == pytest.approx(5 / 6)
    assert (found["perfect"].auc, found["perfect"].ap) == (1, 1) and (found["flat"].auc, found["flat"].ap) == (0.5, 0.5)
    one = linkpred.auc_ap(df.filter("label = 0"), ["a"]).first()
    assert (one.auc, one.ap) == (0.5, 0.0)


def test_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0, 0.0])], "id long, embedding array<double>")
    found = {(r.u, r.v): r for r in linkpred.pair_features(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "u long, v long"), table).collect()}
    assert len(found[0, 1].hadamard) + 3 == 7 and abs(found[0, 1].cosine) < 1e-6 and found[0, 2].cosine == pytest.approx(2**-0.5) and found[0, 1].l1 == 2
    for block in (2_000, 1):
        near = {(r.query, r.rank): r.neighbor for r in linkpred.neighbors(table, table, 1, block).collect()}
        assert near == {(0, 1): 2, (1, 1): 2, (2, 1): 0}
    assert linkpred.vector_norms(table).first().near_zero == 0


def test_walks(spark):
    g = Graph(spark.createDataFrame([(i,) for i in range(5)], "id long"), spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)] + [(3, 0, 2.0)], "src long, dst long, weight double"))
    a, b = (sorted((r.walk, r.start, tuple(r.path)) for r in linkpred.walks(g, 6, 3, p=0.5, q=2.0).collect()) for _ in range(2))
    assert a == b and len(a) == 15
    assert all((x, y) in {(0, 1), (1, 2), (2, 3), (3, 4), (3, 0)} for _, _, path in a for x, y in zip(path, path[1:], strict=False))


def test_vectors_tell_who_walks_together(spark):
    import numpy as np

    ring = lambda a: [(a + i, a + j, 1.0) for i in range(6) for j in range(6) if i != j]
    g = Graph(spark.createDataFrame([(i,) for i in range(12)], "id long"), spark.createDataFrame(ring(0) + ring(6) + [(0, 6, 0.05)], "src long, dst long, weight double"))
    walks = linkpred.walks(g, 12, 30)
    for partitions in (1, 3):
        learn = lambda p=partitions: {r.id: np.array(r.embedding) for r in linkpred.skip_gram(walks, 8, 3, 6, rate=0.1, partitions=p).collect()}
        found, again = learn(), learn()
        assert len(found) == 12 and all((found[i] == again[i]).all() and len(found[i]) == 8 for i in found)
        like = lambda i, j: found[i] @ found[j] / np.linalg.norm(found[i]) / np.linalg.norm(found[j])
        inside = np.mean([like(i, j) for i in range(12) for j in range(12) if i != j and i // 6 == j // 6])
        assert inside > 0.2 + np.mean([like(i, j) for i in range(6) for j in range(6, 12)])


def test_vectors_of_a_component_do_not_depend_on_others(spark):
    ring = lambda a, n: [(a + i, a + (i + k) % n, 1.0) for i in range(n) for k in (1, 2)]

    def learned(ids, edges):
        g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double"))
        return {r.id: r.embedding for r in linkpred.skip_gram(linkpred.walks(g, 8, 5), 5, 3, 2, rate=0.1).collect()}

    both = learned(range(21), ring(0, 8) + ring(8, 12))  # 20 is alone
    assert sorted(both) == list(range(21)) and all(len(x) == 5 for x in both.values())
    assert {i: both[i] for i in range(8)} == learned(range(8), ring(0, 8)) and {i: both[i] for i in range(8, 20)} == learned(range(8, 20), ring(8, 12))


def test_picker_finds_what_a_search_finds():
    import numpy as np

    rng = np.random.default_rng(1)
    odds, share = np.cumsum(rng.random(1000) ** 4), np.append(rng.random(100_000), 0.0)
    assert (linkpred._picker(odds)(share) == np.searchsorted(odds, share * odds[-1], side="right")).all()


@pytest.mark.parametrize("bias", [(1.0, 1.0), (0.5, 2.0)])
def test_walks_in_tables_are_the_same(spark, monkeypatch, bias):
    edges = [(i, (i * 3 + k) % 9, float(k)) for i in range(9) for k in (1, 2, 4)] + [(2, 9, 5.0)]
    g = Graph(spark.createDataFrame([(i,) for i in range(11)], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double"))
    take = lambda: sorted((r.walk, r.start, tuple(r.path)) for r in linkpred.walks(g, 5, 2, *bias).collect())
    fast = take()
    assert len(fast) == 22 and {len(x[2]) for x in fast} > {1, 5}
    monkeypatch.setattr(Graph, "small", lambda self, most=0: False)
    assert take() == fast


def test_walks_of_large_graphs_by_component(spark, monkeypatch):
    edges = [(b + i, b + (i * 3 + k) % n, float(k)) for b, n in ((0, 9), (20, 4), (30, 14)) for i in range(n) for k in (1, 2, 4)]
    g = Graph(spark.createDataFrame([(i,) for i in range(45)], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double"))
    take = lambda: sorted((r.walk, r.start, tuple(r.path)) for r in linkpred.walks(g, 6, 3).collect())
    expected, tables = take(), []
    monkeypatch.setattr(Graph, "small", lambda self, most=0: False)
    monkeypatch.setattr(linkpred, "TASK_STEPS", 20)
    monkeypatch.setattr(linkpred, "_walks_in_tables", lambda s, *a, f=linkpred._walks_in_tables: tables.append({r.id for r in s.collect()}) or f(s, *a))
    assert take() == expected and not tables
    monkeypatch.setattr(graph, "DENSE_VERTICES", 0)
    monkeypatch.setattr(graph, "KERNEL_EDGES", 30)
    assert take() == expected and tables == [set(range(30, 44))]


def test_business(spark):
    trips = spark.createDataFrame(
        [("AA", "ATL", 10.0, 20.0, 0.0, 100.0)] * 2 + [("AA", "JFK", 5.0, -5.0, 0.0, 200.0), ("DL", "DEN", 0.0, 15.0, 0.0, 300.0), ("DL", "DEN", None, None, 1.0, 300.0), ("DL", "ATL", 3.0, 0.0, 0.0, 300.0)],
        "OP_UNIQUE_CARRIER string, ORIGIN string, DEP_DELAY double, ARR_DELAY double, CANCELLED double, DISTANCE double",
    )
    found = {r.carrier: r for r in business.airline_summary(trips, Costs(100.0, 5000.0)).collect()}
    aa, dl = found["AA"], found["DL"]
    assert aa.mean_dep_delay == pytest.approx(25 / 3) and dl.cancellation_rate == pytest.approx(1 / 3)
    assert (aa.hub_top1_pct, aa.primary_hub) == (pytest.approx(200 / 3), "ATL") and dl.hub_top3_pct == 100
    assert (aa.total_cost, dl.total_cost) == (4000.0, 1500.0 + 5000.0)


def test_streamed_legs_match_the_batch(spark, tmp_path):
    from tripweave.operators import networks
    from tripweave.streaming.tails import next_legs

    t = lambda h, m=0, day=1: dt.datetime(2024, 1, day, h, m)
    late = [(1, "N1", "AA", t(8), t(9)), (4, "N2", "DL", t(9), t(10)), (5, None, "DL", t(9), t(10))]  # come after flights that leave later
    first = [(0, "N1", "AA", t(6), t(7)), (2, "N1", "DL", t(9, 30), t(10)), (3, "N2", "DL", t(7), t(8)), (6, "N2", "DL", t(9, 30), t(11))]
    end = [(7, "N9", "DL", t(0, day=9), t(1, day=9))]  # moves the watermark past all others
    schema = "flight_id long, tail string, carrier string, dep_ts timestamp_ntz, arr_ts timestamp_ntz"
    (tmp_path / "in").mkdir()
    stream = next_legs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    for rows in (first, late, end):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    edges = lambda df: sorted((r.src_id, r.dst_id, r.tail, r.ground_time_minutes) for r in df.collect())
    got = edges(spark.read.schema("src_id long, dst_id long, tail string, ground_time_minutes long").parquet(str(tmp_path / "out")))
    assert len(got) == 3 and got == edges(networks.tail_edges(spark.createDataFrame(first + late, schema)))


def test_seeds_are_told_from_the_digest(spark):
    rows = spark.range(3000).withColumn("id", F.when(F.col("id") > 5, F.col("id")))
    draw = uniform(F.lit(42), F.lit("seed"), "id")
    for limit in (-0.5, 0.0, 1 / 2**32, 0.013, 0.5, 1 - 2**-33, 1.0, 3.7):
        assert rows.filter(below(limit, F.lit(42), F.lit("seed"), "id")).exceptAll(rows.filter(draw < limit)).isEmpty()
        assert rows.filter(draw < limit).exceptAll(rows.filter(below(limit, F.lit(42), F.lit("seed"), "id"))).isEmpty()


def test_tables_on_the_way_are_deleted(spark):
    on_the_way = []

    def make():
        on_the_way.append(written(spark.range(9), "nine"))
        return on_the_way[0].filter("id > 3")

    assert sorted(r.id for r in alone(spark, "kept", make).collect()) == [4, 5, 6, 7, 8]
    path = on_the_way[0].inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)


def test_kinds_of_flight_edges(spark, sf_dir):
    flights = tables.legs(spark, sf_dir).cache()
    for settings in (Edges(), Edges(include_airport_transfer_knn=True), Edges(include_tail_sequence=False)):
        wanted = networks.flight_edges(flights, settings).select("src_id", "dst_id", "edge_type")
        found = networks.flight_edge_kinds(flights, settings)
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty() and not found.isEmpty()
    flights.unpersist()


def test_linked_on_either_side_of_the_size(spark, monkeypatch):
    edges = spark.createDataFrame([(9, 4), (4, 9), (4, 7), (1, 1), (2, 3), (3, 8), (8, 2), (11, 20), (20, 30), (30, 7)], "src long, dst long")
    expected = {(i, 4) for i in (4, 7, 9, 11, 20, 30)} | {(2, 2), (3, 2), (8, 2)}
    assert {tuple(r) for r in graph.linked(edges).collect()} == expected
    assert graph.linked(edges.limit(0)).isEmpty()
    monkeypatch.setattr(graph, "KERNEL_EDGES", 1)
    assert {tuple(r) for r in graph.linked(edges).collect()} == expected


def test_edges_are_drawn_a_bounded_number_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    src, dst = rng.integers(0, 40, (2, 900))
    asked, dice = [], rng.integers(0, 1 << 20, 900).astype(np.uint64)

    def live(at, bits):
        asked.append(len(at))
        return bits & dice[at]

    take = lambda: cascade.flooded(src, dst, live, np.array([3, 5]), np.array([1023, 1 << 19], np.uint64), 40)
    expected = take()
    assert max(asked) > 300 and np.count_nonzero(expected) > 20
    asked.clear()
    monkeypatch.setattr(cascade, "DRAWN_AT_ONCE", 50)
    most = np.bincount(src).max()
    assert (take() == expected).all() and max(asked) <= 50 + most
    assert (cascade.flooded(src, dst, dice, np.array([3, 5]), np.array([1023, 1 << 19], np.uint64), 40) == expected).all()


def test_walks_of_one_component_that_is_shared(spark, monkeypatch):
    edges = [(i, (i * 3 + k) % 12, w) for i in range(12) for k, w in ((1, 1.0), (2, 3.0), (4, 2.0))] + [(2, 2**40, 5.0), (2**40, 3, 0.25), (2, 3, 4.0)]
    g = Graph(spark.createDataFrame([(i,) for i in [*range(12), 2**40, 50]], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double"))
    take = lambda *bias: sorted((r.walk, r.start, tuple(r.path)) for r in linkpred.walks(g, 6, 3, *bias).collect())
    arcs = g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    starts = g.vertices.crossJoin(spark.range(3).toDF("walk"))
    monkeypatch.setattr(Graph, "small", lambda self, most=10: self.edges.count() <= most)
    monkeypatch.setattr(linkpred, "_walks_in_parts", None)
    for bias in ((1.0, 1.0), (0.5, 2.0)):
        expected = sorted((r.walk, r.start, tuple(r.path)) for r in linkpred._walks_in_tables(starts, arcs, 6, *bias, 42).collect())
        assert take(*bias) == expected and {2**40, 50} <= {x[1] for x in expected}
    monkeypatch.setattr(linkpred, "PACKED_EDGES", 3)
    assert take() == sorted((r.walk, r.start, tuple(r.path)) for r in linkpred._walks_in_tables(starts, arcs, 6, 1.0, 1.0, 42).collect())


def test_no_starts_no_walks(spark):
    nothing = spark.range(1).mapInPandas(lambda batches: (linkpred._walked({}, b.assign(walk=b.id)[:0], 5, 1.0, 1.0, 42) for b in batches), linkpred.WALKS)
    assert nothing.collect() == []


def test_steps_of_lines_that_tie(spark, tmp_path):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    lines = [(k % 3, 10 + k, 100 + (k * 7) % 5, 1, float(k % 2), float(k * 3 % 4), 0.0, 0.0, "N", "O", t[k % 2]) for k in range(24)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    for key, place in (("l_suppkey", 2), ("l_partkey", 1)):
        expected = []
        for orders in ((0, 1), (2,)):
            own = sorted((x for x in lines if x[0] in orders), key=lambda x: (x[10], x[0], x[3], x[1], x[2], *x[4:10]))
            expected += [(a[place], b[place], 1) for a, b in zip(own, own[1:]) if a[place] != b[place]]
        assert sorted(map(tuple, tables.steps(spark, str(tmp_path), key).collect())) == sorted(expected) and len(expected) > 10
