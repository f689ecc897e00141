from __future__ import annotations

import datetime as dt
import random

import pytest

from tripweave.config import Edges, Scope
from tripweave.operators import networks
from tripweave.sources import tables

FLIGHT = "flight_id long, tail string, carrier string, origin string, dest string, dep_ts timestamp_ntz, arr_ts timestamp_ntz"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


@pytest.fixture
def flights(spark):
    return spark.createDataFrame(
        [
            (0, "N1", "AA", "A", "B", at(6), at(7)),
            (1, "N1", "AA", "B", "C", at(8), at(9)),
            (2, "N1", "AA", "C", "A", at(9), at(10)),  # departs as the one before arrives: no edge
            (3, "N2", "DL", "B", "C", at(7, 30), at(9)),
            (4, None, "DL", "B", "C", at(11), at(12)),
            (5, "N3", "AA", "B", "A", at(7, 29), None),
        ],
        FLIGHT,
    )


def pairs(df):
    return sorted((r.src_id, r.dst_id) for r in df.collect())


def test_tail_edges(flights):
    edges = networks.tail_edges(flights).collect()
    assert [(e.src_id, e.dst_id, e.ground_time_minutes, e.same_carrier, e.tail) for e in edges] == [(0, 1, 60, True, "N1")]


def test_route_neighbours(flights):
    assert pairs(networks.route_knn_edges(flights, 1)) == [(1, 4), (3, 1)]
    assert pairs(networks.route_knn_edges(flights, 2)) == [(1, 4), (3, 1), (3, 4)]


def test_transfers_include_both_ends_of_the_window(flights):
    found = {(r.arrival, r.departure): r.minutes for r in networks.connections(flights, (30, 240)).collect()}
    assert found == {(0, 1): 60, (0, 3): 30, (0, 4): 240}  # (0, 5) waits 29 minutes
    assert pairs(networks.transfer_knn_edges(flights, 1, True)) == [(0, 1)]
    assert pairs(networks.transfer_knn_edges(flights, 2, False)) == [(0, 1), (0, 3)]


@pytest.mark.parametrize("window", [(30, 240), (-60, 20), (0, 0)])
def test_transfers_without_all_pairs(spark, monkeypatch, window):
    rng = random.Random(2)
    when = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = []
    for i in range(150):
        dep = rng.randrange(0, 40_000, 300)
        rows.append((i, rng.choice(["A", "B", None]), rng.choice(["A", "B", None]), rng.choice(["C1", "C2", None]), when(dep), when(dep + rng.randrange(0, 9_000, 450)) if i % 9 else None))
    flights = spark.createDataFrame(rows, "flight_id long, origin string, dest string, carrier string, dep_ts timestamp_ntz, arr_ts timestamp_ntz")
    for same in (True, False):
        pairs = {}
        for r in networks.connections(flights, window, same).collect():
            pairs.setdefault(r.arrival, []).append((r.minutes, r.dep_ts, r.departure))
        expected = {(a, d, m) for a, found in pairs.items() for m, _, d in sorted(found)[:2]}
        with monkeypatch.context() as m:
            m.setattr(networks, "connections", None)  # every two flights within the window
            assert {(r.src_id, r.dst_id, r.ground_time_minutes) for r in networks.transfer_knn_edges(flights, 2, same, window).collect()} == expected and expected


def test_connections_against_brute_force(spark, sf_dir):
    legs = tables.legs(spark, sf_dir)
    rows = [r for r in legs.collect()]
    least, most = dt.timedelta(minutes=30), dt.timedelta(minutes=240)
    expected = {(a.flight_id, d.flight_id) for a in rows for d in rows if a.dest == d.origin and a.flight_id != d.flight_id and least <= d.dep_ts - a.arr_ts <= most}
    assert {(r.arrival, r.departure) for r in networks.connections(legs, (30, 240)).collect()} == expected


def test_first_kind_wins_and_one_is_needed(flights):
    kinds = {(r.src_id, r.dst_id): r.edge_type for r in networks.flight_edges(flights, Edges(include_airport_transfer_knn=True)).collect()}
    assert kinds[(0, 1)] == "tail_next_leg" and kinds[(3, 1)] == "route_knn"
    with pytest.raises(ValueError):
        networks.flight_edges(flights, Edges(include_tail_sequence=False, include_same_route_knn=False))


def test_connection_graph(flights):
    kinds = {r.edge_type for r in networks.connection_graph(flights).collect()}
    assert kinds == {"pax", "tail"}


def test_airports_and_routes(spark, sf_dir):
    trips = tables.trips(spark, sf_dir)
    nodes = networks.airport_nodes(trips)
    found = [(r.node_id, r.code) for r in nodes.orderBy("node_id").collect()]
    assert [n for n, _ in found] == list(range(len(found))) and [c for _, c in found] == sorted(c for _, c in found)
    edges = networks.airport_edges(trips, nodes)
    assert edges.agg({"flight_count": "sum"}).first()[0] == trips.count()
    check = networks.edge_integrity(edges).first()
    assert (check.repeated, check.missing_ends, check.negative_weights) == (0, 0, 0)


def test_layers(spark, sf_dir):
    trips = tables.trips(spark, sf_dir)
    nodes = networks.airport_nodes(trips)
    edges = networks.layer_edges(trips, nodes)
    summary = networks.layer_summary(edges)
    assert summary.agg({"edge_count": "sum"}).first()[0] == edges.count()
    both = networks.interlayer_edges(trips, nodes)
    assert both.filter("src_layer >= dst_layer").count() == 0 and both.count() > 0
    assert networks.interlayer_edges(trips, nodes, enabled=False).count() == 0
    assert networks.multilayer_edges(trips, nodes, interlayer=True).count() == edges.count() + both.count()
    assert networks.layer_edges(trips.limit(0), nodes.limit(0)).count() == 0


def test_scopes(spark, sf_dir):
    trips = tables.trips(spark, sf_dir)
    n = trips.count()
    assert networks.scope(trips, Scope("full")).count() == n
    best = {r.code for r in networks.top_airports(trips, 3).collect()}
    kept = networks.scope(trips, Scope("top_airports", top_airports_k=3))
    assert kept.count() == trips.filter(trips.ORIGIN.isin(*best) | trips.DEST.isin(*best)).count()
    share = networks.scope(trips, Scope("sample", sample_frac=0.25)).count() / n
    assert 0.15 < share < 0.35
    with pytest.raises(ValueError):
        networks.scope(trips, Scope("none"))


def test_nodes_do_not_depend_on_partitions(spark, sf_dir):
    trips = tables.timed_trips(spark, sf_dir)
    one, other = (sorted(map(tuple, networks.flight_nodes(t).select("flight_key", "flight_id").collect())) for t in (trips, trips.repartition(7)))
    assert one == other and sorted(i for _, i in one) == list(range(len(one)))
