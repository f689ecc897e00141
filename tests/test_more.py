from __future__ import annotations

import pytest

from tripweave.functions.keys import dense_ids, joined_key
from tripweave.functions.nested import flatten
from tripweave.operators import linkpred
from tripweave.operators.graph import Graph
from tripweave.sources import graph_files


def test_flatten(spark):
    df = spark.sql("select 1 as a, named_struct('b', 2, 'c', named_struct('d', 'x')) as s")
    assert flatten(df).first().asDict() == {"a": 1, "s__b": 2, "s__c__d": "x"}


def test_keys_are_null_with_a_null_part(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    assert [r[0] for r in df.select(joined_key("x", "y")).collect()] == ["a|1", None]


def test_dense_ids_over_buckets(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (3, 1), (5, 9), (4, 4)], "a int, b int")
    found = dense_ids(df, df.a, "a", "b").orderBy("id").collect()
    assert [(r.a, r.b, r.id) for r in found] == [(None, 1, 0), (3, 1, 1), (3, 2, 2), (4, 4, 3), (5, 9, 4)]


def test_training_sample_is_even(spark):
    pairs = spark.createDataFrame([(i, i + 1, int(i < 3)) for i in range(20)], "u long, v long, label int")
    counts = {r.label: r["count"] for r in linkpred.training_sample(pairs).groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 3}


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "A"), (1, "B")], "node_id long, code string")
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 1, 4.0)], "src_id long, dst_id long, flight_count double")
    nodes.write.parquet(str(tmp_path / "n"))
    edges.write.parquet(str(tmp_path / "e"))
    g = graph_files.load_graph(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert isinstance(g, Graph) and g.vertices.columns == ["id", "code"]
    assert sorted((r.src, r.dst, r.weight) for r in g.symmetrized().collect()) == [(0, 1, 2.0), (1, 0, 2.0), (1, 1, 4.0)]
    assert '<edge source="n0" target="n1"><data key="w">2.0</data></edge>' in graph_files.to_graphml(g)
    assert graph_files.to_pajek(g).splitlines() == ["*Vertices 2", '1 "0"', '2 "1"', "*Arcs", "1 2 2.0", "2 2 4.0"]
    graph_files.write_edge_list(g, str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["0 1", "1 1"]
    assert graph_files.to_gml(g).splitlines()[:3] == ["graph [", "  directed 1", '  node [ id 0 label "0" ]'] and "  edge [ source 1 target 1 weight 4.0 ]" in graph_files.to_gml(g)
    for kind in ("graphml", "gml", "pajek", "edgelist"):
        graph_files.save_graph(g, f"file://{tmp_path}/saved.{kind}", kind)
    assert (tmp_path / "saved.gml").read_text() == graph_files.to_gml(g) and any((tmp_path / "saved.edgelist").iterdir())
    for text in (graph_files.to_graphml, graph_files.to_gml, graph_files.to_pajek):
        with pytest.raises(ValueError):
            text(g, most=1)


def test_remapped_ids(spark):
    g = Graph(spark.createDataFrame([(70, "x"), (5, "y"), (30, "z")], "id long, code string"), spark.createDataFrame([(5, 70, 1.0), (30, 5, 2.0), (30, 99, 1.0)], "src long, dst long, weight double"))
    small, names = graph_files.remapped(g)
    assert {r.original: r.id for r in names.collect()} == {5: 0, 30: 1, 70: 2}
    assert {(r.id, r.code) for r in small.vertices.collect()} == {(0, "y"), (1, "z"), (2, "x")}
    assert {(r.src, r.dst, r.weight) for r in small.edges.collect()} == {(0, 2, 1.0), (1, 0, 2.0)}
    codes = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "code string")
    assert {(r.code, r.id) for r in graph_files.node_mapping(codes).collect()} == {("a", 0), ("b", 1)}


def test_airlines_of_communities(spark):
    from tripweave.operators import communities

    members = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 3)], "id long, community long")
    nodes = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "id long, code string")
    departures = spark.createDataFrame([("A", "X", 3), ("B", "Y", 5), ("B", "X", 1), ("C", "Z", 1)], "code string, carrier string, count long")
    found = {r.community: (r.carrier, r["count"], r.total) for r in communities.airline_by_community(members, nodes, departures).collect()}
    assert found == {1: ("Y", 5, 9), 2: ("Z", 1, 1), 3: (None, None, None)}


def test_tables_of_a_scope_go(spark):
    import pathlib

    from tripweave.sources import shared

    kept = shared.written(spark.range(3), "kept")
    with shared.scope(spark):
        gone = shared.new_path(spark, "gone")
        shared.written(spark.range(5), "inside").collect()
        spark.range(1).write.parquet(gone)
        assert pathlib.Path(gone.removeprefix("file://")).exists()
    assert not pathlib.Path(gone.removeprefix("file://")).parent.exists() and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tripweave.sources import shared

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="no such one", master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(session)
