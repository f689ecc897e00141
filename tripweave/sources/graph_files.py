"""Graphs as tables and as text files."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.keys import numbered
from tripweave.operators.graph import Graph
from tripweave.sources.manifests import save_text
from tripweave.sources.shared import written

_IDS = ("vertex_id", "node_id", "flight_id")


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str, weight: str | None = "flight_count") -> Graph:
    """A graph from a table of nodes (vertex_id, node_id or flight_id) and one of edges (src_id, dst_id and a weight)."""
    nodes, edges = spark.read.parquet(nodes_path), spark.read.parquet(edges_path)
    name = next((n for n in _IDS if n in nodes.columns), None)
    if not name:
        raise ValueError(f"nodes have none of {_IDS}")
    value = F.col(weight).cast("double") if weight and weight in edges.columns else F.lit(1.0)
    return Graph(nodes.withColumnRenamed(name, "id"), edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), value.alias("weight")))


def write_edge_list(graph: Graph, path: str, weights: bool = False) -> None:
    """Text files with a line `src dst` (and the weight) for each edge."""
    graph.edges.select(F.concat_ws(" ", "src", "dst", *(["weight"] if weights else [])).alias("value")).write.mode("overwrite").text(path)


def _bounded(graph: Graph, most: int, kind: str) -> tuple[list, list]:
    """Ids and edges in order, of a graph with at most so many of either."""
    if any(df.limit(most + 1).count() > most for df in (graph.edges, graph.vertices)):
        raise ValueError(f"the graph is too large for one {kind} text; write_edge_list() has no such bound")
    return [r.id for r in graph.vertices.orderBy("id").select("id").toLocalIterator()], list(graph.edges.orderBy("src", "dst", "weight").toLocalIterator())


def to_graphml(graph: Graph, most: int = 1_000_000) -> str:
    """GraphML of a small graph; one with more than `most` vertices or edges is refused, as in the other texts below."""
    ids, arcs = _bounded(graph, most, "GraphML")
    nodes = "".join(f"<node id={quoteattr(f'n{i}')}/>" for i in ids)
    edges = "".join(f"<edge source={quoteattr(f'n{r.src}')} target={quoteattr(f'n{r.dst}')}><data key=\"w\">{r.weight}</data></edge>" for r in arcs)
    return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">{nodes}{edges}</graph></graphml>'


def to_gml(graph: Graph, most: int = 1_000_000) -> str:
    """GML of a small graph."""
    ids, arcs = _bounded(graph, most, "GML")
    nodes = "".join(f"  node [ id {i} label \"{i}\" ]\n" for i in ids)
    edges = "".join(f"  edge [ source {r.src} target {r.dst} weight {r.weight} ]\n" for r in arcs)
    return f"graph [\n  directed 1\n{nodes}{edges}]\n"


def to_pajek(graph: Graph, most: int = 1_000_000) -> str:
    """Pajek text of a small graph; vertices are numbered from 1."""
    ids, arcs = _bounded(graph, most, "Pajek")
    place = {i: k + 1 for k, i in enumerate(ids)}
    return "\n".join([f"*Vertices {len(ids)}", *(f'{k} "{i}"' for i, k in place.items()), "*Arcs", *(f"{place[r.src]} {place[r.dst]} {r.weight}" for r in arcs)]) + "\n"


def save_graph(graph: Graph, path: str, kind: str = "graphml") -> None:
    """Writes a graph in a kind of text (graphml, gml, pajek) or, of any size, as a folder of lines (edgelist); paths of any file system that Spark writes."""
    if kind == "edgelist":
        return write_edge_list(graph, path, weights=True)
    texts = {"graphml": to_graphml, "gml": to_gml, "pajek": to_pajek}
    if kind not in texts:
        raise ValueError(f"unknown kind of graph file: {kind}")
    save_text(graph.edges.sparkSession, texts[kind](graph), path)


def node_mapping(codes: DataFrame, column: str = "code") -> DataFrame:
    """(column, id): different codes numbered from 0 in their order; nulls have no number."""
    return numbered(written(codes.filter(F.col(column).isNotNull()).select(column).distinct(), "codes"), column).withColumn("id", F.col("id").cast("long"))


def remapped(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph with vertices numbered from 0 without gaps, in the order of their ids, and the table (id, original); edges at unknown vertices go."""
    names = written(numbered(written(graph.vertices.select(F.col("id").alias("original")).distinct(), "originals"), "original").select(F.col("id").cast("long").alias("id"), "original"), "mapping")
    end = lambda c: names.select(F.col("original").alias(c), F.col("id").alias(f"_{c}"))
    edges = graph.edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")
    rest = [c for c in graph.vertices.columns if c != "id"]
    vertices = graph.vertices.withColumnRenamed("id", "original").join(names, "original").select("id", *rest)
    return Graph(vertices, edges), names
