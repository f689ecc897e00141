"""Graphs as two tables, and what can be said of their vertices."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.keys import running, uniform
from tripweave.operators.components import components
from tripweave.operators.joins import join_counted
from tripweave.sources.shared import written

#: Kernels hold the edges of graphs of so many edges at most; larger ones go another way.
KERNEL_EDGES = 2_000_000
#: Graphs of so many edges at most are sent to all tasks, as numbers of four bytes.
SHARED_EDGES = 8_000_000
#: Graphs of so many vertices at most, with many edges, are held as a matrix where that is faster.
DENSE_VERTICES = 3_000
#: The same where only one byte a place is held, and a few rows at a time are made numbers that can be multiplied.
MATRIX_VERTICES = 12_000


@dataclass(frozen=True)
class Graph:
    """vertices: id (long) and more; edges: src, dst, weight (double), directed, repeats allowed."""

    vertices: DataFrame
    edges: DataFrame

    def small(self, most: int = KERNEL_EDGES) -> bool:
        """Whether a kernel may hold it: neither edges nor vertices are more than `most`. Written tables are counted from their footers."""
        return all(df.count() <= most for df in (self.edges, self.vertices))

    def undirected(self) -> DataFrame:
        """(src, dst, weight) with src <= dst, weights added up."""
        return self.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))

    def symmetrized(self) -> DataFrame:
        """(src, dst, weight): the sum of the adjacency matrix and its transpose, loops counted once."""
        return self.both_ways().groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("weight", F.when(F.col("src") == F.col("dst"), F.col("weight") / 2).otherwise(F.col("weight")))

    def both_ways(self) -> DataFrame:
        return self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table as arrays on the driver."""
    table = df.toArrow()
    return [table.column(c).to_numpy() for c in df.columns]


def degrees(graph: Graph) -> DataFrame:
    """(id, in_degree, out_degree, in_strength, out_strength) of every vertex, zeros included.

    Both ends of an edge are counted in one aggregation, so the edges are shuffled once."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.col("weight").alias("ow"), F.lit(0).alias("i"), F.lit(0.0).alias("iw")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(0.0).alias("ow"), F.lit(1).alias("i"), F.col("weight").alias("iw"))))
    sums = graph.edges.select(ends.alias("x")).select("x.*").groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_strength"), F.sum("ow").alias("out_strength"))
    zero = {"in_degree": 0, "out_degree": 0, "in_strength": 0.0, "out_strength": 0.0}
    return graph.vertices.select("id").join(sums, "id", "left").na.fill(zero)


def degree_distribution(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(F.col(column).alias("degree")).agg(F.count("*").alias("vertices"))


def graph_summary(graph: Graph) -> DataFrame:
    """One row: vertices, edges, density, mean and greatest degrees, how many weak and strong components there are and the size of the largest."""
    n, e = F.col("vertices"), F.col("edges")
    sums = degrees(graph).agg(F.count("*").alias("vertices"), F.sum("out_degree").alias("edges"), F.avg("in_degree").alias("mean_in_degree"), F.max("in_degree").alias("max_in_degree"), F.avg("out_degree").alias("mean_out_degree"), F.max("out_degree").alias("max_out_degree"))
    sums = sums.withColumn("density", F.when(n > 1, e / (n * (n - 1))).otherwise(0.0))
    for kind, membership in (("weak", weak_components(graph)), ("strong", strong_components(graph))):
        sizes = component_sizes(membership).agg(F.count("*").alias(f"{kind}_components"), F.coalesce(F.max("size"), F.lit(0)).alias(f"largest_{kind}"))
        sums = sums.join(F.broadcast(sizes))  # a row each
    return sums


def _in_one_task(vertices: DataFrame, edges: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """(id, value) of each vertex by one task that holds the graph (see Graph.small()).

    work gets the sorted ids of all vertices and ends, the places of each edge's ends among them, the weights, and which ids are vertices.
    """
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).union(vertices.select("id", F.lit(None).cast("long"), F.lit(0.0)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := list(batches)):
            return
        table = pa.Table.from_batches(found)
        alone = np.asarray(table.column("dst").is_null())
        src, weight = (table.column(c).to_numpy() for c in ("src", "weight"))
        dst = table.column("dst").fill_null(0).to_numpy()
        names = np.unique(np.concatenate([src, dst[~alone]]))
        own = np.zeros(len(names), bool)
        own[np.searchsorted(names, src[alone])] = True
        found = work(names, np.searchsorted(names, src[~alone]), np.searchsorted(names, dst[~alone]), weight[~alone], own)
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(found[own])], names=["id", "value"])

    return rows.repartition(1).mapInArrow(kernel, f"id long, value {kind}")


def pagerank(graph: Graph, damping: float = 0.85, tolerance: float = 1e-12, weighted: bool = False, most_steps: int = 1_000, cut_every: int = 5) -> DataFrame:
    """(id, pagerank), summing to 1; vertices without an edge out spread theirs evenly.

    Spreading evenly adds to all ranks alike, so it only scales the result: the iteration leaves it out, which spares
    a global sum each time, and the last step divides by the total. It starts from the total that it comes to rest at. Steps go on until the ranks change by at most tolerance of their sum (each
    brings them nearer by the factor damping at least; most_steps is where that is given up). Graphs that fit a kernel go on in one task; in tables, ranks
    are written and compared every few steps.
    """
    value = F.col("weight") if weighted else F.lit(1.0)
    edges = graph.edges.select("src", "dst", value.alias("weight"))
    if Graph(graph.vertices, edges).small():

        def work(names: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
            share = damping * weight / np.bincount(src, weight, len(names))[src]
            ranks = own / (1 - damping)
            for _ in range(most_steps):
                before, ranks = ranks, np.where(own, 1 + np.bincount(dst, share * ranks[src], len(names)), 0.0)
                if np.abs(ranks - before).sum() <= tolerance * ranks.sum():
                    break
            return ranks / ranks.sum()

        return _in_one_task(graph.vertices, edges, work, "double").withColumnRenamed("value", "pagerank")
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("value"))
    out = edges.groupBy("src").agg(F.sum("value").alias("total"))
    edges = written(edges.join(out, "src").select("src", "dst", (F.col("value") / F.col("total")).alias("share")), "transitions")
    vertices = graph.vertices.select("id")
    ranks = vertices.withColumn("rank", F.lit(1 / (1 - damping)))
    for k in range(most_steps):
        inflow = edges.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("inflow"))
        ranks = ranks.join(inflow, F.col("id") == F.col("dst"), "left").select("id", (1.0 + damping * F.coalesce("inflow", F.lit(0.0))).alias("rank"), F.col("rank").alias("before"))
        if (k + 1) % cut_every == 0 or k + 1 == most_steps:
            ranks = written(ranks, "ranks")
            total, change = ranks.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.col("before")))).first()
            if (change or 0.0) <= tolerance * (total or 0.0):
                break
        ranks = ranks.drop("before")
    return ranks.select("id", (F.col("rank") / F.lit(total)).alias("pagerank"))


def weak_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest vertex that can be reached, edges taken both ways; in one task where a kernel may hold the graph."""
    if graph.small():
        return _in_one_task(graph.vertices, graph.edges.select("src", "dst", F.lit(1.0).alias("weight")), lambda names, src, dst, weight, own: names[weak_labels(src, dst, len(names))], "long").withColumnRenamed("value", "component")
    found = linked(graph.edges)
    return graph.vertices.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def forest(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(a, b): links that join what the edges join; a block of edges gives fewer than it has vertices."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append([batch.column(k).to_numpy() for k in (0, 1)])
                n += batch.num_rows
            if n and (batch is None or n >= block):
                names, place = np.unique(np.concatenate([x[0] for x in held] + [x[1] for x in held]), return_inverse=True)
                label = weak_labels(place[:n], place[n:], len(names))
                hung = np.flatnonzero(label != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[label[hung]])], names=["a", "b"])
                held, n = [], 0

    return edges.select("src", "dst").dropna().mapInArrow(kernel, "a long, b long")


def linked(edges: DataFrame) -> DataFrame:
    """components() of edges by their forest, which is written once and joined by one task if a kernel may hold it."""
    trees = written(forest(edges), "forest")
    if trees.count() > KERNEL_EDGES:
        return components(trees)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := list(batches)):
            return
        a, b = (pa.Table.from_batches(found).column(c).to_numpy() for c in ("a", "b"))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = weak_labels(place[: len(a)], place[len(a) :], len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["node", "component"])

    return trees.repartition(1).mapInArrow(kernel, "node long, component long")


@dataclass(frozen=True)
class Parts:
    """A graph by its weak components, which nothing that goes along edges leaves: those that a kernel may hold, and the others as one graph.

    members: (id, component) of every end of an edge. edges: the small components' edges with `component`, and `starts` likewise; each (component, chunk) is a group of
    both, so that the starts of a component are dealt over several tasks where they are many.
    """

    edges: DataFrame
    starts: DataFrame
    large_edges: DataFrame
    large_starts: DataFrame
    lone_starts: DataFrame

    def each(self, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """What kernel makes of the edges and the starts of each group."""
        groups = [df.groupBy("component", "chunk") for df in (self.edges, self.starts)]
        return groups[0].cogroup(groups[1]).applyInPandas(kernel, schema)


def in_parts(edges: DataFrame, starts: DataFrame, work: Column, most_edges: int | None = None) -> Parts:
    """Parts of written edges (src, dst, ...) and starts (id, ...). work says from edges, vertices and starts (columns) over how many tasks a component is dealt.

    A component is small with at most most_edges edges (KERNEL_EDGES), or if its vertices are so few that a matrix holds it."""
    members = written(linked(edges).select(F.col("node").alias("id"), "component"), "members")
    placed = written(starts.join(members, "id", "left"), "starts")
    own = written(edges.join(members.withColumnRenamed("id", "src"), "src"), "arcs")
    sizes = members.groupBy("component").agg(F.count("*").alias("vertices")).join(own.groupBy("component").agg(F.count("*").alias("edges")), "component")
    sizes = sizes.join(placed.groupBy("component").agg(F.count("*").alias("starts")), "component")
    fits = (F.col("edges") <= F.lit(KERNEL_EDGES if most_edges is None else most_edges)) | (F.col("vertices") <= DENSE_VERTICES)
    chunks = F.greatest(F.lit(1), F.least(F.lit(_tasks(edges)), F.ceil(work))).cast("int")
    sizes = written(sizes.select("component", fits.alias("fits"), chunks.alias("chunks")), "sizes")
    own, sized = own.join(sizes, "component"), placed.join(sizes, "component")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return Parts(
        own.filter("fits").withColumn("chunk", every).drop("fits", "chunks"), sized.filter("fits").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("fits", "chunks"),
        own.filter("not fits").select(*edges.columns), sized.filter("not fits").select(*starts.columns), placed.filter("component is null").select(*starts.columns),
    )


def weak_labels(src: np.ndarray, dst: np.ndarray, n: int, parent: np.ndarray | None = None) -> np.ndarray:
    """The least vertex of each one's component: roots are hung below lesser ones until no edge joins two, paths cut short each time.

    parent: the labels of earlier edges, which these are added to.
    """
    parent = np.arange(n) if parent is None else parent.copy()
    while True:
        a, b = parent[src], parent[dst]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not (parent[parent] == parent).all():
            parent = parent[parent]


def strong_components(graph: Graph) -> DataFrame:
    """(id, component): the greatest vertex of those that reach each other; in one task where a kernel may hold the graph."""
    if graph.small():

        def work(names: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
            labels = strong_labels(src, dst, len(names))
            most = np.zeros(len(names), np.int64)
            np.maximum.at(most, labels, np.arange(len(names)))
            return names[most[labels]]

        return _in_one_task(graph.vertices, graph.edges.select("src", "dst", F.lit(1.0).alias("weight")), work, "long").withColumnRenamed("value", "component")
    return strong_components_in_tables(graph)


def strong_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """A number for each vertex, equal for those that reach each other.

    Vertices that no edge enters, or none leaves, are alone and go, again and again; the greatest component is mostly what one vertex of many edges
    reaches and is reached by; the rest is searched forwards, and backwards in the order in which that search left it.
    """
    labels, left = np.arange(n), np.ones(n, bool)

    def inside() -> tuple[np.ndarray, np.ndarray]:
        kept = left[src] & left[dst] & (src != dst)
        return src[kept], dst[kept]

    def trim() -> tuple[np.ndarray, np.ndarray]:
        a, b = inside()
        while True:
            ends = (np.bincount(a, minlength=n) > 0) & (np.bincount(b, minlength=n) > 0) & left
            if (ends == left).all():
                return a, b
            left[:] = ends
            a, b = inside()

    a, b = trim()
    if not len(a):
        return labels
    pivot = int(np.argmax(np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n))))
    both = _reached(a, b, n, pivot) & _reached(b, a, n, pivot)
    labels[both], left[both] = pivot, False
    a, b = trim()
    out, back = ({int(v): [] for v in np.flatnonzero(left)} for _ in range(2))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out[x].append(y)
        back[y].append(x)
    done, seen = [], set()
    for v in out:
        stack = [(v, iter(out[v]))] if v not in seen else []
        seen.add(v)
        while stack:
            at, rest = stack[-1]
            nxt = next((u for u in rest if u not in seen), None)
            if nxt is None:
                done.append(at)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
    taken: set[int] = set()
    for v in reversed(done):
        todo = [] if v in taken else [v]
        taken.update(todo)
        while todo:
            at = todo.pop()
            labels[at] = v
            fresh = {u for u in back[at] if u not in taken}
            taken |= fresh
            todo += fresh
    return labels


def _reached(src: np.ndarray, dst: np.ndarray, n: int, start: int) -> np.ndarray:
    """Which vertices edges lead to from a start, itself included, a level at a time."""
    ends, targets = _adjacency(src, dst, n)
    seen, frontier = np.zeros(n, bool), np.array([start])
    seen[start] = True
    while len(frontier):
        near = np.unique(_neighbours(frontier, ends, targets)[1])
        frontier = near[~seen[near]]
        seen[frontier] = True
    return seen


def strong_components_in_tables(graph: Graph) -> DataFrame:
    """(id, component) of a graph of any size, with ids of any type that has an order.

    First what can't be on a cycle goes. Every cycle that rises along edges must fall along some edge from a greater to a lesser id, so its
    vertices lie between the ends of such edges: where ids follow time (a network of trips) this leaves next to nothing, however long its chains are. Then go
    vertices that no edge enters or none leaves, as long as these are many. In what is left, every vertex learns the greatest one that reaches
    it; what the greatest one can be reached from within its colour is its component. Those vertices go, and the rest is coloured again.
    """
    arcs = written(graph.edges.select("src", "dst").filter("src <> dst").distinct(), "arcs")
    everything = written(graph.vertices.select("id"), "left")
    left, edges = _between_falls(everything, arcs)
    found = None
    while not left.isEmpty():
        colours = _spread(left.withColumn("colour", F.col("id")), edges)
        inside = edges.join(colours.toDF("src", "c1"), "src").join(colours.toDF("dst", "c2"), "dst").filter("c1 = c2").select("src", "dst")
        inside = written(inside, "inside")
        reached = colours.filter("id = colour")
        edge = reached
        while True:  # backwards from each colour's own vertex
            step = inside.join(edge.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            edge = written(step.join(reached, ["id", "colour"], "left_anti"), "edge")
            if edge.isEmpty():
                break
            reached = written(reached.union(edge), "reached")
        part = reached.select("id", F.col("colour").alias("component"))
        found = found.union(part) if found else part
        left, edges = _within(left.join(reached, "id", "left_anti"), edges)
        left, edges = _trimmed(left, edges)
    if found is None:
        return everything.select("id", F.col("id").alias("component"))
    return everything.join(found.toDF("found", "component"), F.col("id") == F.col("found"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _within(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices and the edges between them, written."""
    left = written(vertices, "left")
    return left, written(edges.join(left.toDF("src"), "src").join(left.toDF("dst"), "dst").select("src", "dst"), "arcs")


def _between_falls(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices that lie between the ends of an edge to a lesser id, and the edges between them: all cycles are there."""
    falls = edges.filter("src > dst")
    events = vertices.select("id", F.lit(1).alias("turn"), F.lit(0).alias("open"))
    events = events.union(falls.select("dst", F.lit(0), F.lit(1))).union(falls.select("src", F.lit(2), F.lit(-1)))
    events = written(events.groupBy("id", "turn").agg(F.sum("open").alias("open")), "falls")
    covered = running(events, [F.col("id"), F.col("turn")], covered=F.col("open")).filter("turn = 1 and covered > 0").select("id")
    return _trimmed(*_within(covered, edges))


def _trimmed(vertices: DataFrame, edges: DataFrame, least: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Without vertices that no edge enters or none leaves, again as long as that takes `least` of them at a time."""
    n = vertices.count()
    while n:
        cyclic = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        vertices, edges = _within(cyclic, edges)
        before, n = n, vertices.count()
        if before - n < least * before:
            break
    return vertices, edges


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """Each vertex's colour becomes the greatest that reaches it along edges."""
    while True:
        arriving = edges.join(colours.toDF("src", "c"), "src").groupBy("dst").agg(F.max("c").alias("c"))
        moved = colours.join(arriving, colours.id == arriving.dst, "left").select("id", F.greatest("colour", "c").alias("new"), "colour")
        moved = written(moved, "colours")
        changed = not moved.filter("new <> colour").isEmpty()
        colours = moved.select("id", F.col("new").alias("colour"))
        if not changed:
            return colours


def sampled_sources(graph: Graph, share: float, seed: int = 42) -> DataFrame:
    """(id) of the vertices that draw below `share`: the starts of a betweenness estimate."""
    return graph.vertices.select("id").filter(uniform(F.lit(seed), F.lit("source"), "id") < share)


def betweenness_estimate(graph: Graph, share: float, seed: int = 42) -> DataFrame:
    """(id, betweenness) of all vertices from the shortest paths of a sample of starts, scaled by vertices per start; zeros without a start."""
    sources = written(sampled_sources(graph, share, seed), "sources")
    n, k = graph.vertices.count(), sources.count()
    return betweenness(graph, sources).withColumn("betweenness", F.col("betweenness") * (n / k if k else 0.0))


def component_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("component").agg(F.count("*").alias("size"))


def betweenness(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): directed, unweighted, not normalised; each pair of ends counts its shortest paths through a vertex.

    sources (a table of id) restricts the starts to a sample, for an estimate. The starts are independent: for
    graphs of up to SHARED_EDGES edges each task takes some of them with the edges in memory. Paths stay in a weak component, so of larger graphs
    tasks take components with some of their starts; components that are too large for that are searched level by level in tables.
    """
    starts = (sources if sources is not None else graph.vertices).select("id")
    edges = written(graph.edges.select("src", "dst").filter("src <> dst").distinct(), "arcs")
    if not Graph(graph.vertices, edges).small(SHARED_EDGES):
        sums = _sums_in_parts(edges, starts)
    else:
        shared = graph.edges.sparkSession.sparkContext.broadcast(_searched(*arrays(edges)))

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = np.concatenate([np.zeros(0, np.int64), *(batch.id.to_numpy() for batch in batches)])
            yield _dependencies_of(own, shared.value)

        sums = starts.repartition(_tasks(graph.edges)).mapInPandas(kernel, "id long, value double")
    sums = sums.groupBy("id").agg(F.sum("value").alias("value"))
    return graph.vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("betweenness"))


#: So many edges looked at (starts times edges) are worth a task.
TASK_WORK = 2e9


def _sums_in_parts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, value) of what the starts add to vertices, in one or several rows, for a graph of any size."""
    parts = in_parts(edges, starts, F.col("starts") * F.col("edges") / TASK_WORK)

    def kernel(edges: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(starts):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "value": np.zeros(0)})
        return _dependencies_of(starts.id.to_numpy(), _searched(edges.src.to_numpy(), edges.dst.to_numpy()))

    sums = parts.each(kernel, "id long, value double")
    if parts.large_edges.isEmpty():
        return sums
    ends = parts.large_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return sums.union(_betweenness_by_levels(ends, parts.large_edges, parts.large_starts))


def _searched(src: np.ndarray, dst: np.ndarray) -> list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], bool]]:
    """The sorted ids of all ends, the edges between their places (see _adjacency()), and whether a matrix of them is better; each dense weak component on its own, all others together."""
    names = np.unique(np.concatenate([src, dst]))
    if not len(names):
        return []
    src, dst = (np.searchsorted(names, x).astype(np.int32) for x in (src, dst))
    whole = weak_labels(src, dst, len(names))
    vertices, arcs = np.bincount(whole, minlength=len(names)), np.bincount(whole[src], minlength=len(names))
    dense = (vertices <= min(MATRIX_VERTICES, 4 * DENSE_VERTICES)) & (arcs * 50 > vertices**2) & (vertices >= min(64, vertices.max()))
    group = np.where(dense[whole], whole, -1)
    found = []
    for k in np.unique(group):
        own, arc = np.flatnonzero(group == k), group[src] == k
        found.append((names[own], _adjacency(np.searchsorted(own, src[arc]), np.searchsorted(own, dst[arc]).astype(np.int32), len(own)), bool(k >= 0)))
    return found


def _dependencies_of(starts: np.ndarray, held: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], bool]], batch: int = 512) -> pd.DataFrame:
    """(id, value): what searches from starts add to vertices; starts without an edge add nothing."""
    ids, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for names, near, dense in held:
        place = np.minimum(np.searchsorted(names, starts), len(names) - 1)
        place = place[names[place] == starts]
        if not len(place):
            continue
        total = np.zeros(len(names))
        if dense:
            matrix = _matrix(*near)
            for k in range(0, len(place), batch):
                total += _dependencies_by_matrix(place[k : k + batch], matrix)
        else:
            for p in place:
                total += _dependencies(int(p), *near)
        kept = np.flatnonzero(total)
        ids.append(names[kept])
        values.append(total[kept])
    return pd.DataFrame({"id": np.concatenate(ids), "value": np.concatenate(values)})


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _adjacency(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets ordered by source, and where each source's begin."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _matrix(ends: np.ndarray, targets: np.ndarray) -> np.ndarray:
    n = len(ends) - 1
    near = np.zeros((n, n), np.uint8)
    near[np.repeat(np.arange(n), np.diff(ends)), targets] = 1
    return near


def _times(rows: np.ndarray, near: np.ndarray, back: bool = False, block: int = 1_024) -> np.ndarray:
    """rows @ near, or its transpose, by blocks of near."""
    found = np.zeros(rows.shape, rows.dtype)
    for k in range(0, len(near), block):
        some = near[k : k + block].astype(rows.dtype)
        if back:
            found[:, k : k + block] = rows @ some.T
        else:
            found += rows[:, k : k + block] @ some
    return found


def _dependencies_by_matrix(sources: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The sum of _dependencies() of some sources in a dense graph: all their searches go on a level at a time as products of matrices.

    Numbers of paths are whole and take half the time as small floats while these hold them exactly."""
    paths = near[sources].astype(np.float64)
    seen = paths > 0
    seen[np.arange(len(sources)), sources] = True
    paths[np.arange(len(sources)), sources] = 0
    levels, reachable = [paths], near.any(axis=0)
    while not seen[:, reachable].all():
        exact = paths.sum(axis=1).max() < 1 << 24
        paths = _times(paths.astype(np.float32), near).astype(np.float64) if exact else _times(paths, near)
        paths[seen] = 0
        if not paths.any():
            break
        seen |= paths > 0
        levels.append(paths)
    share = np.zeros_like(levels[-1])
    total = np.zeros(len(near))
    for above, here in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        total += share.sum(axis=0)
        share = above * _times(np.divide(1 + share, here, out=np.zeros_like(share), where=here > 0), near, back=True)
    return total + share.sum(axis=0)


def _neighbours(nodes: np.ndarray, ends: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends[nodes + 1] - ends[nodes]
    at = np.repeat(ends[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.repeat(nodes, sizes), targets[at]


def _dependencies(source: int, ends: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Each vertex's share in the shortest paths from one source, whole levels at a time."""
    n = len(ends) - 1
    paths, level = np.zeros(n), np.full(n, -1)
    paths[source], level[source] = 1, 0
    frontier, steps = np.array([source]), []
    while len(frontier):
        a, b = _neighbours(frontier, ends, targets)
        fresh = level[b] == -1
        depth = level[frontier[0]] + 1
        level[b[fresh]] = depth
        on = level[b] == depth
        a, b = a[on], b[on]
        paths += np.bincount(b, paths[a], n)
        steps.append((a, b))
        frontier = np.unique(b)
    share = np.zeros(n)
    for a, b in reversed(steps):
        share += np.bincount(a, paths[a] / paths[b] * (1 + share[b]), n)
    share[source] = 0
    return share


def _betweenness_by_levels(vertices: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same sums with a table for each level of all searches."""
    edges = written(edges, "arcs")
    frontier = written(starts.select(F.col("id").alias("start"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")
    seen, levels = frontier.select("start", "v"), [frontier]
    while True:
        step = frontier.join(edges, F.col("v") == F.col("src")).groupBy("start", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        frontier = written(step.join(seen, ["start", "v"], "left_anti"), "level")
        if frontier.isEmpty():
            break
        seen = written(seen.union(frontier.select("start", "v")), "seen")
        levels.append(frontier)
    share, total = levels[-1].withColumn("share", F.lit(0.0)), None
    for above in reversed(levels[:-1]):
        part = share.filter("start <> v").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("value"))
        total = part if total is None else total.union(part)
        lower = share.select("start", F.col("v").alias("dst"), F.col("paths").alias("p2"), F.col("share").alias("s2"))
        passed = above.join(edges, F.col("v") == F.col("src")).join(lower, ["start", "dst"])
        passed = passed.groupBy("start", "v").agg(F.sum(F.col("paths") / F.col("p2") * (1 + F.col("s2"))).alias("share"))
        share = written(above.join(passed, ["start", "v"], "left").na.fill({"share": 0.0}), "share")
    sums = total.groupBy("id").agg(F.sum("value").alias("value")) if total is not None else None
    if sums is None:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    return vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("betweenness"))


# Rankings over metrics


def mean_ranks(values: DataFrame, key: str, metrics: list[str], descending: bool = False) -> DataFrame:
    """(key, one column for each metric): the rank of its value, from 1; equal values share the mean of their ranks.

    Different values are counted first and ranked by running(), so no task orders all vertices; all metrics go together.
    """
    long = written(values.select(key, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(key, metrics, "metric", "value"), "metrics")
    groups = written(long.groupBy("metric", "value").agg(F.count("*").alias("n")), "groups")
    value = F.col("value").desc() if descending else F.col("value").asc()
    upto = written(running(groups, [F.col("metric"), value], upto=F.col("n")), "upto")
    first = upto.groupBy("metric").agg(F.min(F.col("upto") - F.col("n")).alias("before"))
    ranks = upto.join(F.broadcast(first), "metric").select("metric", "value", (F.col("upto") - F.col("before") - (F.col("n") - 1) / 2).alias("rank"), "n")  # a row per metric
    found = join_counted(long, written(ranks, "ranks"), ["metric", "value"], "n")
    return found.groupBy(key).agg(*(F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(m) for m in metrics))


def top_by_metric(values: DataFrame, key: str, metrics: list[str], n: int = 20) -> DataFrame:
    """(metric, rank, key, value): the n greatest of each metric; of equal ones the first by key."""
    long = values.select(key, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(key, metrics, "metric", "value")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), key))
    return long.withColumn("rank", rank).filter(F.col("rank") <= n).select("metric", "rank", key, "value")


def connectors(values: DataFrame, key: str, degree: str = "in_degree", between: str = "betweenness", others: bool = False) -> DataFrame:
    """(key, kind, degree_pct, betweenness_pct): connector (high betweenness, moderate degree) or mega_hub (both very high), by mean rank over the number of rows.

    The others are left out, or have no kind."""
    n = values.count()
    ranked = mean_ranks(values, key, [degree, between]).select(key, (F.col(degree) / n).alias("d"), (F.col(between) / n).alias("b"))
    kind = F.when((F.col("b") > 0.95) & (F.col("d") > 0.95), "mega_hub").when((F.col("b") > 0.90) & (F.col("d") < 0.75), "connector")
    found = ranked.select(key, kind.alias("kind"), F.col("d").alias("degree_pct"), F.col("b").alias("betweenness_pct"))
    return found if others else found.filter("kind is not null")


def composite_rank(values: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, composite): the mean over metrics of the rank from the greatest, equal values sharing the mean rank."""
    ranks = mean_ranks(values, key, metrics, descending=True)
    return ranks.select(key, (sum((F.col(m) for m in metrics[1:]), F.col(metrics[0])) / len(metrics)).alias("composite"))


def composite_top(values: DataFrame, key: str, metrics: list[str], n: int = 15) -> DataFrame:
    """(rank, key, composite, and the metrics) of the n best by composite rank; of equal ones the first by key."""
    best = composite_rank(values, key, metrics).orderBy("composite", key).limit(n)
    rank = F.row_number().over(Window.orderBy("composite", key))  # n rows
    return best.select(rank.alias("rank"), key, "composite").join(values.select(key, *metrics), key)


def correlations(values: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every two metrics, in one pass."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    # Null where a metric has one value only.
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    row = values.agg(*(corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")
