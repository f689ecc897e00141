"""Communities: quality of a given partition, detection, and what communities consist of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.components import components
from tripweave.operators.graph import SHARED_EDGES, Graph, _tasks, arrays, in_parts, linked, weak_labels
from tripweave.sources.shared import written

#: Passes of simultaneous moves without a better quality, after which moves are kept apart; what a move must gain.
PATIENCE, LEAST_GAIN = 3, 1e-9
#: Tasks take components of so many edges together, or one that has more.
TASK_EDGES = 500_000


def cpm_quality(graph: Graph, membership: DataFrame, resolution: float = 0.01, weighted: bool = False) -> DataFrame:
    """One row `quality`: over communities, edges inside less resolution times ordered pairs of members (constant Potts model)."""
    ids = membership.select("id", "community")
    ends = graph.edges.join(ids.toDF("src", "c1"), "src").join(ids.toDF("dst", "c2"), "dst").filter("c1 = c2")
    inside = ends.groupBy(F.col("c1").alias("community")).agg(F.sum(F.col("weight") if weighted else F.lit(1.0)).alias("inside"))
    sizes = ids.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.join(inside, "community", "left").agg(F.sum(F.coalesce("inside", F.lit(0.0)) - resolution * F.col("n") * (F.col("n") - 1)).alias("quality"))


def modularity(graph: Graph, membership: DataFrame) -> DataFrame:
    """One row `modularity` of the graph with edges taken both ways, each counting once; 0 without edges."""
    ids = membership.select("id", "community")
    ends = graph.edges.join(ids.toDF("src", "c1"), "src").join(ids.toDF("dst", "c2"), "dst")
    parts = ends.select(F.explode(F.array(F.struct(F.col("c1").alias("c"), (F.col("c1") == F.col("c2")).cast("int").alias("inside")), F.struct(F.col("c2").alias("c"), F.lit(0).alias("inside")))).alias("x")).select("x.*")
    sums = parts.groupBy("c").agg(F.sum("inside").alias("inside"), F.count("*").alias("degree"))
    m2 = F.sum("degree")
    return sums.agg(F.coalesce(F.when(m2 > 0, F.sum("inside") * 2 / m2 - F.sum(F.col("degree").cast("double") * F.col("degree")) / (m2 * m2)), F.lit(0.0)).alias("modularity"))


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.count("*").alias("size"))


def top_members(rows: DataFrame, group: str, value: str, order: Column, n: int = 5) -> DataFrame:
    """(group, top): the first n values of each group, as text."""
    by = Window.partitionBy(group).orderBy(order, value)
    best = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", value)))  # n at most
    return best.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[value]), ", ").alias("top"))


def dominant(rows: DataFrame, group: str, value: str, weight: Column | None = None) -> DataFrame:
    """(group, value, count, total, share): each group's most frequent value, nulls aside; of equal ones the first."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("count"))
    by = Window.partitionBy(group)
    ranked = counts.select("*", F.row_number().over(by.orderBy(F.desc("count"), value)).alias("_n"), F.sum("count").over(by).alias("total"))
    return ranked.filter("_n = 1").select(group, value, "count", "total", (F.col("count") / F.col("total")).alias("share"))


def purity(share: Column) -> Column:
    return F.when(share >= 0.9, "ISOLATED").when(share >= 0.3, "Regional").otherwise("Mixed")


def airport_summary(membership: DataFrame, nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """(community, size, top_airports by PageRank, top_states): nodes has id, code, state; ranks has id, pagerank."""
    rows = membership.join(nodes.select("id", "code", "state"), "id").join(ranks, "id", "left")
    states = rows.filter("state is not null").groupBy("community", "state").agg(F.count("*").alias("n"))
    out = sizes(rows).join(top_members(rows, "community", "code", F.col("pagerank").desc_nulls_last()).withColumnRenamed("top", "top_airports"), "community", "left")
    return out.join(top_members(states, "community", "state", F.desc("n"), 3).withColumnRenamed("top", "top_states"), "community", "left")


def airline_by_community(membership: DataFrame, nodes: DataFrame, departures: DataFrame) -> DataFrame:
    """(community, carrier, count, total, share) of the carrier with most departures from a community's airports (null without any).

    nodes has id and code; departures has code, carrier and count, one row for each airport and carrier.
    """
    rows = membership.select("id", "community").join(nodes.select("id", "code"), "id", "left").join(departures, "code", "left")
    best = dominant(rows, "community", "carrier", F.col("count"))
    return membership.select("community").distinct().join(best, "community", "left")


def flight_summary(membership: DataFrame, flights: DataFrame) -> DataFrame:
    """(community, size, and the dominant carrier, origin and dest): flights has id, carrier, origin, dest."""
    rows = membership.join(flights.select("id", "carrier", "origin", "dest"), "id")
    out = sizes(rows)
    for c in ("carrier", "origin", "dest"):
        out = out.join(dominant(rows, "community", c).select("community", F.col(c).alias(f"dominant_{c}")), "community", "left")
    return out


def geographic_composition(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, size, top_state, top_count, top_share rounded to 3, label, sample of 10 codes)."""
    rows = membership.join(nodes.select("id", "code", "state"), "id")
    top = dominant(rows, "community", "state").select("community", F.col("state").alias("top_state"), F.col("count").alias("top_count"))
    out = sizes(rows).join(top, "community", "left").join(top_members(rows, "community", "code", F.lit(1).asc(), 10).withColumnRenamed("top", "sample"), "community", "left")
    return out.withColumn("top_share", F.round(F.col("top_count") / F.col("size"), 3)).withColumn("label", purity(F.col("top_share")))


# Detection


def leiden_cpm(graph: Graph, resolution: float = 0.01, seed: int = 42, runs: int = 10, weighted: bool = False) -> DataFrame:
    """(id, community): of each weak component the best of several seeded runs by CPM quality; of equal ones the earliest. Without vertices no rows.

    A run starts from vertices alone. Vertices move to the neighbouring community that gains most until none gains, all at the same time (see moving());
    communities are split into their connected parts; the parts become the vertices of a smaller graph, and so on until nothing is joined any more. A community
    is named after its least vertex, and is connected. The draws depend on seed, run, level, pass and vertex alone, and a component goes on as if it were alone, so the result is the same at every
    size and on any cluster: graphs that fit a kernel are worked through by one task a run, larger ones by component, and components that are too large for a task in tables by the same rule.
    """
    edges = graph.undirected().select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("weight")).filter("src <> dst")
    edges = written(edges, "edges")
    vertices = graph.vertices.select("id")
    if Graph(vertices, edges).small(SHARED_EDGES):
        return _best_in_memory(vertices, edges, resolution, seed, runs)
    return _best_in_parts(vertices, edges, resolution, seed, runs)


def _best_in_memory(vertices: DataFrame, edges: DataFrame, resolution: float, seed: int, runs: int) -> DataFrame:
    """The best runs on a graph that fits a task, one run per task."""
    src, dst, weight = arrays(edges)
    names = np.sort(arrays(vertices)[0].astype(np.int64))
    shared = edges.sparkSession.sparkContext.broadcast((names, *(np.searchsorted(names, x).astype(np.int32) for x in (src, dst)), weight))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run in batch.id:
                names, a, b, w = shared.value
                whole = weak_labels(a, b, len(names))
                community = run_in_memory(names, a, b, w, resolution, seed + int(run))
                yield pd.DataFrame({"run": int(run), "component": whole, "quality": _qualities(names, a, b, w, community, whole, resolution)[whole], "id": names, "community": community})

    found = written(edges.sparkSession.range(runs).repartition(runs).mapInPandas(kernel, "run long, component long, quality double, id long, community long"), "runs")
    best = found.groupBy("component").agg(F.max(F.struct("quality", (-F.col("run")).alias("turn"))).alias("x")).select("component", (-F.col("x.turn")).alias("run"))
    return found.join(best, ["component", "run"]).select("id", "community")


def _qualities(names: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, community: np.ndarray, whole: np.ndarray, resolution: float) -> np.ndarray:
    """The CPM quality inside each component, by its label."""
    inside, place = community[a] == community[b], np.searchsorted(names, community)
    size = np.bincount(place, minlength=len(names)).astype(np.float64)
    return np.bincount(whole[a[inside]], w[inside], len(names)) - resolution * np.bincount(whole, size * (size - 1), len(names))


def _best_in_parts(vertices: DataFrame, edges: DataFrame, resolution: float, seed: int, runs: int) -> DataFrame:
    """The best runs on a graph of any size, by weak components: what joins or parts vertices never looks beyond one."""
    parts = in_parts(edges, vertices, F.lit(1))
    n = max(_tasks(edges), -(-edges.count() // TASK_EDGES))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        src, dst, w = (rows[c].to_numpy() for c in ("src", "dst", "weight"))
        names = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(names, src), np.searchsorted(names, dst)
        whole = weak_labels(a, b, len(names))
        best, quality = None, np.full(len(names), -np.inf)
        for run in range(runs):
            found = run_in_memory(names, a, b, w, resolution, seed + run)
            reached = _qualities(names, a, b, w, found, whole, resolution)
            better = reached > quality
            best, quality = found if best is None else np.where(better[whole], found, best), np.where(better, reached, quality)
        return pd.DataFrame({"id": names, "community": best})

    dealt = parts.edges.select("src", "dst", "weight", F.pmod(F.xxhash64("component"), F.lit(n)).alias("part"))
    found = dealt.groupBy("part").applyInPandas(kernel, "id long, community long").union(parts.lone_starts.select("id", F.col("id").alias("community")))
    if parts.large_edges.isEmpty():
        return found
    members = written(linked(parts.large_edges).select(F.col("node").alias("id"), "component"), "members")
    for row in members.select("component").distinct().orderBy("component").collect():  # each has over KERNEL_EDGES edges, so they are few
        own = members.filter(F.col("component") == row.component).select("id")
        within = written(parts.large_edges.join(own.toDF("src"), "src").select("src", "dst", "weight"), "edges")
        best, quality = None, 0.0
        for run in range(runs):
            ids = _run_in_tables(own, within, resolution, seed + run)
            reached = _quality(within, ids.withColumn("size", F.lit(1).cast("long")), resolution)
            if best is None or reached > quality:
                best, quality = ids, reached
        found = found.union(best)
    return found


def nested(graph: Graph, most_size: int | None = None, resolution: float = 0.01, seed: int = 42, runs: int = 1, weighted: bool = False) -> DataFrame:
    """(id, community, level): Leiden communities, those of more than most_size members (half of all by default) split again.

    A level takes the communities that are too large, with the edges inside them, at twice the resolution of the one
    before, until none is left: at a resolution above all weights every vertex is alone. A community's name
    is its smallest member, and level says at which splitting (from 0) it came about; the last assignment counts.
    """
    if resolution <= 0:
        raise ValueError("the resolution must be above 0")
    most = max(1, graph.vertices.count() // 2 if most_size is None else most_size)
    left, done, level = graph, None, 0
    while True:
        parts = leiden_cpm(left, resolution, seed, runs, weighted)
        parts = parts.groupBy("community").agg(F.min("id").alias("name"), F.count("*").alias("n")).join(parts, "community").select("id", F.col("name").alias("community"), F.lit(level).alias("level"), "n")
        parts = written(parts, "nested")
        kept = parts.filter(F.col("n") <= most).drop("n")
        done = kept if done is None else done.union(kept)
        large = parts.filter(F.col("n") > most)
        if large.isEmpty():
            return done
        ends = large.select("id", "community")
        inside = left.edges.join(ends.toDF("src", "c1"), "src").join(ends.toDF("dst", "c2"), "dst").filter("c1 = c2")
        left = Graph(large.select("id"), written(inside.select("src", "dst", "weight"), "inside"))
        level, resolution = level + 1, 2 * resolution


def _longs(*values: int) -> list[Column]:
    return [F.lit(v).cast("long") for v in values]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def draws(ids: np.ndarray, *first: int) -> np.ndarray:
    """What Spark's xxhash64 gives for numbers and then an id, each a long."""
    left = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(ids), 42, np.uint64)
    for value in (*first, ids):
        value = value.astype(np.int64).view(np.uint64) if isinstance(value, np.ndarray) else np.full(len(ids), value, np.int64).view(np.uint64)
        h = (h + _P5 + np.uint64(8)) ^ (left(value * _P2, 31) * _P1)
        h = left(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def run_in_memory(names: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """Each name's community, for undirected edges (a, b, w) given by places among the sorted names. Weak components go on together, each as if it were alone."""
    place, level, size, ids = np.arange(len(names)), 0, np.ones(len(names), np.int64), names
    whole = np.unique(weak_labels(a, b, len(names)), return_inverse=True)[1]
    while len(ids):
        community = _moved_in_memory(ids, a, b, w, size, resolution, (seed, level), whole)
        inside = community[a] == community[b]
        part = weak_labels(a[inside], b[inside], len(ids))
        kept, part = np.unique(part, return_inverse=True)  # the least vertex of each part
        place = part[place]
        if len(kept) == len(ids):
            break
        joined = np.bincount(whole) > np.bincount(whole[kept])
        a, b, whole = part[a], part[b], whole[kept]
        other = (a != b) & joined[whole[a]]  # where nothing was joined, a component is done
        keys, back = np.unique(np.minimum(a, b)[other] * len(kept) + np.maximum(a, b)[other], return_inverse=True)
        w = np.bincount(back, w[other], len(keys))
        a, b, size, ids, level = keys // len(kept), keys % len(kept), np.bincount(part, size, len(kept)).astype(np.int64), ids[kept], level + 1
    return ids[place] if len(ids) else names


def _moved_in_memory(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, size: np.ndarray, resolution: float, seeds: tuple[int, int], whole: np.ndarray) -> np.ndarray:
    """moving() with arrays, for several components at once: whole numbers each vertex's."""
    n, parts = len(ids), whole.max() + 1
    now, around = np.arange(n), _Around(n, a, b, w)
    apart, best_now, quality, idle, k = np.zeros(parts, bool), now, np.zeros(parts), np.zeros(parts, np.int64), 0
    while True:
        total = np.bincount(now, size, n).astype(np.int64)
        v, c, toward = around.of(now)
        stays = c == now[v]
        gain = toward - (2 * resolution) * (size[v] * (total[c] - np.where(stays, size[v], 0))).astype(np.float64)
        most = np.maximum.reduceat(gain, np.flatnonzero(np.append(True, v[1:] != v[:-1])))
        equal, best = np.flatnonzero(gain == most[v]), np.empty(n, np.int64)
        for some in (equal[::-1], equal[stays[equal]]):  # the least one, or else its own; the last that is put down counts
            best[v[some]] = some
        own = gain[stays]  # both by vertex
        wish = np.flatnonzero(gain[best] > own + LEAST_GAIN)
        if not len(wish):
            return now
        to, draw, late = c[best][wish], draws(ids[wish], *seeds, k), apart[whole[wish]]
        moves = draw % 2 == 0
        if late.any():
            turn = np.empty(len(wish), np.int64)
            turn[np.lexsort((wish, draw))] = np.arange(len(wish))
            first = np.full(n, len(wish))
            np.minimum.at(first, now[wish], turn)
            np.minimum.at(first, to, turn)
            moves = np.where(late, (first[now[wish]] == turn) & (first[to] == turn), moves)
        now = now.copy()
        now[wish[moves]] = to[moves]
        k += 1
        going = np.bincount(whole[wish], minlength=parts).astype(bool) & ~apart  # the others came to rest, or go on apart
        if not going.any():
            continue
        inside = now[a] == now[b]
        sums = np.bincount(now, size, n)
        reached = np.bincount(whole[a[inside]], w[inside], parts) - resolution * np.bincount(whole, sums * (sums - 1), parts)
        better = going & (reached > quality)
        best_now, quality = np.where(better[whole], now, best_now), np.where(better, reached, quality)
        idle = np.where(better, 0, idle + going)
        turned = going & (idle == PATIENCE)
        now, apart = np.where(turned[whole], best_now, now), apart | turned


#: So many sums of weights of vertices toward communities are held at a time.
CELLS = 4_000_000


class _Around:
    """What undirected edges (a, b, w) between n places weigh from each vertex to each community around it, as memberships change."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        src, order = np.concatenate([a, b]), np.argsort(np.concatenate([a, b]), kind="stable")
        self.n, self.src, self.dst, self.weight = n, src[order].astype(np.int64), np.concatenate([b, a])[order].astype(np.int32), np.concatenate([w, w])[order]
        self.ends = np.searchsorted(self.src, np.arange(n + 1))
        #: Sums of whole numbers are exact, so they can be kept up as vertices move.
        self.whole, self.above = bool((w == np.rint(w)).all()), bool((w > 0).all())
        self.before, self.names, self.sums = None, None, None

    def of(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vertex, community, weight) of each community around a vertex, and of its own; by vertex, then community."""
        names, column = np.unique(now, return_inverse=True)
        if not self.above or self.n * len(names) > 16 * len(self.src):
            keys, back = np.unique(np.concatenate([self.src * self.n + now[self.dst], np.arange(self.n) * self.n + now]), return_inverse=True)
            return keys // self.n, keys % self.n, np.bincount(back[: len(self.src)], self.weight, len(keys))
        if self.sums is not None and self._kept_up(now, names):
            return self._present(0, self.sums.ravel(), self.names, np.searchsorted(self.names, now))
        step, found = max(1, CELLS // len(names)), []
        for k in range(0, self.n, step):
            to = min(self.n, k + step)
            own = slice(self.ends[k], self.ends[to])
            sums = np.bincount((self.src[own] - k) * len(names) + column[self.dst[own]], self.weight[own], (to - k) * len(names))
            found.append(self._present(k, sums, names, column[k:to]))
        if self.whole and len(found) == 1:
            self.before, self.names, self.sums = now, names, sums.reshape(self.n, len(names))
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _present(self, first: int, sums: np.ndarray, names: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = sums > 0
        there[np.arange(len(column)) * len(names) + column] = True
        at = np.flatnonzero(there)
        return at // len(names) + first, names[at % len(names)], sums[at]

    def _kept_up(self, now: np.ndarray, names: np.ndarray) -> bool:
        """Brings the sums up to date, if few vertices have moved, among communities of which most are left."""
        moved = np.flatnonzero(now != self.before)
        sizes = self.ends[moved + 1] - self.ends[moved]
        if 2 * len(names) < len(self.names) or 4 * sizes.sum() > len(self.src) or not np.isin(now[moved], self.names).all():
            return False
        if len(moved):
            arc = np.concatenate([np.arange(self.ends[m], self.ends[m + 1]) for m in moved])
            for membership, sign in ((self.before, -1), (now, 1)):
                np.add.at(self.sums, (self.dst[arc], np.repeat(np.searchsorted(self.names, membership[moved]), sizes)), sign * self.weight[arc])
        self.before = now
        return True


def _run_in_tables(vertices: DataFrame, edges: DataFrame, resolution: float, seed: int) -> DataFrame:
    """(id, community) by the same rule in tables."""
    sized, level = written(vertices.select("id", F.lit(1).cast("long").alias("size")), "sizes"), 0
    place = sized.select("id", F.col("id").alias("at"))
    while True:
        arcs = written(edges.union(edges.select("dst", "src", "weight")), "arcs")
        community = moving(sized, arcs, resolution, (seed, level))
        inside = arcs.filter("src < dst").join(community.toDF("src", "c1"), "src").join(community.toDF("dst", "c2"), "dst").filter("c1 = c2")
        linked = components(inside, "src", "dst").toDF("node", "part")
        parts = written(sized.join(linked, F.col("id") == F.col("node"), "left").select(F.col("id").alias("at"), "size", F.coalesce("part", "id").alias("part")), "parts")
        place = written(place.join(parts.select("at", "part"), "at").select("id", F.col("part").alias("at")), "place")
        before, sized = sized.count(), written(parts.groupBy(F.col("part").alias("id")).agg(F.sum("size").alias("size")), "sizes")
        if sized.count() == before:
            return place.select("id", F.col("at").alias("community"))
        of = parts.select("at", "part")
        ends = edges.join(of.toDF("src", "x"), "src").join(of.toDF("dst", "y"), "dst").filter("x <> y")
        edges = written(ends.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
        level += 1


def moving(sized: DataFrame, arcs: DataFrame, resolution: float, seeds: tuple[int, int]) -> DataFrame:
    """(id, community) by moves until no vertex gains by one; sized: id, size; arcs: each edge both ways.

    In a pass every vertex looks for the community around it that gains most (of equal ones its own, else the least), and a hash decides which half of
    those who would gain may move, so neighbours don't swap for ever. Once PATIENCE passes of such simultaneous moves didn't raise
    the CPM quality, the best membership is taken up again, and from then on no two moves of a pass touch the same community: then each raises the quality by what it gains, so the search ends.
    """
    now = written(sized.select("id", "size", F.col("id").alias("community")), "membership")
    apart, best_now, quality, idle, k = False, now, 0.0, 0, 0
    while True:
        totals = now.groupBy("community").agg(F.sum("size").alias("n"))
        toward = arcs.join(now.select(F.col("id").alias("dst"), F.col("community").alias("c")), "dst").groupBy("src", "c").agg(F.sum("weight").alias("w"))
        options = toward.union(now.select("id", "community", F.lit(0.0))).groupBy("src", "c").agg(F.sum("w").alias("w"))
        gains = options.join(totals.toDF("c", "n"), "c").join(now.toDF("src", "size", "mine"), "src").withColumn("stays", F.col("c") == F.col("mine"))
        others = F.col("n") - F.when(F.col("stays"), F.col("size")).otherwise(0)
        gains = gains.withColumn("gain", F.col("w") - F.lit(2 * resolution) * (F.col("size") * others).cast("double"))
        best = gains.groupBy("src", "mine").agg(F.max(F.struct("gain", F.col("stays").cast("int").alias("stay"), (-F.col("c")).alias("c"))).alias("x"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("own"))
        wishes = best.filter(F.col("x.gain") > F.col("own") + LEAST_GAIN).select(F.col("src").alias("id"), "mine", (-F.col("x.c")).alias("to"), F.xxhash64(*_longs(*seeds, k), F.col("src").cast("long")).alias("draw"))
        wishes = written(wishes, "wishes")
        if wishes.isEmpty():
            return now.select("id", "community")
        moves = _apart(wishes) if apart else wishes.filter("draw % 2 = 0")
        now, k = written(now.join(moves.select("id", "to"), "id", "left").select("id", "size", F.coalesce("to", "community").alias("community")), "membership"), k + 1
        if apart:
            continue
        if (reached := _quality(arcs, now, resolution)) > quality:
            best_now, quality, idle = now, reached, 0
        elif (idle := idle + 1) == PATIENCE:
            now, apart = best_now, True


def _apart(wishes: DataFrame) -> DataFrame:
    """Those of the wished moves that draw lowest of all that touch the community they leave or the one they join."""
    wishes = wishes.withColumn("turn", F.struct("draw", "id"))
    first = wishes.select(F.explode(F.array("mine", "to")).alias("c"), "turn").groupBy("c").agg(F.min("turn").alias("first"))
    leaving = wishes.join(first.toDF("mine", "first"), "mine").filter("turn = first").drop("first")
    return leaving.join(first.toDF("to", "first"), "to").filter("turn = first").drop("first", "turn")


def _quality(arcs: DataFrame, membership: DataFrame, resolution: float) -> float:
    """CPM quality over edges, of which those that rise count, so they may stand both ways; pairs are whole numbers, so they add up alike in any order."""
    ids = membership.select("id", "community")
    inside = arcs.filter("src < dst").join(ids.toDF("src", "c1"), "src").join(ids.toDF("dst", "c2"), "dst").filter("c1 = c2").agg(F.sum("weight")).first()[0]
    pairs = membership.groupBy("community").agg(F.sum("size").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
    return (inside or 0.0) - resolution * float(pairs or 0)
