"""Searches on street graphs: shortest paths, edge betweenness, service areas.

A graph of at most ``MOST_EDGES`` edges (some 100 MB in a worker) is written to the shared
folder, and each worker reads it once as adjacency arrays; the driver never holds it. Larger
graphs go through ``operators.relaxed``, which relaxes distances with joins and gives the same
results. Sources are spread over tasks; results leave them as rows.

Weights are positive. Of equally cheap paths (to ``SAME``) a route takes, from its end
backwards, the smallest node before each; betweenness divides by their number, and the length
that counts for a pair is that of the shortest of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.operators import relaxed
from wheelwork.operators.lineage import drop_written, uri, written
from wheelwork.operators.relaxed import SAME, costs, reach  # noqa: F401

MOST_EDGES = 4_000_000


class Graph:
    """Adjacency arrays over node numbers; edges (u, v) with a weight and a length."""

    def __init__(self, u, v, weight, length):
        self.nodes = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(self.nodes, u), np.searchsorted(self.nodes, v)
        order = np.lexsort((weight, b, a))
        self.head, self.weight, self.length = b[order], np.asarray(weight, float)[order], np.asarray(length, float)[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))
        self.tail = a[order]
        # edges by their head, for walks backwards
        self.into = np.argsort(self.head, kind="stable")
        self.last = np.searchsorted(self.head[self.into], np.arange(len(self.nodes) + 1))

    def place(self, node) -> int:
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else -1

    def search(self, source: int, targets: set[int] | None = None, limit: float = np.inf, guess: Callable[[int], float] | None = None):
        """Distances from ``source`` by weight to what is settled; with ``guess`` it is A*, which looks at all that may lie on a cheapest path."""
        dist, done, left = {source: 0.0}, set(), set(targets) if targets is not None else None
        most = np.inf
        heap = [(guess(source) if guess else 0.0, source)]
        while heap:
            far, x = heapq.heappop(heap)
            if x in done:
                continue
            if far > most:
                break
            done.add(x)
            if left:
                left.discard(x)
                # equally cheap ways may still come
                most = most if left else far + SAME
            for k in range(self.first[x], self.first[x + 1]):
                y, d = int(self.head[k]), dist[x] + self.weight[k]
                if d <= limit and d < dist.get(y, np.inf):
                    dist[y] = d
                    heapq.heappush(heap, (d + guess(y) if guess else d, y))
        return {x: dist[x] for x in done}

    def path(self, dist: dict, source: int, target: int) -> list[int]:
        """The route to a settled target: backwards by the smallest node before each."""
        out = [target]
        while out[-1] != source:
            y = out[-1]
            edges = self.into[self.last[y] : self.last[y + 1]]
            out.append(min(int(self.tail[k]) for k in edges if dist.get(int(self.tail[k]), np.inf) + self.weight[k] <= dist[y] + SAME))
        return [int(self.nodes[i]) for i in reversed(out)]


@lru_cache(maxsize=1)
def _loaded(path: str) -> Graph:
    """The graph below a path of the shared folder, once in a worker's life."""
    fs, place = pafs.FileSystem.from_uri(path)
    t = pq.read_table(place, filesystem=fs, columns=["u", "v", "w", "l"])
    return Graph(*(t.column(c).to_numpy() for c in ("u", "v", "w", "l")))


class Stored:
    """A graph in the shared folder; ``value`` reads it, in the task that asks."""

    def __init__(self, path: str):
        self.path = path

    @property
    def value(self) -> Graph:
        return _loaded(self.path)


def sent(edges: DataFrame, weight: str, length: str = "length") -> Stored | None:
    """The graph in the shared folder, or None if it is too large for a worker; parallel edges count by their least weight."""
    least = edges.groupBy("u", "v").agg(F.min(F.struct(F.col(weight).cast("double").alias("w"), F.col(length).cast("double").alias("l"))).alias("x"))
    table = written(least.select(F.col("u").cast("bigint"), F.col("v").cast("bigint"), "x.w", "x.l"), "graph")
    n = table.count()
    if n > MOST_EDGES:
        drop_written(table)
        return None
    return Stored(uri(edges.sparkSession, table.written_to))


def shortest_paths(edges: DataFrame, pairs: DataFrame, weight: str = "weight", guess=None) -> DataFrame:
    """origin, destination, route (array of nodes, null: none), cost for distinct pairs, each origin searched once."""
    graph = sent(edges, weight)
    if graph is None:
        return relaxed.routes(edges, pairs, weight)

    def run(frames):
        g = graph.value
        for pdf in frames:
            rows = []
            for origin, ends in pdf.groupby("origin")["destination"]:
                s, places = g.place(origin), {d: g.place(d) for d in set(ends)}
                found = g.search(s, {p for p in places.values() if p >= 0}, guess=guess) if s >= 0 else {}
                for d, p in places.items():
                    rows.append((origin, d, g.path(found, s, p) if p in found else None, found.get(p)))
            yield pd.DataFrame(rows, columns=["origin", "destination", "route", "cost"])

    return pairs.select("origin", "destination").distinct().repartition("origin").sortWithinPartitions("origin").mapInPandas(run, "origin bigint, destination bigint, route array<bigint>, cost double")


def route_edges(routes: DataFrame) -> DataFrame:
    """One row (place, u, v) per edge of each route."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("route") - 1), lambda i: F.struct(i.alias("place"), F.get("route", i - 1).alias("u"), F.get("route", i).alias("v")))
    return routes.where(F.size("route") > 1).select("*", F.explode(pairs).alias("_e")).select(*[c for c in routes.columns if c != "route"], "_e.place", "_e.u", "_e.v")


def edge_usage(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """How many routes use each edge, 0 for unused ones."""
    used = route_edges(routes).groupBy("u", "v").agg(F.count("*").alias("n"))
    return edges.select("u", "v").distinct().join(used, ["u", "v"], "left").select("u", "v", F.coalesce("n", F.lit(0)).alias("n"))


def betweenness(edges: DataFrame, weight: str = "weight", length: str = "length", sources: DataFrame | None = None, lower: float = 0.0, upper: float = float("inf"), pair_weight: str = "count", node_weights: dict[int, float] | None = None, normalized: bool = False) -> DataFrame:
    """Edge betweenness over shortest paths by ``weight``, for pairs whose path length is in [lower, upper].

    A pair adds 1 (``count``), a_s*a_t (``spatial``, ``multiplication``), a_s*a_t/d^2 (``gravity``)
    or a_s*a_t*exp(-d) (``exponential``) to each edge of its path; equal paths share it.
    """
    graph = sent(edges, weight, length)
    nodes = sources if sources is not None else edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node"))).distinct()
    a = node_weights or {}
    if graph is None:
        summed = relaxed.betweenness(edges, nodes, weight, length, lower, upper, pair_weight, a)
        return _whole(edges, summed, normalized)

    def worth(g: Graph, s: int, t: int, d: float) -> float:
        both = a.get(int(g.nodes[s]), 1.0) * a.get(int(g.nodes[t]), 1.0)
        return {"count": 1.0, "spatial": both, "multiplication": both, "gravity": both / d**2 if d else 0.0, "exponential": both * np.exp(-d)}[pair_weight]

    def run(frames):
        g = graph.value
        total = np.zeros(len(g.head))
        for pdf in frames:
            for node in pdf["node"]:
                s = g.place(node)
                if s < 0:
                    continue
                dist, span, count, before, order, heap = {s: 0.0}, {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
                done = set()
                while heap:
                    d, x = heapq.heappop(heap)
                    if x in done:
                        continue
                    done.add(x)
                    order.append(x)
                    for k in range(g.first[x], g.first[x + 1]):
                        y, e, far = int(g.head[k]), d + g.weight[k], span[x] + g.length[k]
                        if e < dist.get(y, np.inf) - SAME:
                            dist[y], span[y], count[y], before[y] = e, far, count[x], [k]
                            heapq.heappush(heap, (e, y))
                        elif abs(e - dist.get(y, np.inf)) <= SAME and y not in done:
                            count[y] += count[x]
                            span[y] = min(span[y], far)
                            before[y].append(k)
                share = {x: (worth(g, s, x, span[x]) if x != s and lower <= span[x] <= upper else 0.0) for x in order}
                for y in reversed(order):
                    for k in before[y]:
                        x = int(g.tail[k])
                        part = share[y] * count[x] / count[y]
                        total[k] += part
                        if x != s:
                            share[x] += part
        used = np.flatnonzero(total)
        yield pd.DataFrame({"u": g.nodes[g.tail[used]], "v": g.nodes[g.head[used]], "part": total[used]})

    parts = nodes.repartition("node").mapInPandas(run, "u bigint, v bigint, part double")
    return _whole(edges, parts.groupBy("u", "v").agg(F.sum("part").alias("betweenness")), normalized)


def _whole(edges: DataFrame, summed: DataFrame, normalized: bool) -> DataFrame:
    """All edges with their betweenness, 0 where no path goes."""
    out = edges.select("u", "v").distinct().join(summed, ["u", "v"], "left").select("u", "v", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    if normalized:
        out = written(out, "betweenness")
        most = out.agg(F.max("betweenness").alias("_m"))
        # where no pair counts, the share is 0 / 0: not a number
        share = F.when(F.col("_m") != 0, F.col("betweenness") / F.col("_m")).otherwise(float("nan"))
        out = out.join(F.broadcast(most)).select("u", "v", share.alias("betweenness"))
    return out


def service_area(edges: DataFrame, nodes: DataFrame, limit: float, weight: str = "length") -> DataFrame:
    """node, u, v, share: how much of each edge can be reached within ``limit`` of each node."""
    graph = sent(edges, weight, weight)
    if graph is None:
        return relaxed.service_area(edges, nodes, limit, weight)

    def run(frames):
        g = graph.value
        for pdf in frames:
            rows = []
            for node in pdf["node"]:
                s = g.place(node)
                if s >= 0:
                    for x, d in g.search(s, limit=limit).items():
                        for k in range(g.first[x], g.first[x + 1]):
                            share = min(1.0, (limit - d) / g.weight[k]) if g.weight[k] > 0 else 1.0
                            if share > 0:
                                rows.append((node, int(g.nodes[x]), int(g.nodes[g.head[k]]), share))
            yield pd.DataFrame(rows, columns=["node", "u", "v", "share"])

    return nodes.select("node").distinct().repartition("node").mapInPandas(run, "node bigint, u bigint, v bigint, share double")
