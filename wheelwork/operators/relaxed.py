"""Searches on street graphs of any size, by joins: costs, routes, path counts, betweenness, service areas.

A pair of source and node is one row. Rounds go over rows that changed; each is written to the
shared folder and the one before it is deleted, so folders do not pile up. Weights are positive, so the
cheapest paths of a source form a graph without rings, and what is passed along it comes to an end
after as many rounds as its longest path has edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.operators.lineage import drop_written, written

#: Costs that differ by no more are equal.
SAME = 1e-9


def _relaxed(known: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """source, node, cost after one more edge."""
    further = known.join(edges, known["node"] == edges["u"]).select("source", F.col("v").alias("node"), (F.col("cost") + F.col(weight)).alias("cost"))
    return known.select("source", "node", "cost").unionAll(further).groupBy("source", "node").agg(F.min("cost").alias("cost"))


def reach(edges: DataFrame, sources: DataFrame, weight: str, steps: int) -> DataFrame:
    """source, node, cost over at most ``steps`` edges."""
    known = written(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")))
    for _ in range(steps):
        old, known = known, written(_relaxed(known, edges, weight))
        drop_written(old)
    return known


def costs(edges: DataFrame, sources: DataFrame, weight: str, limit: float = float("inf")) -> DataFrame:
    """source, node, cost of the cheapest path to every node in reach (within ``limit``).

    Only nodes whose cost fell in a round are followed in the next one, until none falls.
    """
    known = written(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")).where("node IS NOT NULL").distinct(), "costs")
    fresh = written(known, "fallen")
    while not fresh.isEmpty():
        further = fresh.join(edges, fresh["node"] == edges["u"]).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col(weight)).alias("cost")).where(F.col("cost") <= limit)
        old = known.select("source", "node", F.col("cost").alias("_old"))
        fallen = written(further.join(old, ["source", "node"], "left").where("_old IS NULL OR cost < _old").select("source", "node", "cost"), "fallen")
        now = written(known.unionAll(fallen).groupBy("source", "node").agg(F.min("cost").alias("cost")), "costs")
        drop_written(known, fresh)
        known, fresh = now, fallen
    drop_written(fresh)
    return known


def _least(edges: DataFrame, weight: str, length: str) -> DataFrame:
    """u, v, w, l: parallel edges by their least weight."""
    x = F.min(F.struct(F.col(weight).cast("double").alias("w"), F.col(length).cast("double").alias("l")))
    return edges.groupBy("u", "v").agg(x.alias("x")).select("u", "v", "x.w", "x.l")


def cheapest_edges(known: DataFrame, edges: DataFrame) -> DataFrame:
    """source, u, v, l: edges (u, v, w, l) on cheapest paths of each source."""
    start = known.select("source", F.col("node").alias("u"), F.col("cost").alias("_a"))
    end = known.select("source", F.col("node").alias("v"), F.col("cost").alias("_b"))
    return start.join(edges, "u").join(end, ["source", "v"]).where(F.col("_a") + F.col("w") <= F.col("_b") + SAME).select("source", "u", "v", "l")


def routes(edges: DataFrame, pairs: DataFrame, weight: str = "weight") -> DataFrame:
    """origin, destination, route (array of nodes, null: none), cost for distinct pairs; see ``routing.shortest_paths``."""
    asked = written(pairs.select("origin", "destination").distinct(), "asked")
    edges = written(_least(edges, weight, weight), "least")
    there = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    known = costs(edges, asked.select(F.col("origin").alias("node")).distinct().join(there, "node", "left_semi"), "w")
    before = written(cheapest_edges(known, edges).groupBy("source", F.col("v").alias("node")).agg(F.min("u").alias("before")), "before")
    ends = asked.join(known, (F.col("origin") == F.col("source")) & (F.col("destination") == F.col("node"))).select("origin", "destination", "cost")
    growing = written(ends.select("origin", "destination", F.col("destination").alias("at"), F.array("destination").alias("route")), "growing")
    done = None
    while not growing.isEmpty():
        # routes that have come to their origin are kept, the others take one more step back
        home = written(growing.where("at = origin").select("origin", "destination", "route"), "home")
        done = home if done is None else done.unionAll(home)
        step = growing.where("at <> origin").join(before, (F.col("origin") == F.col("source")) & (F.col("at") == F.col("node")))
        old, growing = growing, written(step.select("origin", "destination", F.col("before").alias("at"), F.concat(F.array("before"), "route").alias("route")), "growing")
        drop_written(old)
    found = ends.join(done, ["origin", "destination"]) if done is not None else ends.withColumn("route", F.array("origin")).limit(0)
    return asked.join(found, ["origin", "destination"], "left").select("origin", "destination", "route", "cost")


def betweenness(edges: DataFrame, sources: DataFrame, weight: str, length: str, lower: float, upper: float, pair_weight: str, node_weights: dict[int, float]) -> DataFrame:
    """u, v, betweenness of edges on cheapest paths; see ``routing.betweenness``.

    Numbers of paths are passed forwards along the cheapest edges, what each end is worth
    backwards, a round an edge; an end's share goes to the edges before it by numbers of paths.
    """
    edges = written(_least(edges, weight, length), "least")
    there = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    known = costs(edges, sources.select("node").distinct().join(there, "node", "left_semi"), "w")
    dag = written(cheapest_edges(known, edges), "dag")
    front = written(known.where("source = node").select("source", "node", F.lit(1.0).alias("n"), F.lit(0.0).alias("span")), "front")
    counts = front
    while True:
        step = front.join(dag.withColumnRenamed("u", "node"), ["source", "node"])
        front = written(step.groupBy("source", F.col("v").alias("node")).agg(F.sum("n").alias("n"), F.min(F.col("span") + F.col("l")).alias("span")), "front")
        if front.isEmpty():
            break
        counts = counts.unionAll(front)
    counts = written(counts.groupBy("source", "node").agg(F.sum("n").alias("n"), F.min("span").alias("span")), "counts")
    spark = edges.sparkSession
    own = spark.createDataFrame([(int(k), float(v)) for k, v in node_weights.items()], "_k bigint, _w double")
    weighted = counts.join(own.withColumnsRenamed({"_k": "source", "_w": "_s"}), "source", "left").join(own.withColumnsRenamed({"_k": "node", "_w": "_t"}), "node", "left")
    both, span = F.coalesce("_s", F.lit(1.0)) * F.coalesce("_t", F.lit(1.0)), F.col("span")
    worth = {"count": F.lit(1.0), "spatial": both, "multiplication": both, "gravity": F.when(span != 0, both / (span * span)).otherwise(0.0), "exponential": both * F.exp(-span)}[pair_weight]
    back = written(weighted.where("source <> node").where(span.between(lower, upper)).select("source", "node", worth.alias("x")), "back")
    start, end = counts.select("source", F.col("node").alias("u"), F.col("n").alias("_nu")), counts.select("source", F.col("node").alias("v"), F.col("n").alias("_nv"))
    shares = written(dag.join(start, ["source", "u"]).join(end, ["source", "v"]).select("source", "u", "v", (F.col("_nu") / F.col("_nv")).alias("share")), "shares")
    total = None
    while not back.isEmpty():
        parts = written(back.withColumnRenamed("node", "v").join(shares, ["source", "v"]).select("source", "u", "v", (F.col("x") * F.col("share")).alias("x")), "parts")
        summed = written(parts.groupBy("u", "v").agg(F.sum("x").alias("x")), "summed")
        total = summed if total is None else total.unionAll(summed)
        old, back = back, written(parts.where("u <> source").groupBy("source", F.col("u").alias("node")).agg(F.sum("x").alias("x")), "back")
        drop_written(old, parts)
    drop_written(known, dag, shares)
    if total is None:
        return edges.select("u", "v", F.lit(0.0).alias("betweenness")).limit(0)
    return total.groupBy("u", "v").agg(F.sum("x").alias("betweenness"))


def service_area(edges: DataFrame, nodes: DataFrame, limit: float, weight: str) -> DataFrame:
    """node, u, v, share: how much of each edge can be reached within ``limit`` of each node."""
    edges = written(_least(edges, weight, weight), "least")
    known = costs(edges, nodes.select("node").distinct(), "w", limit)
    share = F.when(F.col("w") > 0, F.least(F.lit(1.0), (limit - F.col("cost")) / F.col("w"))).otherwise(1.0)
    return known.withColumnRenamed("node", "u").join(edges, "u").select(F.col("source").alias("node"), "u", "v", share.alias("share")).where("share > 0")
