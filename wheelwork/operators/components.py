"""Connected components of an undirected link table, and statistics of components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.operators.lineage import drop_written, written


def stars(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node, component (its smallest node) for every node of a link between two different nodes.

    Nodes with one neighbour leave before the rounds and take over what that neighbour has at the
    end, so the rounds run over what is left, which is little where most nodes hang on others.
    """
    links = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = written(both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")), "near")
    leaves, core = near.where("n = 1").select("u", "v"), near.where("n > 1").select(F.col("u").alias("node"))
    inner = links.join(leaves.select(F.col("u").alias("a")), "a", "left_anti").join(leaves.select(F.col("u").alias("b")), "b", "left_anti")
    found = _rounds(inner.select("a", "b"))
    drop_written(links)
    hanging = leaves.join(core, F.col("v") == F.col("node"), "left")
    # of a node that stays: itself or the smallest that hangs on it
    low = hanging.where("node IS NOT NULL").groupBy("node").agg(F.min("u").alias("low"))
    own = written(core.join(found, "node", "left").join(low, "node", "left").select("node", F.coalesce("component", "node").alias("root"), F.least("node", "low").alias("low")), "own")
    kept = own.join(own.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "component")
    hung = leaves.join(kept, F.col("v") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("component", F.least("u", "v")).alias("component"))
    return kept.unionAll(hung)


def _rounds(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a > b, distinct) that has a link to a smaller one.

    Alternating large-star and small-star rounds; their number grows with the logarithm
    of the longest chain. Each round is written to the shared folder, and the one before
    it is deleted. A hub's links are joined with its smallest neighbour, a table of one
    row a node, which adaptive execution splits or sends out where one node has most rows.
    """
    links, before = written(links, "links"), None
    while True:
        # large star: every larger neighbour goes to the smallest neighbour
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        old, links = links, written(large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        drop_written(old)
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = seen


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node, component (its smallest node) for every node of the edges; null nodes are left out."""
    nodes = edges.select(F.col(a).alias("node")).unionAll(edges.select(F.col(b).alias("node"))).where("node IS NOT NULL").distinct()
    return nodes.join(stars(edges, a, b), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_lengths(edges: DataFrame, length: str = "length") -> DataFrame:
    """component, n_edges, length per component."""
    return edges.join(components(edges), edges["u"] == F.col("node")).groupBy("component").agg(F.count("*").alias("n_edges"), F.sum(length).alias("length"))


def drop_short(edges: DataFrame, least: float, length: str = "length") -> DataFrame:
    """Edges of components that are at least ``least`` long in all."""
    roots = components(edges)
    marked = edges.join(roots, edges["u"] == roots["node"]).drop("node")
    long = marked.groupBy("component").agg(F.sum(length).alias("_l")).where(F.col("_l") >= least).select("component")
    return marked.join(long, "component", "left_semi").select(*edges.columns)
