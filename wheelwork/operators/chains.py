"""Order along chains and rings by list ranking: pointer doubling over a link table.

Every element knows the one before it. In each round it takes over what its pointer's
target knows, so the stretch it has walked doubles; a chain of n elements takes log2 n rounds of
one join, and one chain or ring of any length is spread over all tasks. Rounds are written
to the shared folder and the one before is deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.operators.lineage import drop_written, written


def _walked(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, head, place of those whose chain has a head, and id, least of those in rings.

    ``links`` has id and up (the element before it); what is up but no id is a head. Only elements on the way are
    joined and written anew. An element d steps from the smallest of its ring learns of it in the
    round that first spans d, and each round reaches a head as long as a chain is not spanned, so a round without change
    means that all rings are.
    """
    head = F.lit(None).cast(links.schema["id"].dataType).alias("head")
    state = written(links.select("id", "up", head, F.lit(1).cast("bigint").alias("place"), F.least("id", "up").alias("least")), "walk")
    frames, seen, before = [], state.agg(F.count("*"), F.sum(F.xxhash64("id", "least").cast("decimal(38,0)"))).first(), None
    while seen[0] and seen != before:
        frames.append(state)
        arrived = [f.where("head IS NOT NULL") for f in frames[:-1]]
        known = reduce(DataFrame.unionByName, arrived, state).select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.col("least").alias("_least"))
        # those still on the way point at different elements, so no task gets many for one
        moving = state.where("head IS NULL").join(known, F.col("up") == F.col("_id"), "left")
        state = written(moving.select(
            "id", F.when(F.col("_id").isNotNull() & F.col("_head").isNull(), F.col("_up")).alias("up"), F.when(F.col("_id").isNull(), F.col("up")).otherwise(F.col("_head")).alias("head"),
            (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"), F.least("least", "_least").alias("least"),
        ), "walk")
        before, seen = seen, state.where("head IS NULL").agg(F.count("*"), F.sum(F.xxhash64("id", "least").cast("decimal(38,0)"))).first()
    there = reduce(DataFrame.unionByName, [f.where("head IS NOT NULL") for f in [*frames, state]])
    return there.select("id", "head", "place"), state.where("head IS NULL").select("id", "least")


def ranked_chains(links: DataFrame) -> DataFrame:
    """id, head, place (from 0), cyclic of each element. ``links`` has id (unique) and before (the id before it, or null).

    At most one element may follow another. A ring's head is its smallest element. A ``before`` that is no element is taken as none.
    """
    links = written(links.select("id", "before"), "links")
    there = links.select(F.col("id").alias("before")).withColumn("_there", F.lit(True))
    known = written(links.join(there, "before", "left").select("id", F.when(F.col("_there"), F.col("before")).alias("up")), "known")
    drop_written(links)
    first = lambda heads, cyclic: heads.select("id", F.col("id").alias("head"), F.lit(0).cast("bigint").alias("place"), F.lit(cyclic).alias("cyclic"))
    placed, rings = _walked(known.where("up IS NOT NULL"))
    chains = first(known.where("up IS NULL"), False).unionByName(placed.withColumn("cyclic", F.lit(False)))
    if rings.isEmpty():
        return chains
    # a ring is opened before its smallest element and walked again
    again, _ = _walked(rings.where("id <> least").join(known, "id").select("id", "up"))
    return chains.unionByName(first(rings.where("id = least"), True)).unionByName(again.withColumn("cyclic", F.lit(True)))


def stitched(pieces: DataFrame, group: list[str], piece: str = "way", nodes: str = "nodes") -> DataFrame:
    """group, line (number in the group), closed, nodes: pieces put end to end, those of a ring and those of open lines.

    Within a group two piece ends at one node are joined, in the order of the pieces where there are
    more; what is left over stays an end. Every piece is taken both ways, as it may have to be turned
    round, so each line comes out twice; the one that begins with the smaller piece, unturned
    for one piece alone, stays. Pieces of fewer than two nodes and nulls are left out. Joint nodes stand once, a ring's
    first node again at its end. The nodes of one line are one row.
    """
    known = written(pieces.where(F.size(nodes) > 1).select(F.struct(*group, piece).alias("_p"), *group, F.col(nodes).alias("_n")), "pieces")
    at = lambda i: F.get("_n", i)
    both = known.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("_t"))
    ends = both.select("_p", *group, "_t", F.when(F.col("_t"), at(F.lit(0))).otherwise(at(F.size("_n") - 1)).alias("_node"))
    # the end of (p, not turned) is where (p, turned) begins, so one pairing of ends serves all
    w = Window.partitionBy(*group, "_node").orderBy("_p", "_t")
    paired = ends.withColumn("_k", F.row_number().over(w) - 1).withColumn("_pair", F.floor(F.col("_k") / 2))
    a = paired.where("_k % 2 = 0").select(*group, "_node", "_pair", F.struct("_p", "_t").alias("_a"))
    b = paired.where("_k % 2 = 1").select(*group, "_node", "_pair", F.struct("_p", "_t").alias("_b"))
    joints = a.join(b, [*group, "_node", "_pair"]).select("_a", "_b")
    turned = lambda d: F.struct(d["_p"].alias("_p"), (~d["_t"]).alias("_t"))
    # after going through a one arrives at b's end from outside, so goes on through b the other way
    follow = joints.select(F.col("_a").alias("before"), turned(F.col("_b")).alias("id")).unionAll(joints.select(F.col("_b").alias("before"), turned(F.col("_a")).alias("id")))
    darts = both.select(F.struct("_p", "_t").alias("id"))
    ranks = written(ranked_chains(darts.join(follow, "id", "left")), "ranks")
    # of both ways along a line one stays; a ring that turns into itself the other way round does not exist, a chain may
    lines = ranks.groupBy("head", "cyclic").agg(F.min("id").alias("_least"), F.max_by("id", "place").alias("_last"))
    mirror = turned(F.col("_last"))
    keep = F.when(F.col("cyclic"), ~F.col("_least._t")).otherwise(F.col("head") <= mirror)
    kept = lines.where(keep).select("head")
    placed = ranks.join(kept, "head").select("head", "place", "cyclic", F.col("id._p").alias("_p"), F.col("id._t").alias("_t")).join(known, "_p")
    way = F.when(F.col("_t"), F.reverse("_n")).otherwise(F.col("_n"))
    # all but the first piece begin with the joint
    part = F.when(F.col("place") == 0, way).otherwise(F.slice(way, F.lit(2), F.size(way) - 1))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("n")))), lambda s: s["n"]))
    joined = placed.groupBy(*group, "head", "cyclic").agg(whole.alias("nodes"))
    number = F.row_number().over(Window.partitionBy(*group).orderBy("head")) - 1
    return joined.select(*group, number.alias("line"), (F.col("cyclic") | (F.get("nodes", F.lit(0)) == F.get("nodes", F.size("nodes") - 1))).alias("closed"), "nodes")


def simplified(edges: DataFrame, differ: str = "osmid") -> DataFrame:
    """u, v, key, osmids, length, n_edges, nodes: directed chains through inner nodes as single edges, in order.

    ``edges`` has u, v, key, length, the column ``differ`` and, if given, geometry (array of
    points). A node is inner if no edge joins it to itself, it has two neighbours, one or two edges
    either in and out, and all its edges agree in ``differ``. Rings without any other node are
    left out. ``osmids`` are the different values of ``differ`` in order, ``nodes`` all nodes; with ``geometry``
    the lines of the edges one after the other. Keys count parallel results from 0.
    """
    shaped = "geometry" in edges.columns
    rest = ["geometry"] if shaped else []
    # numbers are shorter to send and sort than (u, v, key); written, they stay as they are
    e = written(edges.select(F.monotonically_increasing_id().alias("id"), "u", "v", "key", F.col(differ).alias("_way"), "length", *rest), "edges")
    none = [F.lit(None).cast(e.schema[c].dataType).alias(c) for c in ("length", *rest)]
    sides = e.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(True).alias("out"), "id", "key", "_way", "length", *rest).unionAll(
        e.select(F.col("v").alias("node"), F.col("u").alias("other"), F.lit(False).alias("out"), "id", "key", "_way", *none)
    )
    # all windows run over one shuffle by node, in one order
    at, lane = Window.partitionBy("node"), Window.partitionBy("node", "other", "out").orderBy("key")
    about = sides.withColumn("_lane", F.row_number().over(lane)).withColumns({
        "_n": F.count("*").over(at), "_outs": F.count_if("out").over(at), "_lo": F.min("other").over(at), "_hi": F.max("other").over(at), "_looped": F.bool_or(F.col("other") == F.col("node")).over(at),
        "_w0": F.min("_way").over(at), "_w1": F.max("_way").over(at), "_bare": F.count_if(F.col("_way").isNull()).over(at),
    })
    # an inner node has two edges in from a neighbour at most, those beyond have none to go on to
    into = {(end, i): f"_{end}{i}" for end in ("lo", "hi") for i in (1, 2)}
    from_ = lambda end, i: F.max(F.when(~F.col("out") & (F.col("other") == F.col(f"_{end}")) & (F.col("_lane") == i), F.col("id")))
    about = about.withColumns({"_strays": F.count_if((F.col("other") != F.col("_lo")) & (F.col("other") != F.col("_hi"))).over(at)} | {c: from_(*k).over(at) for k, c in into.items()})
    same = F.when(F.col("_bare") == 0, F.col("_w0") == F.col("_w1")).otherwise(F.col("_bare") == F.col("_n"))
    two = F.col("node").isNotNull() & (F.col("_lo") != F.col("_hi")) & (F.col("_strays") == 0)
    inner = two & ~F.col("_looped") & (F.col("_outs") >= 1) & (F.col("_outs") < F.col("_n")) & F.col("_n").isin(2, 4) & same
    # at an inner node the one edge in from a neighbour goes on to the other neighbour; parallel ones are matched in order
    beyond = lambda end: F.when(F.col("_lane") == 1, F.col(into[end, 1])).when(F.col("_lane") == 2, F.col(into[end, 2]))
    before = F.when(inner & (F.col("other") == F.col("_hi")), beyond("lo")).when(inner & (F.col("other") == F.col("_lo")), beyond("hi"))
    linked = written(about.where("out").select("id", F.col("node").alias("u"), F.col("other").alias("v"), "key", "_way", "length", *rest, before.alias("before")), "linked")
    drop_written(e)
    ranks, _ = _walked(linked.where("before IS NOT NULL").select("id", F.col("before").alias("up")))
    # edges behind a chain's first one are gathered; a chain of one edge goes through as it is
    behind = ranks.join(linked.where("before IS NOT NULL"), "id").groupBy(F.col("head").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "v", "_way", *rest))).alias("_more"), F.sum("length").alias("_length")
    )
    placed = linked.where("before IS NULL").join(behind, "id", "left")
    line = lambda c: F.when(F.col("_more").isNull(), F.array(c)).otherwise(F.concat(F.array(c), F.col("_more")[c]))
    out = placed.select(
        "u", F.when(F.col("_more").isNull(), F.col("v")).otherwise(F.get(F.col("_more")["v"], F.size("_more") - 1)).alias("v"), F.struct("v", "key").alias("_first"), F.array_distinct(line("_way")).alias("osmids"),
        F.coalesce(F.col("length") + F.col("_length"), "length", "_length").alias("length"), (F.coalesce(F.size("_more"), F.lit(0)) + 1).cast("bigint").alias("n_edges"), F.concat(F.array("u"), line("v")).alias("nodes"),
        *([F.flatten(line("geometry")).alias("_g")] if shaped else []),
    )
    if shaped:
        out = out.withColumn("geometry", F.filter("_g", lambda p, i: (i == 0) | (p != F.get("_g", i - 1)))).drop("_g")
    key = F.row_number().over(Window.partitionBy("u", "v").orderBy("_first")) - 1
    return out.select("u", "v", key.alias("key"), "osmids", "length", "n_edges", "nodes", *rest)
