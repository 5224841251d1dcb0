"""List ranking, stitching and simplification against plain walks, on chains, rings and odd joints."""

import random

import pytest
from pyspark.sql import functions as F

from wheelwork.operators import chains


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_chains(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), 300)
    links, want = [], {}
    while ids:
        n = min(len(ids), rng.choice([1, 1, 2, 3, 5, 17, 64, 90]))
        run, ids = ids[:n], ids[n:]
        ring = rng.random() < 0.4
        if ring:
            k = run.index(min(run))
            run = run[k:] + run[:k]
        links += [(x, run[i - 1] if i or ring else None) for i, x in enumerate(run)]
        want |= {x: (run[0], i, ring) for i, x in enumerate(run)}
    links.append((20_001, 99_999))
    want[20_001] = (20_001, 0, False)
    rng.shuffle(links)
    got = chains.ranked_chains(spark.createDataFrame(links, "id long, before long")).collect()
    assert {r["id"]: (r["head"], r["place"], r["cyclic"]) for r in got} == want


def canonical(nodes, closed):
    if not closed or nodes[0] != nodes[-1]:
        return min(tuple(nodes), tuple(nodes[::-1]))
    body = nodes[:-1]
    return min(tuple(r[k:] + r[:k]) for r in (body, body[::-1]) for k in range(len(body)))


def test_stitched_rings_and_lines(spark):
    rng = random.Random(3)
    pieces, want = [], []
    for g in range(6):
        at, way = g * 1000, 0
        for _ in range(rng.randint(1, 4)):
            n, closed = rng.choice([2, 5, 30, 60]), rng.random() < 0.6
            nodes = list(range(at, at + n + 2))
            at += n + 10
            if closed:
                nodes.append(nodes[0])
            cuts = sorted({0, len(nodes) - 1, *(rng.randrange(len(nodes)) for _ in range(rng.choice([0, 1, 6, 25])))})
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = nodes[a : b + 1]
                pieces.append((g, rng.random(), part if rng.random() < 0.5 else part[::-1]))
                way += 1
            want.append((g, closed, canonical(nodes, closed)))
    rng.shuffle(pieces)
    rows = [(g, "outer", i, p) for i, (g, _, p) in enumerate(pieces)] + [(0, "outer", 900, [5]), (0, "outer", 901, None), (0, "outer", 902, [])]
    got = chains.stitched(spark.createDataFrame(rows, "relation long, role string, way long, nodes array<long>"), ["relation", "role"]).collect()
    assert sorted((r["relation"], r["closed"], canonical(r["nodes"], r["closed"])) for r in got) == sorted(want)
    assert len({(r["relation"], r["role"], r["line"]) for r in got}) == len(got)


def test_stitched_at_crossings(spark):
    # two rings that share a node, and three ends at one node
    rows = [(1, 1, [1, 2, 3]), (1, 2, [3, 1]), (1, 3, [1, 8, 9, 1]), (2, 4, [1, 2]), (2, 5, [2, 3]), (2, 6, [2, 4])]
    got = chains.stitched(spark.createDataFrame(rows, "g long, way long, nodes array<long>"), ["g"]).collect()
    one = [r for r in got if r["g"] == 1]
    steps = sorted(tuple(sorted(p)) for r in one for p in zip(r["nodes"], r["nodes"][1:], strict=False))
    assert all(r["closed"] for r in one) and steps == sorted([(1, 2), (2, 3), (1, 3), (1, 8), (8, 9), (1, 9)])
    assert sorted(map(lambda r: (r["closed"], len(r["nodes"])), (r for r in got if r["g"] == 2))) == [(False, 2), (False, 3)]


def brute_simplified(edges):
    """Paths between nodes that are not inner, walked edge by edge."""
    out, into, ways = {}, {}, {}
    for u, v, k, w, _ in edges:
        out.setdefault(u, []).append((v, k))
        into.setdefault(v, []).append((u, k))
        for n in (u, v):
            ways.setdefault(n, set()).add(w)
    nodes = set(out) | set(into)

    def inner(n):
        near = {v for v, _ in out.get(n, [])} | {u for u, _ in into.get(n, [])}
        d = len(out.get(n, [])) + len(into.get(n, []))
        return n not in near and len(near) == 2 and out.get(n) and into.get(n) and d in (2, 4) and len(ways[n]) == 1

    facts = {(u, v, k): (w, x) for u, v, k, w, x in edges}
    paths = []
    for n in nodes:
        if inner(n):
            continue
        for v, k in out.get(n, []):
            path, keys = [n, v], [(n, v, k)]
            while inner(path[-1]):
                on = [(w, j) for w, j in out[path[-1]] if w != path[-2]]
                if len(on) != 1:
                    break
                keys.append((path[-1], *on[0]))
                path.append(on[0][0])
            paths.append((tuple(path), round(sum(facts[x][1] for x in keys), 6), tuple(dict.fromkeys(facts[x][0] for x in keys))))
    return sorted(paths)


def test_simplified(spark):
    rng = random.Random(11)
    edges, at = [], 100
    for _ in range(25):
        a, b, n, way = rng.randrange(12), rng.randrange(12), rng.choice([0, 1, 2, 9, 20]), rng.randrange(5)
        run = [a, *range(at, at + n), b]
        at += n
        turn = rng.randrange(n + 1) if rng.random() < 0.3 else None
        for i, (u, v) in enumerate(zip(run, run[1:], strict=False)):
            w = way + 10 if turn is not None and i >= turn else way
            edges.append((u, v, len([e for e in edges if e[:2] == (u, v)]), w, float(rng.randint(1, 9))))
        if rng.random() < 0.6:
            for i, (u, v) in enumerate(zip(run, run[1:], strict=False)):
                w = way + 10 if turn is not None and i >= turn else way
                edges.append((v, u, len([e for e in edges if e[:2] == (v, u)]), w, float(rng.randint(1, 9))))
    edges += [(900, 901, 0, 1, 1.0), (901, 902, 0, 1, 1.0), (902, 900, 0, 1, 1.0)]
    df = spark.createDataFrame(edges, "u long, v long, key long, osmid long, length double")
    shape = df.withColumn("geometry", F.array(F.struct(F.col("u").cast("double").alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("v").cast("double").alias("x"), F.lit(0.0).alias("y"))))
    got = chains.simplified(shape).collect()
    assert sorted((tuple(r["nodes"]), round(r["length"], 6), tuple(r["osmids"])) for r in got) == brute_simplified(edges)
    for r in got:
        assert [p["x"] for p in r["geometry"]] == [x for i, x in enumerate(r["nodes"]) if i == 0 or x != r["nodes"][i - 1]] and r["n_edges"] == len(r["nodes"]) - 1
        assert (r["u"], r["v"]) == (r["nodes"][0], r["nodes"][-1])
    assert len({(r["u"], r["v"], r["key"]) for r in got}) == len(got)


def test_areas_with_holes(spark):
    from wheelwork.functions import shapes as H
    from wheelwork.operators import spatial

    spots = {1: (0, 0), 2: (9, 0), 3: (9, 9), 4: (0, 9), 5: (1, 1), 6: (3, 1), 7: (2, 3), 8: (20, 0), 9: (22, 0), 10: (20, 2), 11: (5, 5), 12: (6, 5), 13: (5, 6)}
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in spots.items()], "id long, lon double, lat double")
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 4, 3]), (3, [5, 6, 7, 5]), (4, [8, 9, 10, 8]), (5, [11, 12]), (6, [13, 12]), (7, [11, 13]), (8, [1, 99, 2, 1])], "id long, nodes array<long>")
    member = lambda *of: [("way", ref, role) for ref, role in of]
    rows = [(70, member((1, "outer"), (2, ""), (3, "inner"), (4, "outer"), (5, "inner"), (6, "inner"), (7, "inner"))), (71, member((1, "outer"))), (72, member((8, "outer"))), (73, None)]
    got = spatial.areas(spark.createDataFrame(rows, "id long, members array<struct<kind:string,ref:long,role:string>>"), ways, nodes)
    assert sorted((r["relation"], r["n"], r["a"]) for r in got.select("relation", F.size("rings").alias("n"), H.polygon_area(F.col("rings")).alias("a")).collect()) == [(70, 1, 2.0), (70, 3, 81 - 2 - 0.5)]
    found = spatial.way_areas(ways, nodes).select("relation", H.polygon_area(F.col("rings")).alias("a")).collect()
    assert sorted(map(tuple, found)) == [(3, 2.0), (4, 2.0)]
