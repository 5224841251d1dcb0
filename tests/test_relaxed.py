"""Searches by joins give what the searches in workers give, on random graphs with ties."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wheelwork.operators import lineage, relaxed, routing


@pytest.fixture(scope="module", params=[1, 2])
def edges(spark, request):
    rng = random.Random(request.param)
    rows = {(rng.randrange(14), rng.randrange(14)): (float(rng.choice([1, 1, 2, 3])), float(rng.randint(1, 5))) for _ in range(45)}
    return spark.createDataFrame([(u, v, w, x) for (u, v), (w, x) in rows.items() if u != v] + [(90, 91, 1.0, 1.0)], "u long, v long, weight double, length double").repartition(3).persist()


def test_routes(spark, edges):
    pairs = edges.select(F.col("u").alias("origin")).union(edges.select("v")).distinct().join(edges.select(F.col("v").alias("destination")).distinct()).unionAll(spark.createDataFrame([(5, 777), (777, 5)], "origin long, destination long"))
    key = lambda r: (r["origin"], r["destination"], r["route"], r["cost"])
    a, b = routing.shortest_paths(edges, pairs).collect(), relaxed.routes(edges, pairs).collect()
    assert sorted(map(key, a), key=repr) == sorted(map(key, b), key=repr) and any(r["route"] and len(r["route"]) > 3 for r in a) and any(r["route"] is None for r in a)
    guess = routing.shortest_paths(edges, pairs, guess=lambda x: 0.0).collect()
    assert sorted(map(key, guess), key=repr) == sorted(map(key, a), key=repr)


def brute_betweenness(edges, worth, lower, upper):
    """All cheapest paths one by one."""
    out, nodes = {}, sorted({x for e in edges for x in e[:2]})
    after = {}
    for u, v, w, x in edges:
        out[u, v] = 0.0
        after.setdefault(u, []).append((v, w, x))
    for s in nodes:
        cost, todo = {s: 0.0}, [s]
        while todo:
            x = todo.pop()
            for y, w, _ in after.get(x, []):
                if cost[x] + w < cost.get(y, 1e9):
                    cost[y] = cost[x] + w
                    todo.append(y)
        for t in cost:
            paths = []

            def grow(path, far, s=s, t=t, cost=cost, paths=paths):
                if path[-1] == t:
                    paths.append((path, far))
                    return
                for y, w, x in after.get(path[-1], []):
                    if y in cost and cost[path[-1]] + w == cost[y] and cost[y] <= cost[t]:
                        grow([*path, y], far + x)

            if t == s:
                continue
            grow([s], 0.0)
            span = min(f for _, f in paths)
            if lower <= span <= upper:
                for path, _ in paths:
                    for e in zip(path, path[1:], strict=False):
                        out[e] += worth(s, t, span) / len(paths)
    return out


@pytest.mark.parametrize(("way", "lower", "upper"), [("count", 0.0, float("inf")), ("gravity", 2.0, 9.0)])
def test_betweenness(spark, edges, way, lower, upper, monkeypatch):
    own = {3: 2.0, 5: 0.5}
    worth = (lambda s, t, d: 1.0) if way == "count" else (lambda s, t, d: own.get(s, 1.0) * own.get(t, 1.0) / d**2)
    want = brute_betweenness([tuple(r) for r in edges.collect()], worth, lower, upper)
    for most in (routing.MOST_EDGES, 1):
        monkeypatch.setattr(routing, "MOST_EDGES", most)
        got = {(r["u"], r["v"]): r["betweenness"] for r in routing.betweenness(edges, lower=lower, upper=upper, pair_weight=way, node_weights=own).collect()}
        assert got == pytest.approx(want)


def test_service_area_and_folders(spark, edges, monkeypatch, tmp_path):
    nodes = spark.createDataFrame([(0,), (3,), (90,), (1234,)], "node long")
    rows = lambda: sorted((r["node"], r["u"], r["v"], round(r["share"], 9)) for r in routing.service_area(edges, nodes, 3.5, "weight").where("share > 0").collect())
    near = rows()
    monkeypatch.setattr(routing, "MOST_EDGES", 1)
    assert rows() == near and near
    # a folder of its own, as other sessions may write to the shared one
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    relaxed.costs(edges, nodes, "weight").count()
    assert len(os.listdir(tmp_path)) == 1
