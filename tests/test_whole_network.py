"""Queries over all streets and all moves against brute force."""

import statistics
from collections import Counter, defaultdict

import pytest

from wheelwork.plans import network
from wheelwork.plans.inputs import streets

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    return [tuple(r) for r in streets(spark, DATA).select("u", "v", "length").collect()]


@pytest.fixture(scope="module")
def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v, _ in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.fixture(scope="module")
def lengths(edges, roots):
    out = defaultdict(float)
    for u, _, length in edges:
        out[roots[u]] += length
    return out


def test_components(spark, roots):
    assert Counter(tuple(r) for r in network.components(spark, DATA).select("node", "component").collect()) == Counter(roots.items())


def test_component_stats(spark, lengths):
    r, want = network.component_stats(spark, DATA).first(), list(lengths.values())
    assert r["n"] == len(want)
    assert (r["mean"], r["median"], r["least"], r["most"]) == pytest.approx((statistics.fmean(want), statistics.median(want), min(want), max(want)))


def test_drop_short_components(spark, edges, roots, lengths):
    got = network.drop_short_components(spark, DATA).select("u", "v", "length").collect()
    assert Counter(map(tuple, got)) == Counter(e for e in edges if lengths[roots[e[0]]] >= 80000)


def test_turn_edges(spark):
    moves = {(r["u"], r["v"]): r["trips"] for r in network._moves(spark, DATA).collect()}
    want = Counter((u, m, v, min(a, b)) for (u, m), a in moves.items() for (n, v), b in moves.items() if m == n and u != v)
    assert len(moves) == 926 and want
    assert Counter(map(tuple, network.turn_edges(spark, DATA).select("u", "mid", "v", "trips").collect())) == want


def test_reach_in_steps(spark):
    edges = [(r["u"], r["v"], r["weight"]) for r in network._network(spark, DATA).collect()]
    nodes = {x for u, v, _ in edges for x in (u, v)}
    cost = {(s, s): 0.0 for s in nodes}
    for _ in range(4):
        further = dict(cost)
        for s in nodes:
            for u, v, w in edges:
                if (s, u) in cost:
                    further[s, v] = min(further.get((s, v), float("inf")), cost[s, u] + w)
        cost = further
    got = {(r["source"], r["node"]): r["cost"] for r in network.reach_in_steps(spark, DATA).collect()}
    assert len(nodes) == 100 and got.keys() == cost.keys()
    assert all(abs(got[k] - c) < 2e-6 for k, c in cost.items())
