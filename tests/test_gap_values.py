"""Gap measures and network repairs against union-find and plain Python, on odd gaps and edges."""

import random

import numpy as np
import pytest

from wheelwork.operators import evaluation, gaps, network, statistics


def components_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return len({find(x) for x in list(parent)})


def test_components_after_unconnected_gaps(spark):
    rng = random.Random(3)
    base = [(rng.randint(0, 60), rng.randint(0, 60), k, float(rng.randint(1, 9))) for k in range(35)]
    gap = [(g, rng.randint(0, 70), rng.randint(0, 70), 100 + k, float(rng.randint(1, 9))) for g in range(20) for k in range(rng.randint(1, 5))]
    gap += [(50, *base[0]), (50, *base[1]), (51, 900, 901, 1, 2.0), (51, 900, 901, 1, 2.0), (52, 7, 7, 1, 1.0)]
    out = evaluation.components_after(spark.createDataFrame(gap, "gap_id long, u long, v long, key long, length double"), spark.createDataFrame(base, "u long, v long, key long, length double"))
    before = components_of([e[:2] for e in base])
    want = {}
    for g in {x[0] for x in gap}:
        both = {e[:3]: e[3] for e in base} | {e[1:4]: e[4] for e in gap if e[0] == g}
        after = components_of([e[:2] for e in both])
        want[g] = (after < before, pytest.approx(sum(both.values()) / after))
    assert {r["gap_id"]: (r["connects"], r["mean_length"]) for r in out.collect()} == want


def test_overlap_summary_counts_pairs_without_a_shared_edge(spark):
    rng = random.Random(5)
    rows = {(g, e, float(e % 5 + 1)) for g in range(9) for e in rng.sample(range(12), rng.randint(1, 6))}
    edges = spark.createDataFrame(sorted(rows), "gap_id long, edge long, length double")
    own = {g: {e: x for h, e, x in rows if h == g} for g in range(9)}
    values = [sum(x for e, x in own[a].items() if e in own[b]) / min(sum(own[a].values()), sum(own[b].values())) for a in own for b in own if a != b]
    got = gaps.overlap_summary(edges, 0.6).first()
    assert got["above"] == pytest.approx(np.mean([v > 0.6 for v in values]))
    assert [got[f"p{p}"] for p in (25, 50, 75)] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    assert gaps.overlap_summary(edges.where("gap_id = 1")).first()["above"] is None


def test_counted_percentiles(spark):
    counts = [(0.5, 3), (2.0, 1), (-1.0, 4), (7.0, 2)]
    flat = [x for x, n in counts for _ in range(n)]
    got = statistics.counted_percentiles(spark.createDataFrame(counts, "x double, n long"), "x", "n", (0, 10, 33, 50, 99, 100)).first()
    assert list(got) == pytest.approx(list(np.percentile(flat, [0, 10, 33, 50, 99, 100])))


def test_path_counts_are_those_of_the_listed_paths(spark):
    rng = random.Random(9)
    edges = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(40)) if a < b}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    paths = [r["path"] for r in gaps.simple_paths(df).collect()]
    got = {r["node"]: int(r["n_paths"]) for r in gaps.path_counts(df.unionAll(df)).collect()}
    assert got == {n: sum(n in p for p in paths) for n in {x for e in edges for x in e}}
    assert gaps.path_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="ring"):
        gaps.path_counts(spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3)], "u long, v long"))


def test_way_back_is_turned_round(spark):
    e = spark.createDataFrame([(1, 2, 0, True, False, {"oneway:bicycle": "no"}, 0.0, 0.0, 1.0, 1.0, [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)])],
                              "u long, v long, key long, oneway boolean, reversed boolean, tags map<string,string>, ux double, uy double, vx double, vy double, geometry array<struct<x:double,y:double>>")
    back = network.open_oneways(e).where("u = 2").first()
    assert (back["v"], back["ux"], back["vx"], back["uy"], back["vy"]) == (1, 1.0, 0.0, 1.0, 0.0)
    assert [tuple(p) for p in back["geometry"]] == [(1.0, 1.0), (0.5, 1.0), (0.0, 0.0)]


@pytest.mark.parametrize("several", [False, True])
def test_relevant(spark, several):
    ways = [None, 1, 2, 3] if not several else [None, [1], [1, 2], [2], [3, 4], []]
    e = spark.createDataFrame([(i, i + 1, 0, w, 0.5) for i, w in enumerate(ways)] + [(99, 98, 0, ways[-1], 0.1)], f"u long, v long, key long, osmid {'array<long>' if several else 'long'}, count double")
    infra = spark.createDataFrame([(1,), (2,), (None,)], "osmid long")
    assert [r["u"] for r in gaps.relevant(e, infra).orderBy("u").collect()] == ([3] if not several else [4])


def test_slopes_with_the_length_in_degrees(spark):
    row = spark.createDataFrame([([1.0, 2.0, 4.0, 3.0], 15.0, 0.0002)], "e array<double>, length double, degrees double")
    got = row.select(network.slopes_along(row["e"], row["length"], row["degrees"]).alias("s")).first()["s"]
    # three stretches of 5 m: each is a third of the line, in degrees
    assert got == pytest.approx([rise / (15.0 / (0.0002 / 3)) * 100 for rise in (1.0, 2.0, -1.0)])
