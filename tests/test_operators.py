"""Operators against brute force and small fixtures."""

import heapq
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from wheelwork.operators import components, gaps, kmodes, network, routing, versions
from wheelwork.operators.spatial import nearest, relation_areas, rings
from wheelwork.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(30), rng.randrange(30)): float(rng.randint(1, 9)) for _ in range(90)}
    edges = {k: w for k, w in edges.items() if k[0] != k[1]}
    df = spark.createDataFrame([(u, v, w, w) for (u, v), w in edges.items()], "u bigint, v bigint, weight double, length double")
    return edges, df


def dijkstra(edges, s):
    dist, heap = {}, [(0.0, s)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in dist:
            continue
        dist[x] = d
        for (u, v), w in edges.items():
            if u == x and v not in dist:
                heapq.heappush(heap, (d + w, v))
    return dist


def test_shortest_paths(spark, graph):
    edges, df = graph
    nodes = sorted({x for e in edges for x in e})
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "origin bigint, destination bigint")
    for r in routing.shortest_paths(df, pairs).collect():
        want = dijkstra(edges, r["origin"]).get(r["destination"])
        assert r["cost"] == want
        if want is not None:
            assert sum(edges[e] for e in zip(r["route"], r["route"][1:])) == want


def test_reach_is_the_limit_of_paths(spark, graph):
    edges, df = graph
    got = {(r["source"], r["node"]): r["cost"] for r in routing.reach(df, spark.createDataFrame([(3,)], "node bigint"), "weight", 12).collect()}
    assert got == {(3, n): d for n, d in dijkstra(edges, 3).items()}


def test_betweenness_of_a_line(spark):
    line = spark.createDataFrame([(i, i + 1, 1.0, 1.0) for i in range(4)], "u bigint, v bigint, weight double, length double")
    got = {(r["u"], r["v"]): r["betweenness"] for r in routing.betweenness(line).collect()}
    assert got == {(0, 1): 4.0, (1, 2): 6.0, (2, 3): 6.0, (3, 4): 4.0}
    near = {(r["u"], r["v"]): r["betweenness"] for r in routing.betweenness(line, upper=1.0).collect()}
    assert set(near.values()) == {1.0}


def test_service_area_shares(spark):
    line = spark.createDataFrame([(i, i + 1, 10.0) for i in range(4)], "u bigint, v bigint, length double")
    got = routing.service_area(line, spark.createDataFrame([(0,)], "node bigint"), 15.0).collect()
    assert sorted((r["u"], r["v"], r["share"]) for r in got) == [(0, 1, 1.0), (1, 2, 0.5)]


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_paths_and_merging(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (4, 5), (5, 2)], "u bigint, v bigint")
    assert sorted(r["path"] for r in gaps.simple_paths(edges).collect()) == [[1, 2, 3]]
    parts = spark.createDataFrame([(1, 1, 9.0), (1, 2, 9.0), (2, 1, 9.0), (2, 2, 9.0), (2, 3, 1.0), (3, 7, 5.0)], "gap_id bigint, edge bigint, length double")
    assert {r["gap_id"]: r["merged_id"] for r in gaps.merged(parts).collect()} == {1: 1, 2: 1, 3: 3}


def test_paths_of_any_length(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "u bigint, v bigint").coalesce(1)
    assert sorted(r["path"] for r in gaps.simple_paths(chain).collect()) == [list(range(71)), [100, 101]]


def test_greedy_rank(spark):
    cells = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 2, 5.0), (2, 3, 4.0), (3, 4, 6.0)], "gap_id bigint, cell bigint, population double")
    got = gaps.greedy_rank(cells, spark.createDataFrame([(9,)], "cell bigint"), 3)
    assert [(r["gap_id"], r["added"]) for r in got.orderBy("rank").collect()] == [(1, 10.0), (3, 6.0), (2, 4.0)]


def test_restrictions(spark):
    e = [(1, 2, 0, 10), (2, 3, 0, 11), (2, 4, 0, 12), (5, 2, 0, 13)]
    edges = spark.createDataFrame([(u, v, k, o, float(u), 0.0, float(v), float(v)) for u, v, k, o in e], "u bigint, v bigint, key int, osmid bigint, ux double, uy double, vx double, vy double")
    turns = network.turn_edges(edges)
    left = lambda rows: sorted((r["osmid_in"], r["osmid_out"]) for r in network.enforce_restrictions(turns, spark.createDataFrame(rows, "osmid_in bigint, osmid_out bigint, restriction string")).collect())
    assert left([(10, 11, "no_left_turn")]) == [(10, 12), (13, 11), (13, 12)]
    assert left([(10, 11, "only_straight_on")]) == [(10, 11), (13, 11), (13, 12)]
    assert left([(10, 99, "no_u_turn"), (10, 11, "weight")]) == [(10, 11), (10, 12), (13, 11), (13, 12)]


def test_segments_and_slopes(spark):
    ways = spark.createDataFrame([(7, {"oneway": "yes"}, [1, 2, 3]), (8, {}, [3, 1])], "osmid bigint, tags map<string,string>, nodes array<bigint>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "node bigint, x double, y double")
    assert sorted((r["u"], r["v"], r["osmid"]) for r in network.segments(ways, nodes).collect()) == [(1, 2, 7), (1, 3, 8), (2, 3, 7), (3, 1, 8)]
    s = network.robust_slope(F.array(*[F.lit(float(x)) for x in (9, 1, 4, 2)]), F.lit(1.0), F.lit(1.0))
    assert spark.range(1).select(s.alias("s")).first()["s"] == 3.0


def test_merge_chains(spark):
    edges = spark.createDataFrame([(1, 1, 2, 7, 5.0), (2, 2, 3, 7, 6.0), (3, 3, 4, 8, 1.0)], "id bigint, u bigint, v bigint, osmid bigint, length double")
    assert sorted((r["osmid"], r["u"], r["v"], r["length"]) for r in network.merge_chains(edges).collect()) == [(7, 1, 3, 11.0), (8, 3, 4, 1.0)]


def test_as_of_misses_are_null(spark):
    v = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k int, first_seen int, name string")
    e = spark.createDataFrame([(1, 5), (1, 10), (1, 25), (2, 9)], "k int, t int")
    got = versions.as_of(e, v, "k", "t", take=["name"])
    assert sorted((r["k"], r["t"], r["name"]) for r in got.collect()) == [(1, 5, None), (1, 10, "a"), (1, 25, "b"), (2, 9, None)]


def test_nearest_far_away(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0)], "id bigint, x double, y double")
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (8, 3.0, 0.0)], "node bigint, x double, y double")
    assert sorted((r["id"], r["node"], r["distance"]) for r in nearest(pts, nodes, "id", "node", 0.5).collect()) == [(1, 7, 1.0), (2, 8, 37.0)]


def test_nearest_at_any_distance(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, None, 0.0)], "id bigint, x double, y double")
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (8, 3.0, 0.0)], "node bigint, x double, y double")
    result = lambda n: sorted((r["id"], r["node"], r["distance"]) for r in nearest(pts, n, "id", "node", 0.5).collect())
    assert result(nodes) == [(1, 7, 1.0), (2, 8, 4997.0), (3, None, None)]
    assert result(nodes.limit(0)) == [(1, None, None), (2, None, None), (3, None, None)]


def test_kmodes(spark):
    rows = spark.createDataFrame([("a", "x")] * 5 + [("a", "y")] * 2 + [("b", "z")] * 4, "p string, q string")
    centres, cost = kmodes.fit(rows, ["p", "q"], 2)
    assert cost == 2 and ("b", "z") in centres


def test_first_centres(spark):
    rows = [("a", "x")] * 5 + [("a", "y")] * 2 + [("b", "z")] * 4 + [("c", None)]
    counted = spark.createDataFrame(rows, "p string, q string").groupBy("p", "q").agg(F.count("*").alias("_n"))
    # densities by hand: (a,x) (7+5)/24, (a,y) (7+2)/24, (b,z) (4+4)/24, (c,-) (1+1)/24
    assert kmodes.first_centres(counted, ["p", "q"], 3, 1, "cao") == [("a", "x"), ("b", "z"), ("a", "y")]
    # values by frequency: a b c and x z y
    assert kmodes.first_centres(counted, ["p", "q"], 2, 1, "huang") == [("a", "x"), ("b", "z")]
    assert len(kmodes.first_centres(counted, ["p", "q"], 9, 1, "cao")) == 4 == len(kmodes.first_centres(counted, ["p", "q"], 9, 1, "huang"))


def test_sources(spark, tmp_path):
    place = {"uid": 5, "lat": 49.0, "lng": 11.0, "bike": False, "spot": True, "name": "S", "number": 12, "bike_racks": 3, "special_racks": 0, "bike_list": [{"number": "b1", "bike_type": 4}]}
    free = place | {"uid": 6, "bike": True, "spot": False, "bike_list": [{"number": "b2", "bike_type": 4}, {"number": "b3", "bike_type": None}]}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/2024-01-02T03-04-05.json").write_text(json.dumps({"countries": [{"cities": [{"uid": 1, "name": "N", "places": [place, free]}]}]}))
    (tmp_path / "s/2024-01-03T03-04-05.json").write_text("{broken")
    places = readers.snapshots(spark, str(tmp_path / "s"))
    assert sorted((r["id"], r["station_id"]) for r in readers.bikes(places).collect()) == [("b1", 5), ("b2", None), ("b3", None)]
    row = readers.stations(places).first()
    assert (row["station_id"], str(row["created_at"])) == (5, "2024-01-02 03:04:05")
    (tmp_path / "f.csv").write_text("date;bikes\n2024-01-01;a,b\n2024-01-02;\n")
    assert [r["bikes"] for r in readers.fleet_days(spark, str(tmp_path / "f.csv")).collect()] == [["a", "b"]]
    (tmp_path / "r.csv").write_text("start_time;end_time;duration;a;b;c;d;e;f\n01.02.2024 10:00;01.02.2024 10:10;600;1;2;49,5;11,5;49,6;11,6\n")
    r = readers.rentals_2024(spark, str(tmp_path / "r.csv")).first()
    assert (r["start"]["lon"], r["finish"]["lat"], str(r["start_time"])) == (11.5, 49.6, "2024-02-01 10:00:00")
    for day in ("2024-01-01", "2024-01-05"):
        with tarfile.open(tmp_path / f"{day}.tar.gz", "w:gz") as tar:
            info = tarfile.TarInfo("x.json")
            info.size = 2
            tar.addfile(info, io.BytesIO(b"{}"))
    assert [r["content"] for r in readers.archives(spark, str(tmp_path), "2024-01-01", "2024-01-03").collect()] == [b"{}"]


def test_sinks(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame(list(xs), "k int, v int")
    path = "file://" + str(tmp_path / "t")
    sinks.insert_skip(rows((1, 1), (1, 2)), path, ["k"], ["v"])
    sinks.insert_skip(rows((1, 3), (2, 4)), path, ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1), (2, 4)]
    assert not sinks.insert_batch(rows((3, 1), (2, 9)), path, ["k"])
    assert sinks.insert_batch(rows((3, 1)), path, ["k"])
    sinks.replace_partitions(rows((1, 1), (1, 2), (2, 3)), path + "-by", ["k"])
    sinks.replace_partitions(rows((1, 7)), path + "-by", ["k"])
    assert sorted(map(tuple, spark.read.parquet(path + "-by").select("k", "v").collect())) == [(1, 7), (2, 3)]
    sinks.write_csv(rows((1, 2)), path + "-csv", ";")
    assert [tuple(r) for r in spark.read.csv(path + "-csv", sep=";", header=True).collect()] == [("1", "2")]
    day = spark.sql("SELECT timestamp'2024-01-02 03:00:00' AS time, 1 AS k")
    sinks.compact_day(day, path + "-day")
    with pytest.raises(Exception, match="already exists"):
        sinks.compact_day(day, path + "-day")


def test_costs_without_a_bound(spark, graph):
    edges, df = graph
    got = {(r["source"], r["node"]): r["cost"] for r in routing.costs(df, spark.createDataFrame([(0,), (5,), (99,)], "node bigint"), "weight").collect()}
    want = {(s, n): d for s in (0, 5, 99) for n, d in dijkstra(edges, s).items()}
    assert got == want


def test_rings_of_relations(spark):
    square = [(1, "outer", 10, [1, 2, 3]), (1, "outer", 11, [1, 4, 3]), (1, "inner", 12, [5, 6, 7, 8, 5]), (2, "outer", 13, [1, 2, 3]), (2, "outer", 14, None)]
    members = spark.createDataFrame(square, "relation bigint, role string, way bigint, nodes array<bigint>")
    assert sorted((r["relation"], r["role"], r["nodes"]) for r in rings(members).collect()) == [(1, "inner", [5, 6, 7, 8, 5]), (1, "outer", [1, 2, 3, 4, 1])]
    corners = [(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 4.0, 4.0), (4, 0.0, 4.0), (5, 1.0, 1.0), (6, 2.0, 1.0), (7, 2.0, 2.0), (8, 1.0, 2.0)]
    areas = relation_areas(members, spark.createDataFrame(corners, "node bigint, x double, y double"))
    assert [tuple(r) for r in areas.collect()] == [(1, 15.0)]


def test_stream_of_fleet(spark, tmp_path):
    from wheelwork.streaming.rides import stream_fleet

    seen = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 10:00:00'), (1L, timestamp'2024-01-01 10:05:00'), (1L, timestamp'2024-01-02 10:00:00'), (2L, timestamp'2024-01-01 10:00:00') AS t(key, time)")
    seen.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in"))
    stream_fleet(source).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted((r["key"], str(r["date"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-01")]
