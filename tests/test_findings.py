"""Cases that reviews have found."""

import datetime
import gzip
import math
import random
import re
from xml.etree import ElementTree

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.functions import geo, tags
from wheelwork.llm import toxicity
from wheelwork.operators import chains, components, evaluation, gaps, providers, routing
from wheelwork.plans import accidents, files, ways
from wheelwork.sources import graphml, mapfiles
from wheelwork.streaming import incremental


def test_betweenness_where_no_pair_counts(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "u long, v long, weight double").withColumn("length", F.col("weight"))
    rows = routing.betweenness(edges, lower=1.0, upper=200.0, pair_weight="gravity", normalized=True).collect()
    assert sorted((r["u"], r["v"]) for r in rows) == [(1, 2), (2, 3)]
    assert all(math.isnan(r["betweenness"]) for r in rows)


def test_places_on_the_sides_of_the_city(spark):
    """Keys whose places lie on a side, where the last digit of a difference of corners decides."""
    ids = [928545, 847298, 596261, 515014, 426471, 500500, 0]
    orders = spark.createDataFrame([(i % 1000, i // 1000) for i in ids], "o_orderkey long, o_custkey long")
    x, y = (F.col("o_orderkey") * 7919 % 1000) / 1000.0 + 0.00037, (F.col("o_custkey") * 104729 % 1000) / 1000.0 + 0.00041
    got = {r["o_custkey"] * 1000 + r["o_orderkey"] for r in orders.where(geo.strictly_in(x, y, accidents.CITY)).collect()}
    sql = f"SELECT id FROM (SELECT id, (id % 1000 * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE + 0.00037::DOUBLE AS x, ((id // 1000) * 104729 % 1000)::DOUBLE / 1000.0::DOUBLE + 0.00041::DOUBLE AS y FROM (SELECT unnest({ids}) AS id)) WHERE {accidents._inside('x', 'y')}"
    assert got == {r[0] for r in duckdb.connect().execute(sql).fetchall()} == {500500}


def test_toxicity_model_comes_from_a_task(spark):
    """The sample stays on the executors; its model is the one that a fit of the same rows gives."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("awful rubbish number "), F.col("id"))).otherwise(F.concat(F.lit("pleasant walk number "), F.col("id"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels, toxicity.learnable(), "text")
    assert isinstance(rows, DataFrame)
    here = toxicity.fit([(r["_y"], np.frombuffer(r["t"], np.uint32)) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])])
    there = toxicity.train(docs, labels)
    assert here["features"] and there["features"] == here["features"] and there["b"] == here["b"]
    assert np.array_equal(there["w"], here["w"]) and np.array_equal(there["v"], here["v"])


def test_graphml_files_grow_with_the_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphml, "LINES", 50, raising=False)
    nodes = spark.range(200).select(F.col("id").alias("node"))
    edges = spark.range(800).select((F.col("id") % 200).alias("u"), (F.col("id") % 7).alias("v"), F.col("id").alias("key"))
    graphml.write(nodes, edges, f"{tmp_path}/g")
    assert len(list((tmp_path / "g").glob("part-*"))) > 15
    back = graphml.read(spark, f"{tmp_path}/g")
    assert (back[0].count(), back[1].count()) == (200, 800)


def test_graphml_is_written_compressed_and_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Partitions of any number, one after the other, are a document; lines of the graph cross no disk but the folder's."""
    monkeypatch.setattr(graphml, "LINES", 30)
    nodes = spark.range(200).select(F.col("id").alias("node"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('<&"'), "id")).alias("text"))
    edges = spark.range(800).select((F.col("id") % 200).alias("u"), (F.col("id") % 7).alias("v"), F.col("id").alias("key"), (F.col("id") / 7).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.array(F.col("id"), F.lit(None)).alias("ids"))
    space, sc = "{http://graphml.graphdrawing.org/xmlns}", spark.sparkContext._jsc.sc()
    for name, some, links in (("parts", nodes, edges), ("one", nodes.coalesce(1), edges.coalesce(1)), ("no_nodes", nodes.limit(0), edges)):
        before = sc.newShuffleId()
        graphml.write(some, links, f"{tmp_path}/{name}", compression="gzip")
        assert name == "no_nodes" or sc.newShuffleId() == before + 1
        parts = [f.read_bytes() for f in sorted((tmp_path / name).glob("part-*.gz"))]
        assert max(gzip.decompress(b).count(b"</node>") + gzip.decompress(b).count(b"</edge>") for b in parts) <= 30
        root = ElementTree.fromstring(gzip.decompress(b"".join(parts)))
        assert [len(root.findall(f"{space}graph/{space}{x}")) for x in ("node", "edge")] == [some.count(), 800]
        back, found = graphml.read(spark, f"{tmp_path}/{name}", edge_types={"ids": "array<bigint>"})
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, some.collect()))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, links.collect()))


def test_graphml_query_keeps_no_plain_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = files.graphml_edges(spark, "/root/testdata/sf0.001").count()
    lines = spark.read.text(f"{tmp_path}/graph").where("startswith(value, '<edge')").agg(F.count("*"), F.sum(F.length("value"))).first()
    assert 0 < rows <= lines[0] and sum(f.stat().st_size for f in (tmp_path / "graph").glob("part-*")) < lines[1] / 4


def test_points_in_polygons_by_squares(spark, monkeypatch):
    """A large polygon with a hole over many places: whole squares count, those on a side are cut."""
    monkeypatch.setattr(providers, "PLACES", 2)
    rng = np.random.default_rng(3)
    spots = [(float(x), float(y)) for x, y in rng.normal(0, 1, (1500, 2))] + [(0.0, 0.0)] * 3
    ring, hole = [(-2.0, -1.5), (2.0, -1.0), (0.3, 2.0)], [(-0.4, -0.4), (0.5, -0.3), (0.1, 0.6)]
    zones = spark.createDataFrame([(1, [ring, hole]), (2, [hole]), (3, [[(9.0, 9.0), (9.5, 9.0), (9.0, 9.5)]])], "zone long, rings array<array<struct<x:double,y:double>>>")

    def odd(x, y, rings):
        sides = [(p, q) for r in rings for p, q in zip(r, [*r[1:], r[0]], strict=True)]
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in sides) % 2

    got = {r["zone"]: r["n"] for r in providers.points_in(zones, spark.createDataFrame(spots, "x double, y double"), 1.0).collect()}
    assert got == {1: sum(odd(x, y, [ring, hole]) for x, y in spots), 2: sum(odd(x, y, [hole]) for x, y in spots), 3: 0}


def test_components_of_leaves_pairs_and_gaps_of_any_size(spark, monkeypatch):
    """Nodes with one neighbour leave before the rounds; gaps in a row and by joins say the same."""
    links = [(5, 9), (5, 3), (5, 8), (8, 7), (20, 21), (30, 31), (31, 32), (32, 30), (32, 2), (40, 40), (50, 51), (51, 52), (52, 53), (53, 1)]
    want = {3: 3, 5: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20, 30: 2, 31: 2, 32: 2, 2: 2, 40: 40} | dict.fromkeys((50, 51, 52, 53, 1), 1)
    df = spark.createDataFrame(links, "u long, v long")
    sizes = []
    rounds = components._rounds
    monkeypatch.setattr(components, "_rounds", lambda x: sizes.append(x.count()) or rounds(x))
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want and sizes == [6]
    base = df.withColumn("key", F.lit(0)).withColumn("length", F.lit(1.0))
    gaps = spark.createDataFrame([(1, 3, 20, 1, 4.0), (1, 21, 30, 2, 4.0), (1, 70, 71, 3, 4.0), (2, 5, 9, 0, 9.0), (2, 9, 7, 5, 2.0), (3, 80, 81, 0, 1.0), (3, 81, 80, 1, 1.0)], "gap_id long, u long, v long, key int, length double")
    whole = {1: (True, 26 / 4), 2: (False, 16 / 5), 3: (False, 16 / 6)}
    for most in (0, 2, 100):
        monkeypatch.setattr(evaluation, "WHOLE", most)
        assert {r["gap_id"]: (r["connects"], r["mean_length"]) for r in evaluation.components_after(gaps, base).collect()} == whole


def test_map_files_by_columns(spark, tmp_path, monkeypatch):
    """Blocks of ways and relations are packed and read column by column, small ranges share tasks; a key twice is read as before."""
    rows = [(i, [n * i**5 % (1 << 62) - 7 for n in range(i % 5)], {"k": str(i % 3)} if i % 2 else {}) for i in range(90)]
    text = lambda r: {"id": r[0], "nodes": r[1], "tags": list(r[2].items())}
    block = mapfiles.block([text(r) for r in rows], "ways")
    for options in ({}, {"tagged": "true"}, {"keys": "k,x"}, {"tag": "k=2"}, {"tag": "k=7"}):
        want = mapfiles.Wanted({"kind": "ways", "columns": "id,tags,nodes", **options})
        schema = pa.schema([("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("nodes", pa.list_(pa.int64()))])
        slow = [(e["id"], e["nodes"], sorted(e["tags"].items())) for e in mapfiles.elements(block, want)]
        assert [(r["id"], r["nodes"], sorted(r["tags"])) for r in mapfiles.batch(block, want, schema).to_pylist()] == slow
    f = mapfiles._field
    twice = f(1, f(1, b"") + f(1, b"k") + f(1, b"a") + f(1, b"b")) + f(2, f(3, f(1, 5) + f(2, b"\1\1") + f(3, b"\2\3")))
    want = mapfiles.Wanted({"kind": "ways"})
    assert mapfiles.batch(twice, want, schema) is None and next(mapfiles.elements(twice, want))["tags"] == {"k": "b"}
    monkeypatch.setattr(mapfiles, "TASKS", 3)
    mapfiles.write(spark.createDataFrame(rows, "id long, nodes array<long>, tags map<string,string>"), str(tmp_path), "ways", 10).collect()
    back = mapfiles.ways(spark, str(tmp_path), range_bytes=97)
    parts = mapfiles.MapFileReader({"path": f"file://{tmp_path}", "range_bytes": "97"}).partitions()
    assert len(parts) <= 3 < sum(len(p.ranges) for p in parts)
    assert sorted((r["id"], r["nodes"], r["tags"]) for r in back.collect()) == [tuple(r) for r in rows]


def test_sublists_meet_at_their_rarest_id(spark):
    """A frequent id brings no pairs where a gap has a rarer one; lengths of gaps are joined to edges, not to pairs."""
    rows = [(i, [7, i]) for i in range(100, 160)] + [(1, [7, 120]), (2, [120]), (3, [7, 121, 5]), (4, [121, 5]), (5, [5, 121]), (6, [])]
    df = spark.createDataFrame(rows, "gap_id long, gap array<long>")
    out = gaps.without_sublists(df)
    assert {r["gap_id"] for r in out.collect()} == {i for i, _ in rows} - {120, 121, 2, 4}
    assert not re.search(r"Aggregate \[gap_id#\d+L?, other_id", out._jdf.queryExecution().optimizedPlan().toString())
    plan = gaps.overlaps(df.select("gap_id", F.explode("gap").alias("edge"), F.lit(1.0).alias("length")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [gap_id") < plan.index("Join Inner") and plan.count("Join Inner") == 3


def test_states_of_rides_do_not_grow_with_the_keys(spark, tmp_path):
    """Keys share slots; their rides, late and idle rows are each key's own."""
    start = datetime.datetime(2024, 3, 1)
    at = lambda m: start + datetime.timedelta(minutes=m)
    first = [(k, at((k * 7 + i * 31) % 100), (k + i) % 3) for k in range(300) for i in range(4)]
    second = [(k, at(130 + k % 5), 9) for k in range(0, 300, 2)] + [(1, at(20), 5)]
    with incremental.ordered_state(spark):
        for rows in (first, [(-1, at(125), 0)], second, [(-1, at(9000), 0)]):
            spark.createDataFrame(rows, "key long, time timestamp, place long").write.mode("append").parquet(f"{tmp_path}/in")
            out = incremental.rides(incremental.poll(spark, f"{tmp_path}/in", "key long, time timestamp, place long"), idle_ms=3_600_000, slots=4)
            query = incremental.started(out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out"))
            query.awaitTermination()
            assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 60
    got = spark.read.schema(incremental.OUT).parquet(f"{tmp_path}/out").where("key >= 0").collect()
    want = []
    for k in range(300):
        own = sorted((t, p) for key, t, p in first + second[:-1] if key == k)
        want += [(k, a[0], b[0], a[1], b[1]) for a, b in zip(own, own[1:], strict=False) if a[1] != b[1]]
    assert sorted((r["key"], r["start_time"], r["finish_time"], r["start_place"], r["finish_place"]) for r in got if r["kind"] == "ride") == sorted(want)
    assert [(r["key"], r["finish_time"], r["finish_place"]) for r in got if r["kind"] == "late"] == [(1, at(20), 5)]
    assert sorted(r["key"] for r in got if r["kind"] == "idle") == list(range(300))


def test_only_edges_within_chains_are_walked(spark, monkeypatch):
    """Rounds hold edges that go on from another one; single edges, rings and parallel ones come out as before."""
    single = [(1000 + 2 * i, 1001 + 2 * i, 0, 1, 1.0) for i in range(200)]
    chain = [(i, i + 1, 0, 7, 0.5) for i in range(6)]
    twice = [(20, 21, 5, 3, 1.0), (20, 21, 9, 3, 2.0), (21, 22, 4, 3, 4.0), (21, 22, 6, 3, 8.0)]
    ring = [(30, 31, 0, 2, 1.0), (31, 32, 0, 2, 1.0), (32, 30, 0, 2, 1.0)]
    loose = [(40, 41, 0, 1, 1.0), (41, 42, 0, 2, None), (42, 43, 0, 2, 3.0)]
    held, write = [], chains.written
    monkeypatch.setattr(chains, "written", lambda df, name="cut": (lambda out: (held.append((name, out.count())), out)[1])(write(df, name)))
    edges = spark.createDataFrame(single + chain + twice + ring + loose, "u long, v long, key long, osmid long, length double")
    got = sorted((r["u"], r["v"], r["key"], r["osmids"], r["length"], r["n_edges"], r["nodes"]) for r in chains.simplified(edges).collect())
    want = [(u, v, 0, [w], x, 1, [u, v]) for u, v, _, w, x in [*single, loose[0]]] + [(0, 6, 0, [7], 3.0, 6, list(range(7))), (41, 43, 0, [2], 3.0, 2, [41, 42, 43])]
    assert got == sorted([*want, (20, 22, 0, [3], 5.0, 2, [20, 21, 22]), (20, 22, 1, [3], 10.0, 2, [20, 21, 22])])
    assert max(n for name, n in held if name == "walk") == 5 + 2 + 3 + 1


def test_predicates_look_up_each_tag_once(spark):
    """Counts of predicates are those of their names, from one lookup of a tag a row."""
    tags_ = [{"highway": "primary", "lanes": "2", "cycleway": "lane"}, {"highway": "residential", "bicycle": "designated", "foot": "yes"}, {"lanes": "x", "oneway": "yes"}, {}, None]
    rows = spark.createDataFrame([(t, b) for t in tags_ for b in (True, False, None)], "tags map<string,string>, back boolean")
    model = tags.MODEL_1 + tags.MODEL_2
    want = rows.select(F.explode(tags.applied(F.col("tags"), F.col("back"), model)).alias("name")).groupBy("name").count().collect()
    got = tags.counted(rows, "tags", "back", model)
    assert want and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    plan = ways.all_predicates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    asked = re.findall(r"element_at\(tags#\d+, ([^,]+),", plan)
    assert len(asked) == len(set(asked)) > 15
    assert "explode" not in plan


def test_edges_meet_their_areas_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ROWS", 50, raising=False)
    edges = spark.range(1001).select((F.col("id") % 30).alias("u"), (F.col("id") % 7 + 100).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 90).alias("osmid"))
    areas = spark.range(0, 90, 2).select(F.col("id").alias("osmid"), (F.col("id") * 2.0).alias("area"))
    want = {}
    for i in range(1001):
        half = float(i % 90) if i % 5 and i % 90 % 2 == 0 else 0.0
        for node in (i % 30, i % 7 + 100):
            want[node] = want.get(node, 0.0) + half
    out = evaluation.node_areas(edges, areas)
    assert {r["node"]: r["area"] for r in out.collect()} == want
    # 1,001 edges in tasks of 50
    assert re.search(r"RepartitionByExpression \[osmid#\d+L?\], 21", out._jdf.queryExecution().optimizedPlan().toString())


def _listed(edges):
    """All maximal simple paths of (u, v) pairs, by plain recursion."""
    nexts = {}
    for u, v in edges:
        nexts.setdefault(u, set()).add(v)

    def on(path):
        if path[-1] not in nexts:
            return [path]
        return [p for v in nexts[path[-1]] if v is not None and v not in path for p in on([*path, v])]

    return sorted(p for u in nexts if u is not None and u not in {v for _, v in edges} for p in on([u]))


def test_more_paths_than_can_be_stored(spark):
    """2 ** 58 paths: they are listed as they are read, not written first."""
    edges = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60)], "u long, v long")
    rows = gaps.simple_paths(edges).limit(300).collect()
    assert len({tuple(r["path"]) for r in rows}) == 300
    assert all(r["start"] == r["path"][0] == 0 and r["path"][-1] == 59 and r["path"] == sorted(set(r["path"])) for r in rows)


def test_paths_in_tasks_and_by_joins_are_all_paths(spark, monkeypatch):
    monkeypatch.setattr(gaps, "LIGHT", 1.0)
    rng = random.Random(11)
    rings = [(rng.randrange(9), rng.randrange(1, 9)) for _ in range(22)] + [(20, 3), (20, 20), (21, 22), (22, 21), (30, 31), (0, 4)]
    full = [(i, j) for i in range(13) for j in range(i + 1, 13)] + [(i, j) for i in (40, 41) for j in (2, 50)]
    odd = [(1, 2), (2, None), (2, 3), (None, 3), (4, None), (5, 3), (5, 3)]
    for edges in (rings, full, odd):
        want, df = _listed(edges), spark.createDataFrame(edges, "u int, v long")
        assert want
        for most in (gaps.MOST_EDGES, 0):
            rows = gaps.simple_paths(df, most).collect()
            assert sorted(r["path"] for r in rows) == want
            assert all(r["start"] == r["path"][0] for r in rows)
    assert gaps.simple_paths(df.limit(0)).count() == gaps.simple_paths(df.limit(0), -1).count() == 0
    names = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "u string, v string")
    assert sorted(r["path"] for r in gaps.simple_paths(names).collect()) == [["a", "b", "c"], ["a", "b", "d"]]
