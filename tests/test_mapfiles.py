"""Map files: any ranges give the whole, filters, versions, plain and dense nodes, damage."""

import datetime
import random

import numpy as np
import pytest

from wheelwork.sources import mapfiles as M


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: rng.choice(["ä", "yes", "no", "OSMData", "\n\x07OSMData", "x" * 200])
    tags = lambda: {k: word() for k in rng.sample(["highway", "name", "oneway", "OSMData", "ref"], rng.choice([0, 0, 1, 3]))}
    nodes = [(i * 7 - 300, rng.randint(-1800000000, 1800000000) / 1e7, rng.randint(-900000000, 900000000) / 1e7, tags()) for i in range(700)]
    ways = [(i + (1 << 33), [rng.randint(-5, 1 << 40) for _ in range(rng.randint(0, 9))], tags()) for i in range(500)]
    return nodes, ways


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("map"))
    nodes, ways = rows
    M.write(spark.createDataFrame(nodes, "id long, lon double, lat double, tags map<string,string>"), top, "nodes", 40).collect()
    M.write(spark.createDataFrame(ways, "id long, nodes array<long>, tags map<string,string>"), top, "ways", 40).collect()
    return top


@pytest.mark.parametrize("size", [97, 1009, 20_000, 1 << 26])
def test_ranges(spark, folder, rows, size):
    nodes, ways = rows
    got = M.nodes(spark, folder, range_bytes=size, columns="id,lon,lat,tags").collect()
    assert sorted((r["id"], round(r["lon"], 7), round(r["lat"], 7), sorted(r["tags"].items())) for r in got) == [(i, x, y, sorted(t.items())) for i, x, y, t in nodes]
    if size > 1000:
        got = M.ways(spark, folder, range_bytes=size).collect()
        assert sorted((r["id"], r["nodes"], sorted(r["tags"].items())) for r in got) == [(i, n, sorted(t.items())) for i, n, t in ways]


def test_filters(spark, folder, rows):
    _, ways = rows
    ids = lambda **o: sorted(r["id"] for r in M.ways(spark, folder, columns="id", **o).collect())
    assert ids(tagged=True) == [i for i, _, t in ways if t]
    assert ids(keys="name,ref") == [i for i, _, t in ways if "name" in t or "ref" in t]
    assert ids(tag="highway=yes") == [i for i, _, t in ways if t.get("highway") == "yes"]
    assert ids(keys="nothing") == []


def test_relations_and_rules(spark, tmp_path):
    kind = "id long, tags map<string,string>, members array<struct<kind:string,ref:long,role:string>>"
    rows = [(1, {"type": "restriction", "restriction": "no_u_turn"}, [("way", 5, "from"), ("node", 9, "via"), ("way", 6, "to"), ("way", 7, "to")]), (2, {"type": "multipolygon"}, [("way", 5, "outer")]), (3, {"type": "restriction"}, None)]
    M.write(spark.createDataFrame(rows, kind), str(tmp_path), "relations").collect()
    found = M.restrictions(spark, str(tmp_path))
    assert sorted((r["id"], [tuple(m) for m in r["via"]]) for r in found.collect()) == [(1, [("node", 9)]), (3, [])]
    assert sorted(map(tuple, M.turn_rules(found).collect())) == [(5, 6, "no_u_turn"), (5, 7, "no_u_turn")]


def test_versions(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [(1, [1, 2], {"a": "1"}, 1, day(1), True), (1, [1, 3], {"a": "2"}, 2, day(5, 20), True), (1, [], {}, 3, day(9), False), (2, [4], {}, 1, day(6), True)]
    M.write(spark.createDataFrame(rows, "id long, nodes array<long>, tags map<string,string>, version int, time timestamp, visible boolean"), str(tmp_path), "ways").collect()
    at = lambda d: sorted((r["id"], r["version"]) for r in M.as_of(M.ways(spark, str(tmp_path)), d).collect())
    assert at("2023-12-31") == [] and at("2024-01-04") == [(1, 1)] and at("2024-01-05") == [(1, 2)] and at("2024-01-06") == [(1, 2), (2, 1)] and at("2024-02-01") == [(2, 1)]


def test_plain_nodes_and_packings(spark, tmp_path):
    f = M._field
    node = lambda i, lat, lon: f(1, f(1, M._sign(i)) + f(2, M.packed_varint(1)) + f(3, M.packed_varint(2)) + f(8, M._sign(lat)) + f(9, M._sign(lon)))
    content = f(1, f(1, b"") + f(1, b"k") + f(1, b"v")) + f(2, node(-3, 500, -70)) + f(17, 1000) + f(19, 10_000_000_000)
    raw = f(1, content)
    head = f(1, b"OSMData") + f(3, len(raw))
    (tmp_path / "x.pbf").write_bytes(M.blob(b"OSMHeader", b"") + len(head).to_bytes(4, "big") + head + raw)
    r = M.nodes(spark, str(tmp_path / "x.pbf")).first()
    assert (r["id"], r["lat"], r["lon"], r["tags"]) == (-3, 10.0005, -0.00007, {"k": "v"})
    data = (tmp_path / "x.pbf").read_bytes()
    (tmp_path / "x.pbf").write_bytes(data[:-2])
    with pytest.raises(Exception, match="damaged"):
        M.nodes(spark, str(tmp_path / "x.pbf")).count()


def test_varints():
    rng = np.random.default_rng(0)
    values = [0, 1, 127, 128, (1 << 62) + 5, *rng.integers(0, 1 << 60, 50).tolist(), -1]
    assert M.varints(b"".join(map(M.packed_varint, values))).tolist() == values
    assert [M.signed(M._sign(x)) for x in (0, -1, 1, -(1 << 40))] == [0, -1, 1, -(1 << 40)]
    assert M.varints(b"").tolist() == []
