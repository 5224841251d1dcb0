"""GraphML documents, well-known binary and GeoPackage layers, read and written."""

import glob
import sqlite3
import struct
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from wheelwork.functions import wkb as W
from wheelwork.sources import geopackage as GP
from wheelwork.sources import graphml as GM


def test_graphml_document(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x" attr.type="double"/>
<key id="d1" for="edge" attr.name="osmid" attr.type="string"/><key id="d2" for="edge" attr.name="oneway" attr.type="string"><default>True</default></key>
<key id="d3" for="all" attr.name="n" attr.type="int"/><graph edgedefault="directed"><node id="5"><data key="d0">1.5</data><data key="d3">7</data></node><node id="6"/>
<edge source="5" target="6" id="1"><data key="d1">[12, 13]</data></edge><edge source="6" target="5"><data key="d1">x &amp; y</data><data key="d2">False</data></edge></graph></graphml>""")
    nodes, edges = GM.read(spark, str(tmp_path / "g.graphml"), edge_types={"osmid": "array<bigint>", "oneway": "boolean"})
    assert sorted(map(tuple, nodes.collect())) == [(5, 1.5, 7), (6, None, None)]
    assert sorted((r["u"], r["v"], r["key"], r["osmid"], r["oneway"], r["n"]) for r in edges.collect()) == [(5, 6, 1, [12, 13], True, None), (6, 5, 0, None, False, None)]


def test_graphml_parts_are_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([(i, i / 3, None if i % 2 else "a<&>\"'\n" + chr(1) + "é") for i in range(50)], "node long, x double, text string")
    edges = spark.createDataFrame([(i, (i * 7) % 50, i % 3, [i, -i], {"k": "v"}) for i in range(80)], "u long, v long, key long, ids array<long>, tags map<string,string>")
    GM.write(nodes, edges, f"{tmp_path}/g", files=5)
    whole = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/g/part-*")))
    root = ElementTree.fromstring(whole.encode())
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f"{space}graph/{space}node")) == 50 and len(root.findall(f"{space}graph/{space}edge")) == 80
    back, links = GM.read(spark, f"{tmp_path}/g", edge_types={"ids": "array<bigint>"})
    assert {tuple(r) for r in back.collect()} == {(i, i / 3, None if i % 2 else "a<&>\"'\né") for i in range(50)}
    assert {(r["u"], r["v"], r["key"], tuple(r["ids"]), r["tags"]) for r in links.collect()} == {(i, (i * 7) % 50, i % 3, (i, -i), '{"k":"v"}') for i in range(80)}
    GM.write(nodes.limit(0), edges.limit(0), f"{tmp_path}/none")
    assert [x.count() for x in GM.read(spark, f"{tmp_path}/none")] == [0, 0]


def P(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


GEOMETRIES = [
    (1, [[P((1, -2.5))]]), (2, [[P((0, 0), (1e300, 2), (3, 4))]]), (3, [[P((0, 0), (4, 0), (4, 4), (0, 0)), P((1, 1), (2, 1), (1, 2), (1, 1))]]),
    (4, [[P((1, 2))], [P((3, 4))]]), (5, [[P((0, 0), (1, 1))], [P((2, 2), (3, 3), (4, 5))]]), (6, [[P((0, 0), (4, 0), (4, 4), (0, 0))], [P((9, 9), (8, 9), (9, 8), (9, 9)), P((0, 0), (0, 1), (1, 0), (0, 0))]]),
    (1, []), (2, []), (3, []), (6, []),
]


@pytest.mark.parametrize("little", [True, False])
def test_wkb_round_trip(spark, little):
    df = spark.createDataFrame([(i, {"kind": k, "parts": p}) for i, (k, p) in enumerate(GEOMETRIES)] + [(99, None)], f"i int, g {W.GEOMETRY}")
    out = df.select("i", W.to_wkb(F.col("g"), little).alias("b")).select("i", "b", W.from_wkb(F.col("b")).alias("g")).orderBy("i").collect()
    for r, (kind, parts) in zip(out, GEOMETRIES, strict=False):
        assert r["b"][0] == little and struct.unpack_from("<I" if little else ">I", r["b"], 1)[0] == kind
        got = [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in r["g"]["parts"]]
        want = [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in parts]
        # an empty line has one ring without points, an empty polygon one part without rings
        assert (r["g"]["kind"], got) == (kind, want or {2: [[[]]], 3: [[]]}.get(kind, []))
    assert out[-1]["b"] is None and out[-1]["g"] is None


def test_wkb_heights_systems_and_collections():
    point = struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 9.0)
    assert W.decoded(point)[:2] == (1, [[P((1, 2))]])
    extended = struct.pack(">BII4d", 0, 0x80000000 | 0x40000000 | 0x20000000 | 1, 4326, 1.0, 2.0, 9.0, 8.0)
    assert W.decoded(extended)[:2] == (1, [[P((1, 2))]])
    line = struct.pack("<BII6d", 1, 2002, 2, 0, 0, 5, 1, 1, 5)
    both = struct.pack("<BII", 1, 7, 2) + point + line
    assert W.decoded(both) == (7, [[P((1, 2))], [P((0, 0), (1, 1))]], len(both))
    with pytest.raises(ValueError):
        W.decoded(struct.pack("<BI", 1, 15))


def test_layers(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else i / 3, f"n'{i}\"", i % 2 == 0, [i], bytes([i]), None if i % 7 == 0 else {"kind": 1, "parts": [[P((i, -i))]]}) for i in range(40)]
    df = spark.createDataFrame(rows, f'fid int, `a "b` double, `c,d` string, e boolean, f array<int>, g binary, shape {W.GEOMETRY}').withColumn("shape", W.to_wkb(F.col("shape"))).repartition(3)
    files = GP.write(df, f"file://{tmp_path}/l", "lay\"er", 1, shape="shape").collect()
    assert sum(r["n"] for r in files) == 40
    paths = [r["path"] for r in files]
    db = sqlite3.connect(paths[0].removeprefix("file://"))
    assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and db.execute("SELECT geometry_type_name FROM gpkg_geometry_columns").fetchall() == [("POINT",)]
    assert {r["layer"] for r in GP.layers(spark, paths).collect()} == {'lay"er'}
    back = GP.read(spark, paths, 'lay"er', rows=4).withColumn("shape", W.from_wkb(F.col("shape")))
    got = sorted((r["fid"], r['a "b'], r["c,d"], r["e"], r["f"], bytes(r["g"]), r["shape"] and r["shape"]["parts"][0][0][0]["x"]) for r in back.collect())
    assert got == [(i, a, b, c, f"[{i}]", e, None if s is None else float(i)) for i, a, b, c, _, e, s in rows]
    assert GP.write(df.limit(0), f"file://{tmp_path}/none", "x", 1, shape="shape").count() == 0
