"""Providers, builder and evaluator on small tables; readers that no query calls."""

import json

import pytest
from pyspark.sql import functions as F

from wheelwork.functions import shapes as H
from wheelwork.operators import providers as V
from wheelwork.sources import rasters as R
from wheelwork.sources import readers, sinks


def polygon(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
U_SHAPE = [(0, 0), (6, 0), (6, 5), (4, 5), (4, 2), (2, 2), (2, 5), (0, 5)]


def test_overlap_of_concave_polygons_with_holes(spark):
    cells = lambda inside: {(x, y) for x in range(-9, 9) for y in range(-9, 9) if inside(x + 0.5, y + 0.5)}
    in_l = lambda x, y: 0 < x < 4 and 0 < y < 4 and not (x > 2 and y > 2)
    in_u = lambda x, y: 0 < x < 6 and 0 < y < 5 and not (2 < x < 4 and y > 2)
    hole = [(1, 1), (1, 2), (5, 2), (5, 1)]
    rows = [(polygon(L_SHAPE), polygon([(x - 1, y - 1) for x, y in U_SHAPE])), (polygon(U_SHAPE[::-1], hole), polygon(L_SHAPE)), (polygon(L_SHAPE), polygon([(50, 50), (51, 50), (50, 51)])), (polygon(L_SHAPE), [])]
    want = [len(cells(in_l) & cells(lambda x, y: in_u(x + 1, y + 1))), len((cells(in_u) - cells(lambda x, y: 1 < x < 5 and 1 < y < 2)) & cells(in_l)), 0, 0]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a array<{H.RING}>, b array<{H.RING}>")
    got = df.select("i", H.overlap_area(F.col("a"), F.col("b")).alias("s"), H.overlap_area(F.col("b"), F.col("a")).alias("t")).orderBy("i").collect()
    assert [r["s"] for r in got] == pytest.approx(want) and [r["t"] for r in got] == pytest.approx(want)


def test_districts_and_trips(spark):
    districts = spark.createDataFrame([("l", 600, polygon(L_SHAPE)), ("far", 10, polygon([(8, 8), (9, 8), (9, 9), (8, 9)])), ("far", 10, polygon([(10, 8), (11, 8), (11, 9), (10, 9)]))], f"district string, population int, rings array<{H.RING}>")
    zones = spark.createDataFrame([("a", polygon([(1, 1), (3, 1), (3, 3), (1, 3)])), ("b", polygon([(7, 7), (12, 7), (12, 8.5), (7, 8.5)])), ("c", polygon([(-5, -5), (-4, -5), (-4, -4)]))], f"zone string, rings array<{H.RING}>")
    people = V.DistrictPopulation(districts, 1.5)
    assert {r["zone"]: round(r["total"], 9) for r in people.in_polygons(zones).collect()} == {"a": 150.0, "b": 5.0, "c": 0.0}
    spots = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.0, 3.0), (3, 10.5, 8.5), (4, -1.0, 0.0)], "id long, x double, y double")
    assert {r["id"]: r["value"] for r in people.at_points(spots).collect()} == {1: 0.0, 2: 600.0, 3: 10.0, 4: 0.0}
    trips = V.TripDemand(spots, spots.where("id < 3"), 2.5)
    assert {r["id"]: (r["starts"], r["ends"]) for r in trips.demand_at(spots).collect()} == {1: (2, 2), 2: (2, 2), 3: (1, 0), 4: (1, 0)}
    assert {r["zone"]: (r["starts"], r["ends"]) for r in trips.demand_in(zones).collect()} == {"a": (0, 0), "b": (0, 0), "c": (0, 0)}


def test_graph_of_map_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 11.00005, 49.00005), (2, 11.00105, 49.00005), (3, 11.00205, 49.00005)], "node long, x double, y double")
    ways = spark.createDataFrame([(7, {"highway": "residential", "oneway": "yes", "oneway:bicycle": "no"}, [1, 2]), (8, {"highway": "cycleway", "oneway:bicycle": "yes"}, [2, 3])], "osmid long, tags map<string,string>, nodes array<long>")
    raster = spark.createDataFrame([(110000 + i, 490000, 10.0 * i) for i in range(-5, 30)], "col long, row long, value double")
    files = R.write_sheets(raster, f"file://{tmp_path}/dem", 1e-4, 1e-4, side=64, tile=32)
    height = V.RasterPopulation(R.tiles(spark, [r["path"] for r in files.collect()]))
    rules = spark.createDataFrame([(7, 8, "no_straight_on")], "osmid_in long, osmid_out long, restriction string")
    flat = V.GraphBuilder(ways, nodes)
    e = {(r["u"], r["v"]): r for r in flat.edges().collect()}
    assert set(e) == {(1, 2), (2, 1), (2, 3)} and all(72 < r["length"] < 74 and r["slope_percentage"] == 0 for r in e.values())
    assert e[1, 2]["weight"] == pytest.approx(e[1, 2]["length"] * e[1, 2]["penalty"])
    hilly = V.GraphBuilder(ways, nodes, rules, height).edges()
    slopes = {(r["u"], r["v"]): r["slope_percentage"] for r in hilly.collect()}
    assert slopes[1, 2] == pytest.approx(100 / e[1, 2]["length"] * 100) and slopes[2, 1] == pytest.approx(-slopes[1, 2])
    turns = V.GraphBuilder(ways, nodes, rules).turns(flat.edges())
    assert flat.turns(flat.edges()).count() == 1 and turns.count() == 0


def test_gap_evaluator_options(spark):
    net = spark.createDataFrame([(1, 2, 0, 4.0), (3, 4, 0, 6.0)], "u long, v long, key long, length double")
    gap = spark.createDataFrame([(9, 2, 3, 0, 2.0, 0.5)], "gap_id long, u long, v long, key long, length double, betweenness double")
    cells, people = spark.createDataFrame([(9, 1), (9, 2)], "gap_id long, cell long"), spark.createDataFrame([(2, 30.0)], "cell long, population double")
    all_on = V.GapEvaluator(net, cells, spark.createDataFrame([(1,)], "cell long"), people, 2.5)
    r = all_on.metrics(gap).first()
    assert (r["connects"], r["mean_length"], r["added_area"], r["added_population"], r["benefit"]) == (True, 12.0, 2.5, 30.0, 1.0)
    off = V.GapEvaluator(net, cells, people, people, connectedness=False, coverage=False)
    assert set(off.metrics(gap).columns) & {"connects", "mean_length", "added_area", "added_population"} == {"added_population"}
    assert "added_area" not in V.GapEvaluator(net).metrics(gap).columns


def test_lookups(spark):
    e = spark.createDataFrame([(1, 2, 0, 7), (2, 3, 0, 8), (3, 4, 0, 8)], "u long, v long, key long, osmid long")
    got = {r["osmid"]: (r["n"], r["edge"] and tuple(r["edge"])) for r in V.edge_of_way(e, spark.createDataFrame([(7,), (8,), (9,)], "osmid long")).collect()}
    assert got == {7: (1, (1, 2, 0)), 8: (2, None), 9: (0, None)}
    nodes = spark.createDataFrame([(5, 1, 0.0, 0.0), (6, 1, 1.0, 1.0), (7, 2, 2.0, 2.0)], "node long, osmid long, x double, y double")
    assert sorted((r["osmid"], r["node"], r["x"]) for r in V.one_node_a_place(nodes).collect()) == [(1, 5, 0.0), (2, 7, 2.0)]


def test_readers_that_no_query_calls(spark, tmp_path):
    kinds = {"data": {"vehicle_types": [{"vehicle_type_id": "7", "name": "bike", "form_factor": "bicycle"}, {"vehicle_type_id": "x", "name": "?"}]}}
    (tmp_path / "types.json").write_text(json.dumps(kinds))
    assert sorted((r["vehicle_type_id"] or -1, r["name"]) for r in readers.vehicle_types(spark, str(tmp_path / "types.json")).collect()) == [(-1, "?"), (7, "bike")]
    (tmp_path / "fleet.csv").write_text("date;bikes\n2024-01-02;a,b\n2024-01-03;\n")
    assert [(str(r["date"]), r["bikes"]) for r in readers.fleet_days(spark, str(tmp_path / "fleet.csv")).collect()] == [("2024-01-02", ["a", "b"])]
    zone = lambda city: {"type": "Feature", "properties": {"cityId": city}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}}
    (tmp_path / "zones.json").write_text(json.dumps({"type": "FeatureCollection", "features": [zone(1), zone(2)]}))
    assert [(r["city"], len(r["rings"][0])) for r in readers.zones(spark, str(tmp_path / "zones.json"), 2).collect()] == [(2, 4)]
    (tmp_path / "rentals.csv").write_text('Start time,End time,Duration,Rental place,Return place,starting_position,finishing_position\n2024-05-01 10:00:00,2024-05-01 10:10:00,600,A,B,POINT (11.5 49.25),POINT (x y)\n')
    r = readers.processed_rentals(spark, str(tmp_path / "rentals.csv")).first()
    assert (r["duration"], r["rental_place"], r["start"]["lon"], r["start"]["lat"], r["finish"]["lon"]) == (600, "A", 11.5, 49.25, None)


def test_compaction_drops_its_sources(spark, tmp_path):
    for i in range(3):
        spark.sql(f"SELECT timestamp'2024-01-02 0{i}:00:00' AS time, {i} AS k").write.parquet(f"{tmp_path}/in/{i}")
    parts = [f"{tmp_path}/in/{i}" for i in range(3)]
    sinks.compact_sources(spark, parts, f"{tmp_path}/day")
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/day").collect()) == [0, 1, 2]
    assert not list((tmp_path / "in").iterdir())
