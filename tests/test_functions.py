"""Expressions against literal cases."""

import pytest
from pyspark.sql import functions as F

from wheelwork.functions import codes, geo, tags, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_strings(spark):
    assert one(spark, text.decimal_comma(F.lit("11,5"))) == 11.5
    assert one(spark, text.decimal_comma(F.lit("a"))) is None
    assert one(spark, text.is_tuple(F.lit("(1, 2)")))
    assert one(spark, text.parse_tuple(F.lit("(1, 2)"))) == [1, 2]
    assert one(spark, text.split_outside_brackets(F.lit("1360463310, (1360463310, 1360463309), 0"))) == ["1360463310", "(1360463310, 1360463309)", "0"]
    assert one(spark, text.is_sublist(ints(8, 2, 1, 7), ints(5, 6, 3, 8, 2, 1, 7, 1)))
    assert not one(spark, text.is_sublist(ints(1, 2), ints(11, 2)))
    assert one(spark, text.jaccard(ints(7, 6, 5), ints(5, 6, 7))) == 1.0
    assert one(spark, text.split_ids(F.lit(""))) == []
    assert one(spark, text.file_stem(F.lit("/a/b/2024-01-02.json"))) == "2024-01-02"


def test_codes(spark):
    assert one(spark, codes.mapped("month", F.lit(3))) == "März"
    assert one(spark, codes.mapped("hour", F.lit(18))) == "18:00 - 19:00"
    assert one(spark, codes.mapped("hour", F.lit(19))) == "19.00 - 20.00"
    assert one(spark, codes.mapped("light", F.lit(9))) == "Unbekannte Lichtverhältnisse"
    assert one(spark, codes.participants([(F.lit(True), "a"), (F.lit(False), "b"), (F.lit(True), "c")])) == "a, c"


@pytest.mark.parametrize(("angle", "want"), [(-61, "left"), (-60, "straight"), (60, "straight"), (61, "right")])
def test_turns(spark, angle, want):
    assert one(spark, geo.turn_direction(F.lit(angle))) == want


def test_geometry(spark):
    assert one(spark, geo.normal_angle(F.lit(190.0))) == -170
    assert one(spark, geo.normal_angle(F.lit(-190.0))) == 170
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    for x, y, inside in ((0.5, 0.5, True), (1.5, 0.5, False), (1.0, 0.5, False), (0.0, 0.0, False)):
        assert one(spark, geo.strictly_in(F.lit(x), F.lit(y), square)) is inside
    assert geo.ring_area(square) == 1
    e, n = geo.utm(F.lit(9.0), F.lit(0.0))
    assert one(spark, F.round(e, 3)) == 500000 and abs(one(spark, n)) < 1e-6
    assert one(spark, geo.from_wkt(geo.point_wkt(F.lit(11.5), F.lit(-4.25)))).asDict() == {"lon": 11.5, "lat": -4.25}


def test_tags(spark):
    t = lambda **kv: F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("_", ":"), v)])
    no, yes = F.lit(False), F.lit(True)
    assert one(spark, tags.has_bike_lane(t(cycleway_right="lane"), no))
    assert not one(spark, tags.has_bike_lane(t(cycleway_right="lane"), yes))
    assert one(spark, tags.is_large_road(t(highway="primary", lanes="2"), no))
    assert not one(spark, tags.is_medium_road(t(highway="primary", lanes="1"), no))
    assert one(spark, tags.is_medium_road(t(highway="primary", lanes="1", lanes_forward="1", lanes_backward="1"), no))
    assert one(spark, tags.is_cycleway(t(bicycle="designated"), no))
    assert one(spark, tags.not_matches(t(highway="path"), "surface", "gravel"))
    assert round(one(spark, tags.penalty(t(highway="primary", cycleway="lane"), no, F.lit(5.0))), 6) == round(1 + 1.203 - 0.16 + 7.15, 6)
    assert one(spark, tags.street_class(t(highway="secondary:link"))) == 2


def test_spheroid_lines(spark):
    from wheelwork.functions import geo

    # a published test line of a land survey, arcs of the equator and of a meridian, a point, a nearly opposite one
    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (1 if d > 0 else -1)
    lines = [(dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610)), (0.0, 0.0, 1.0, 0.0), (179.5, 0.0, -179.5, 0.0), (5.0, 0.0, 5.0, 90.0), (11.0, 49.0, 11.0, 49.0), (0.0, 0.0, 179.9, 0.1)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i int, a double, b double, c double, d double")
    got = [r["m"] for r in df.select("i", geo.geodesic(df.a, df.b, df.c, df.d).alias("m")).orderBy("i").collect()]
    assert abs(got[0] - 54972.271) < 0.001 and abs(got[1] - 111319.4908) < 0.001 and abs(got[2] - 111319.4908) < 0.001 and abs(got[3] - 10001965.7293) < 0.001
    assert got[4] == 0 and got[5] is None
