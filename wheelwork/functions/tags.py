"""Predicates over way tags and travel direction, and the cost models built from them.

A predicate is a function of a tags map column and a boolean column that says whether
the way is travelled backward. Users may pass predicates of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[Column, Column], Column]


class Asked:
    """Stands for a tags map and notes which keys are asked for: a column of its own for each."""

    def __init__(self):
        self.columns: dict[str, str] = {}

    def __call__(self, key: str) -> Column:
        return F.col(self.columns.setdefault(key, f"_tag{len(self.columns)}"))


def tag(tags: Column | Asked, key: str) -> Column:
    return tags(key) if isinstance(tags, Asked) else F.try_element_at(tags, F.lit(key))


def has(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def _cycleway(value: str) -> Predicate:
    return lambda t, back: has(t, "cycleway", value) | has(t, "cycleway:both", value) | (~back & has(t, "cycleway:right", value)) | (back & has(t, "cycleway:left", value))


def lanes(tags: Column, key: str, default: int) -> Column:
    return F.coalesce(tag(tags, key).try_cast("int"), F.lit(default))


LANES = ("lanes", "lanes:forward", "lanes:backward")
has_bike_lane, has_bike_track = _cycleway("lane"), _cycleway("track")


def has_bike_path(t, back):
    return has(t, "bicycle", "designated")


def has_exclusive_bike_path(t, back):
    return has(t, "highway", "cycleway") & has(t, "bicycle", "designated")


def is_bike_road(t, back):
    return has(t, "bicycle_road", "yes")


def _road(kind: str) -> Predicate:
    return lambda t, back: has(t, "highway", kind)


is_primary_road, is_secondary_road, is_tertiary_road, is_residential_road = map(_road, ("primary", "secondary", "tertiary", "residential"))
is_pedestrian_zone = _road("pedestrian")


def is_bikeable_pedestrian_street(t, back):
    return has(t, "highway", "pedestrian") & has(t, "bicycle", "yes")


def dismount_required(t, back):
    return has(t, "bicycle", "dismount")


def is_shared_bike_and_footpath(t, back):
    return has(t, "foot", "designated") & has(t, "bicycle", "yes")


def is_segregated_bike_and_footpath(t, back):
    return is_shared_bike_and_footpath(t, back) & has(t, "segregated", "yes")


def is_not_segregated_bike_and_footpath(t, back):
    return is_shared_bike_and_footpath(t, back) & has(t, "segregated", "no")


def is_bikeable_sidewalk(t, back):
    both = (has(t, "foot", "designated") | has(t, "sidewalk:both:foot", "designated")) & (has(t, "bicycle", "yes") | has(t, "sidewalk:both:bicycle", "yes"))
    right = ~back & has(t, "sidewalk:right:foot", "designated") & has(t, "sidewalk:right:bicycle", "yes")
    left = back & has(t, "sidewalk:left:foot", "designated") & has(t, "sidewalk:left:bicycle", "yes")
    return both | right | left


def _main(t):
    return has(t, "highway", "primary", "secondary", "tertiary", "unclassified")


def is_large_road(t, back):
    return _main(t) & ((lanes(t, LANES[0], 1) >= 2) | (lanes(t, LANES[1], 1) >= 2) | (lanes(t, LANES[2], 1) >= 2))


def is_medium_road(t, back):
    """A missing lane count is 5 here: all three must be given and below 2."""
    return _main(t) & (lanes(t, LANES[0], 5) < 2) & (lanes(t, LANES[1], 5) < 2) & (lanes(t, LANES[2], 5) < 2)


def _with(road: Predicate, infra: Predicate) -> Predicate:
    return lambda t, back: road(t, back) & infra(t, back)


def _without(road: Predicate, *infra: Predicate) -> Predicate:
    def test(t, back):
        out = road(t, back)
        for i in infra:
            out = out & ~i(t, back)
        return out

    return test


large_road_with_bike_track, large_road_with_bike_lane = _with(is_large_road, has_bike_track), _with(is_large_road, has_bike_lane)
large_road_no_bike_infra = _without(is_large_road, has_bike_track, has_bike_lane)
medium_road_with_bike_track, medium_road_with_bike_lane = _with(is_medium_road, has_bike_track), _with(is_medium_road, has_bike_lane)
medium_road_no_bike_infra = _without(is_medium_road, has_bike_track, has_bike_lane)
residential_road_with_bike_track = _with(is_residential_road, has_bike_track)
residential_road_with_bike_lane = _with(is_residential_road, lambda t, back: has_bike_lane(t, back) | is_bike_road(t, back))
residential_road_no_bike_infra = _without(is_residential_road, has_bike_track, has_bike_lane, is_bike_road)


def is_shared_path(t, back):
    return has(t, "bicycle", "designated") & has(t, "foot", "designated")


def is_wrong_way(t, back):
    return back & has(t, "oneway", "yes")


def has_gravel(t, back):
    return has(t, "surface", "gravel")


def has_cobblestone(t, back):
    return has(t, "surface", "cobblestone", "unhewn_cobblestone", "sett")


def is_cycleway(t, back):
    return has(t, "highway", "cycleway") | (has(t, "bicycle", "designated") & ~has(t, "foot", "designated"))


def is_footway(t, back):
    return has(t, "highway", "footway") | (has(t, "foot", "designated") & ~has(t, "bicycle", "designated"))


# The cost models (name, predicate, coefficient).
MODEL_1 = [
    ("has_bike_lane", has_bike_lane, -0.16),
    ("has_bike_path", has_bike_path, -0.16),
    ("has_exclusive_bike_path", has_exclusive_bike_path, -0.16),
    ("has_bike_track", has_bike_track, -0.16),
    ("is_bike_road", is_bike_road, -0.10),
    ("is_primary_road", is_primary_road, 7.15),
    ("is_secondary_road", is_secondary_road, 1.00),
    ("is_tertiary_road", is_tertiary_road, 0.37),
    ("is_residential_road", is_residential_road, 0.10),
    ("is_bikeable_pedestrian_street", is_bikeable_pedestrian_street, 0.20),
    ("dismount_required", dismount_required, 0.40),
    ("is_segregated_bike_and_footpath", is_segregated_bike_and_footpath, 0.10),
    ("is_not_segregated_bike_and_footpath", is_not_segregated_bike_and_footpath, 0.20),
    ("is_bikeable_sidewalk", is_bikeable_sidewalk, 0.30),
]
MODEL_2 = [
    ("medium_road_with_bike_track", medium_road_with_bike_track, 0.0),
    ("medium_road_with_bike_lane", medium_road_with_bike_lane, 0.050),
    ("medium_road_no_bike_infra", medium_road_no_bike_infra, 0.113),
    ("large_road_with_bike_track", large_road_with_bike_track, -0.016),
    ("large_road_with_bike_lane", large_road_with_bike_lane, 0.289),
    ("large_road_no_bike_infra", large_road_no_bike_infra, 0.230),
    ("residential_road_with_bike_track", residential_road_with_bike_track, 0.090),
    ("residential_road_with_bike_lane", residential_road_with_bike_lane, -0.085),
    ("residential_road_no_bike_infra", residential_road_no_bike_infra, 0.174),
    ("is_shared_path", is_shared_path, 0.156),
    ("is_wrong_way", is_wrong_way, 0.506),
    ("has_gravel", has_gravel, 0.130),
    ("has_cobblestone", has_cobblestone, 0.271),
    ("is_pedestrian_zone", is_pedestrian_zone, 0.368),
    ("is_cycleway", is_cycleway, -0.038),
    ("is_footway", is_footway, 0.506),
]
MODEL_MIXED = MODEL_1
METRES_PER_MILE = 1609.34


def slope_penalty(slope: Column) -> Column:
    return F.when(slope < 2, 0.0).when(slope < 4, 0.371).when(slope < 6, 1.203).otherwise(3.239)


def penalty(tags: Column, back: Column, slope: Column, model=MODEL_1) -> Column:
    """1 and the slope's penalty (if known) and the coefficients of all predicates that hold."""
    out = F.lit(1.0) + F.when(slope.isNull(), 0.0).otherwise(slope_penalty(slope))
    for _, predicate, coefficient in model:
        out = out + F.when(predicate(tags, back), F.lit(float(coefficient))).otherwise(0.0)
    return out


def applied(tags: Column, back: Column, model=MODEL_1) -> Column:
    """Names of the predicates that hold."""
    return F.array_compact(F.array(*[F.when(p(tags, back), F.lit(name)) for name, p, _ in model]))


def counted(rows: DataFrame, tags: str, back: str, model=MODEL_1) -> DataFrame:
    """name, n: how many rows each predicate holds for, without those that hold for none.

    Values of the tags that predicates ask for are looked up once a row; sums per predicate are one row a task.
    """
    asked = Asked()
    tests = [(name, p(asked, F.col(back))) for name, p, _ in model]
    looked = rows.select(F.col(back), *[F.try_element_at(tags, F.lit(key)).alias(c) for key, c in asked.columns.items()])
    # counted within the aggregation, predicates are compiled one by one
    sums = looked.agg(*[F.count(F.when(test, 1)).alias(name) for name, test in tests])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name, _ in tests]))).where("n > 0")


def street_class(tags: Column) -> Column:
    """1 primary to 4 residential, 5 others, by what the highway tag contains."""
    highway = F.coalesce(tag(tags, "highway"), F.lit(""))
    out = F
    for rank, kind in enumerate(("primary", "secondary", "tertiary", "residential"), 1):
        out = out.when(F.contains(highway, F.lit(kind)), rank)
    return out.otherwise(5)


def turn_penalty(direction: Column, into: Column, out_of: Column) -> Column:
    """Metres that a turn costs, by direction and the classes of the street entered and left."""
    miles = lambda x: F.lit(METRES_PER_MILE * x)
    left, right = direction == "left", direction == "right"
    return (
        F.when((direction == "straight") & (out_of > into), miles(0.042)).when(direction == "straight", F.lit(0.00001))
        .when((into == 1) & left, miles(0.231)).when((into == 1) & right, miles(0.322))
        .when((into == 2) & left, miles(0.091)).when((into == 2) & right, miles(0.059))
        .when((into == 3) & left, miles(0.091)).when((into == 3) & right, miles(0.038)).otherwise(miles(0.042))
    )


def matches(tags: Column, key: str, pattern: str) -> Column:
    """Filter [key~pattern]: the key is there and its value matches."""
    return F.coalesce(tag(tags, key).rlike(pattern), F.lit(False))


def not_matches(tags: Column, key: str, pattern: str) -> Column:
    """Filter [key!~pattern]: also holds where the key is missing."""
    return ~matches(tags, key, pattern)
