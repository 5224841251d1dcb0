"""Raster files of many forms, clipping, and sums over polygons."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheelwork.functions import shapes as H
from wheelwork.operators import rasters as O
from wheelwork.sources import rasters as R


def lzw(data: bytes) -> bytes:
    out, bits, n = bytearray(), 0, 0
    table = {bytes([i]): i for i in range(256)}

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)

    width, word = 9, b""
    put(256, 9)
    for i in range(len(data)):
        if word + data[i : i + 1] in table:
            word += data[i : i + 1]
            continue
        put(table[word], width)
        table[word + data[i : i + 1]] = len(table) + 2
        word = data[i : i + 1]
        width = 12 if len(table) + 2 > 2047 else 11 if len(table) + 2 > 1023 else 10 if len(table) + 2 > 511 else 9
        if len(table) + 2 >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
    put(table[word], width)
    put(257, width)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def plain_file(values, order="<", compression=1, predictor=1, strips=None, big=False, planar=1, kind="H"):
    """A file of whole rows; ``values`` is (bands, height, width)."""
    bands, h, w = values.shape
    rows = strips or h
    dtype = np.dtype(f"{order}{ {'H': 'u2', 'f': 'f4', 'd': 'f8', 'h': 'i2'}[kind]}")
    parts = []
    for group in ([values] if planar == 1 else [values[i : i + 1] for i in range(bands)]):
        for r in range(0, h, rows):
            block = group[:, r : r + rows].transpose(1, 2, 0).astype(dtype.newbyteorder("="))
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            data = block.astype(dtype).tobytes()
            if predictor == 3:
                n, c = block.shape[0], block.shape[2]
                raw = np.frombuffer(block.astype(dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(n, -1, dtype.itemsize).transpose(0, 2, 1).reshape(n, -1, c)
                data = np.diff(raw, axis=1, prepend=np.zeros_like(raw[:, :1])).tobytes()
            parts.append({1: lambda x: x, 5: lzw, 8: zlib.compress}[compression](data))
    word, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    bits = dtype.itemsize * 8
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * bands), (259, 3, [compression]), (273, 4, None), (277, 3, [bands]), (278, 3, [rows]), (279, 4, [len(p) for p in parts]),
            (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [{"H": 1, "h": 2}.get(kind, 3)]), (34264, 12, [0.5, 0, 0, 100.0, 0, -0.25, 0, 50.0, 0, 0, 0, 0, 0, 0, 0, 1.0])]
    start = (16 if big else 8) + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    extra, table = b"", b""
    sizes = {3: 2, 4: 4, 12: 8}
    n_extra = sum(s for s in (sizes[c] * (len(v) if v is not None else len(parts)) for _, c, v in tags) if s > inline)
    places = [start + n_extra + sum(map(len, parts[:i])) for i in range(len(parts))]
    for tag, code, v in tags:
        v = places if v is None else v
        data = struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[code]}", *v)
        table += struct.pack(f"{order}HH{word}", tag, code, len(v)) + (data.ljust(inline, b"\0") if len(data) <= inline else struct.pack(f"{order}{word}", start + len(extra)))
        extra += data if len(data) > inline else b""
    mark = b"II" if order == "<" else b"MM"
    head = struct.pack(f"{order}HHHQQ", 43, 8, 0, 16, len(tags)) if big else struct.pack(f"{order}HIH", 42, 8, len(tags))
    return mark + head + table + struct.pack(f"{order}{word}", 0) + extra + b"".join(parts)


FORMS = [
    {}, {"order": ">"}, {"strips": 3}, {"compression": 5, "strips": 4}, {"compression": 8, "predictor": 2, "order": ">"}, {"big": True, "compression": 8},
    {"kind": "f", "compression": 8, "predictor": 3, "strips": 5}, {"kind": "d", "predictor": 3, "order": ">"}, {"planar": 2, "strips": 4}, {"kind": "h", "predictor": 2, "compression": 5},
]


@pytest.mark.parametrize("form", FORMS)
def test_forms(spark, tmp_path, form):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3000, (3, 11, 70)).astype(float)
    path = tmp_path / "r.tif"
    path.write_bytes(plain_file(values, **form))
    rows = R.cells(R.tiles(spark, [str(path)])).collect()
    got = np.full((11, 70), np.nan)
    for r in rows:
        got[r["row"], r["col"]] = r["value"]
        assert (r["x0"], r["y1"]) == (100 + r["col"] * 0.5, 50 - r["row"] * 0.25)
    assert (got == values[0]).all()


def test_not_a_raster(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"PK" + bytes(100))
    with pytest.raises(Exception, match="not a TIFF"):
        R.tiles(spark, [str(tmp_path / "x.tif")]).collect()


def polygon(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def test_zonal_sums_of_concave_zones_with_holes(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = {(c, r): float(rng.integers(1, 50)) for c in range(-7, 9) for r in range(-6, 8) if rng.random() < 0.8}
    raster = spark.createDataFrame([(c, r, v) for (c, r), v in cells.items()], "col long, row long, value double")
    files = R.write_sheets(raster, f"file://{tmp_path}/s", 2.0, 2.0, side=6, tile=4)
    assert sum(r["n"] for r in files.collect()) == len(cells)
    tiles = R.tiles(spark, [r["path"] for r in files.collect()])
    # an L of two boxes, a box with a hole, one beside all, one without rings
    boxes = {"L": [(-9.5, -7, 3.25, -2.5, 1), (-9.5, -2.5, -4, 9.1, 1)], "hole": [(-3, -3, 8, 8, 1), (0.5, 0.7, 4.5, 6.9, -1)]}
    zones = spark.createDataFrame(
        [("L", polygon([(-9.5, -7), (3.25, -7), (3.25, -2.5), (-4, -2.5), (-4, 9.1), (-9.5, 9.1)])), ("hole", polygon([(-3, -3), (8, -3), (8, 8), (-3, 8)], [(0.5, 0.7), (0.5, 6.9), (4.5, 6.9), (4.5, 0.7)])),
         ("far", polygon([(900, 900), (901, 900), (900, 901)])), ("none", None)], f"zone string, rings array<{H.RING}>")
    got = {r["zone"]: r["total"] for r in O.zonal_sums(tiles, zones).collect()}
    share = lambda c, r, b: max(0, min(b[2], 2 * c + 2) - max(b[0], 2 * c)) * max(0, min(b[3], 2 * r + 2) - max(b[1], 2 * r)) / 4 * b[4]
    for zone, parts in boxes.items():
        assert got[zone] == pytest.approx(sum(v * share(c, r, b) for (c, r), v in cells.items() for b in parts))
    assert got["far"] is None and got["none"] is None
    spots = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-18, 20, (60, 2)))] + [(99, None, 1.0), (98, -2.0, 4.0)], "id long, x double, y double")
    for r in O.values_at(tiles, spots).collect():
        assert r["value"] == (None if r["x"] is None else cells.get((r["x"] // 2, r["y"] // 2)))


def test_clipping(spark):
    rng = np.random.default_rng(7)
    star = [(np.cos(t) * s, np.sin(t) * s) for t, s in zip(np.linspace(0, 6.2, 15), rng.uniform(0.3, 2, 15), strict=False)]
    df = spark.createDataFrame([(polygon(star)[0],)], f"ring {H.RING}")
    grid = df.select("ring", F.explode(F.sequence(F.lit(-4), F.lit(3))).alias("i")).select("ring", "i", F.explode(F.sequence(F.lit(-4), F.lit(3))).alias("j"))
    part = H.clipped_ring(F.col("ring"), F.col("i") * 0.6, F.col("j") * 0.6, F.col("i") * 0.6 + 0.6, F.col("j") * 0.6 + 0.6)
    total = grid.agg(F.sum(H.ring_area(part)).alias("s"), F.max(H.ring_area(F.col("ring"))).alias("a")).first()
    assert total["s"] == pytest.approx(total["a"])
    square, turned = polygon([(0, 0), (2, 0), (2, 2), (0, 2)])[0], polygon([(1, -1), (3, 1), (1, 3), (-1, 1)])[0]
    both = spark.createDataFrame([(square, turned, [])], f"a {H.RING}, b {H.RING}, c {H.RING}")
    got = both.select(H.ring_area(H.clipped_by_convex(F.col("a"), F.col("b"))).alias("ab"), H.ring_area(H.clipped_by_convex(F.col("b"), F.col("a"))).alias("ba"), H.ring_area(F.col("c")).alias("none"), H.ring_area(H.clipped_by_convex(F.col("c"), F.col("a"))).alias("empty")).first()
    assert tuple(got) == (4.0, 4.0, 0.0, 0.0)
