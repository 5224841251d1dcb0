"""Raster files: the first band of GeoTIFF files, tile by tile, and a writer of map sheets.

Headers are read by ranges, never whole files, and give one row a tile or strip; the tiles
that are wanted are then dealt over the cluster and read one by one. Classic and big files
of either byte order, in strips or tiles, chunky or planar, uncompressed, LZW, deflate or zstd
with predictors 1 to 3 are read; other forms are an error that names them.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelwork.operators.lineage import uri

TILES = """path string, tile int, col bigint, row bigint, width int, height int, held_width int, held_height int, offset bigint, n_bytes bigint,
dtype string, bands int, compression int, predictor int, nodata double, left double, top double, dx double, dy double"""
CELLS = "path string, tile int, col bigint, row bigint, x0 double, y0 double, x1 double, y1 double, value double"
# fixed values of the format: tags, sizes and struct codes of field types, sample kinds
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, KIND, SCALE, TIEPOINT, MATRIX, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
KINDS = {1: "u", 2: "i", 3: "f"}


def _opened(path: str):
    from pyarrow.fs import FileSystem

    fs, where = FileSystem.from_uri(path)
    return fs.open_input_file(where)


def fields(file) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a file's first image."""
    def at(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    head = at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = kind == 43
    first = struct.unpack(f"{order}Q", head[8:16])[0] if wide else struct.unpack(f"{order}I", head[4:8])[0]
    n_bytes, entry, inline, word = (8, 20, 8, "Q") if wide else (2, 12, 4, "I")
    n = struct.unpack(f"{order}{'Q' if wide else 'H'}", at(first, n_bytes))[0]
    table, tags = at(first + n_bytes, n * entry), {}
    for i in range(0, n * entry, entry):
        tag, code = struct.unpack(f"{order}HH", table[i : i + 4])
        count = struct.unpack(f"{order}{word}", table[i + 4 : i + 4 + inline])[0]
        if code not in FIELDS:
            continue
        size, letter = FIELDS[code]
        data = table[i + 4 + inline : i + entry]
        if size * count > inline:
            data = at(struct.unpack(f"{order}{word}", data)[0], size * count)
        tags[tag] = (data[:count],) if letter == "s" else struct.unpack(f"{order}{letter * count}", data[: size * count])
    return order, tags


def header(path: str) -> list[tuple]:
    """Rows of ``TILES`` of one file."""
    with _opened(path) as file:
        order, tags = fields(file)
    one = lambda tag, other=None: tags.get(tag, (other,))[0]
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    tiled = TILE_WIDTH in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    across, down = -(-width // w), -(-height // h)
    if MATRIX in tags:
        m = tags[MATRIX]
        if m[1] or m[4]:
            raise ValueError(f"{path} is turned against the axes")
        left, top, dx, dy = m[3], m[7], m[0], -m[5]
    else:
        (dx, dy), tie = tags.get(SCALE, (1.0, 1.0))[:2], tags.get(TIEPOINT, (0.0,) * 6)
        left, top = tie[3] - tie[0] * dx, tie[4] + tie[1] * dy
    none = one(NODATA)
    none = float(none.rstrip(b"\0 ").decode()) if none is not None else None
    kind = f"{order}{KINDS[one(KIND, 1)]}{one(BITS, 1) // 8}"
    # planar files hold the first band's tiles first
    chunky = bands if one(PLANAR, 1) == 1 else 1
    rows = []
    for i in range(across * down):
        c, r = i % across * w, i // across * h
        # a strip at the end is shorter, a tile is held whole
        rows.append((path, i, c, r, min(w, width - c), min(h, height - r), w, h if tiled else min(h, height - r), offsets[i], sizes[i], kind, chunky, one(COMPRESSION, 1), one(PREDICTOR, 1), none, left, top, dx, dy))
    return rows


def unpacked_lzw(data: bytes) -> bytes:
    """The format's LZW: codes of 9 to 12 bits, first bit first, a bit more one code early."""
    out, table, width, bits, n_bits, before = bytearray(), [], 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, n_bits = bits << 8 | byte, n_bits + 8
        if n_bits < width:
            continue
        n_bits -= width
        code, bits = bits >> n_bits, bits & ((1 << n_bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = base[:], 9, b""
            continue
        table = table or base[:]
        word = table[code] if code < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def decoded(data: bytes, t: dict) -> np.ndarray:
    """Values of a tile's first band as a matrix of its visible part."""
    if t["compression"] == 5:
        data = unpacked_lzw(data)
    elif t["compression"] in (8, 32946):
        data = zlib.decompress(data)
    elif t["compression"] == 50000:
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif t["compression"] != 1:
        raise ValueError(f"compression {t['compression']} of {t['path']}")
    kind, w, h, bands = np.dtype(t["dtype"]), t["held_width"], t["held_height"], t["bands"]
    if t["predictor"] == 3:
        # bytes of a row lie by significance, the highest first, each less the one before
        raw = np.frombuffer(data, np.uint8, w * h * bands * kind.itemsize).reshape(h, w * kind.itemsize, bands)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * bands)
        values = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(h, w, bands)
    else:
        values = np.frombuffer(data, kind, w * h * bands).reshape(h, w, bands)
        if t["predictor"] == 2:
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
        elif t["predictor"] != 1:
            raise ValueError(f"predictor {t['predictor']} of {t['path']}")
    return values[: t["height"], : t["width"], 0].astype(np.float64)


def tiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a tile of the files, from their headers; ``paths`` are files that tasks can open."""
    full = [uri(spark, p) for p in paths]
    names = [x.split()[0] for x in TILES.replace("\n", " ").split(", ")]

    def heads(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = header(path)
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow(TILES))

    found = spark.createDataFrame([(p,) for p in full], "path string").repartition(max(1, min(len(full), 10_000)))
    return found.mapInArrow(heads, TILES)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.replace("\n", " ").split(", "))])


def cells(chosen: DataFrame) -> DataFrame:
    """The cells of tiles with their place in the file and their box; cells without data are left out."""
    def read(batches):
        for batch in batches:
            for t in batch.to_pylist():
                with _opened(t["path"]) as file:
                    file.seek(t["offset"])
                    values = decoded(file.read(t["n_bytes"]), t)
                known = np.isfinite(values) if t["nodata"] is None else np.isfinite(values) & (values != t["nodata"])
                r, c = np.nonzero(known)
                col, row = c + t["col"], r + t["row"]
                columns = [t["left"] + col * t["dx"], t["top"] - (row + 1) * t["dy"], t["left"] + (col + 1) * t["dx"], t["top"] - row * t["dy"], values[r, c]]
                arrays = [pa.array([t["path"]] * len(r), pa.string()), pa.array(np.full(len(r), t["tile"], np.int32)), pa.array(col), pa.array(row), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_arrow(CELLS))

    return chosen.repartition(F.col("path"), F.col("tile")).mapInArrow(read, CELLS)


def sheet(values: np.ndarray, left: float, top: float, dx: float, dy: float, nodata: float, tile: int) -> bytes:
    """A matrix (north up) as a file of deflated tiles."""
    h, w = values.shape
    across, down = -(-w // tile), -(-h // tile)
    held = np.full((down * tile, across * tile), nodata)
    held[:h, :w] = values
    parts = [zlib.compress(np.ascontiguousarray(held[r : r + tile, c : c + tile]).astype("<f8").tobytes()) for r in range(0, down * tile, tile) for c in range(0, across * tile, tile)]
    none = repr(float(nodata)).encode() + b"\0"
    tags = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (262, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]),
        (TILE_AT, 4, [0] * len(parts)), (TILE_SIZE, 4, [len(p) for p in parts]), (KIND, 3, [3]), (SCALE, 12, [dx, dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (NODATA, 2, none),
    ]
    sizes = [FIELDS[code][0] * len(v) for _, code, v in tags]
    free = 8 + 2 + 12 * len(tags) + 4
    at = free + sum(s for s in sizes if s > 4)
    places = [at + sum(map(len, parts[:i])) for i in range(len(parts))]
    table, rest = struct.pack("<H", len(tags)), b""
    for (tag, code, v), size in zip(tags, sizes, strict=True):
        v = places if tag == TILE_AT else v
        data = v if code == 2 else struct.pack(f"<{len(v)}{FIELDS[code][1]}", *v)
        table += struct.pack("<HHI", tag, code, len(v)) + (data.ljust(4, b"\0") if size <= 4 else struct.pack("<I", free + len(rest)))
        rest += data if size > 4 else b""
    return b"II" + struct.pack("<HI", 42, 8) + table + struct.pack("<I", 0) + rest + b"".join(parts)


def write_sheets(raster: DataFrame, folder: str, dx: float, dy: float, side: int = 2048, tile: int = 256, nodata: float = -9999.0) -> DataFrame:
    """Cells (col, row, value; cell [col*dx, (col+1)*dx) and so on upwards) as map sheets of ``side`` by ``side`` cells.

    One file a sheet that has cells, written under a temporary name and moved into place.
    Returns path, n (cells) of the files. Of cells that stand twice the greatest value stays.
    """
    spark = raster.sparkSession
    folder = uri(spark, folder)

    def write(table: pa.Table) -> pa.Table:
        from pyarrow.fs import FileSystem

        cols, rows, values = (table.column(c).to_numpy() for c in ("col", "row", "value"))
        x, y = int(cols[0] // side), int(rows[0] // side)
        grid = np.full((side, side), nodata)
        grid[side - 1 - (rows - y * side), cols - x * side] = values
        name = f"sheet_{x}_{y}.tif"
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        hidden = f"{top}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden) as out:
            out.write(sheet(grid, x * side * dx, (y + 1) * side * dy, dx, dy, nodata, tile))
        fs.move(hidden, f"{top}/{name}")
        return pa.table({"path": [f"{folder}/{name}"], "n": pa.array([len(cols)], pa.int64())})

    one = raster.where("value IS NOT NULL").groupBy("col", "row").agg(F.max(F.col("value").cast("double")).alias("value"))
    place = lambda c: F.floor(F.col(c) / side).cast("bigint")
    return one.withColumn("_x", place("col")).withColumn("_y", place("row")).groupBy("_x", "_y").applyInArrow(lambda t: write(t.select(["col", "row", "value"])), "path string, n bigint")
