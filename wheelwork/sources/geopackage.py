"""Layers of GeoPackage files: rows by ranges of their numbers, geometries as well-known binary.

A layer is written as one file a partition, each a whole GeoPackage with that layer, made in
the task's own folder and then moved to its place in the shared one. Reading deals ranges of row
numbers over the cluster; files that tasks cannot open as local paths are fetched by the task and
are one range each.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelwork.operators.lineage import uri

ROWS = 50_000
# fixed values of the format
APPLICATION, VERSION, ENVELOPES = 0x47504B47, 10300, (0, 32, 48, 48, 64)
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}
TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""
_STORED = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
_READ = {"BOOLEAN": "boolean", "INTEGER": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Opened:
    """A database of a file, read only; fetched into the task's own folder where it is not a local path."""

    def __init__(self, path: str):
        from pyarrow.fs import FileSystem, LocalFileSystem

        fs, where = FileSystem.from_uri(path)
        self.own = None
        if not isinstance(fs, LocalFileSystem):
            handle, self.own = tempfile.mkstemp(suffix=".gpkg")
            with os.fdopen(handle, "wb") as out, fs.open_input_stream(where) as data:
                while chunk := data.read(4 << 20):
                    out.write(chunk)
            where = self.own
        self.db = sqlite3.connect(f"file:{where}?mode=ro&immutable=1", uri=True)

    def __enter__(self):
        return self.db

    def __exit__(self, *_):
        self.db.close()
        if self.own:
            os.remove(self.own)


def _facts(db, layer: str):
    """Geometry column, columns but the feature number with their stored kinds, least and greatest row number of a layer."""
    shape = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
    columns = [(r[1], r[2].upper().split("(")[0]) for r in db.execute(f"PRAGMA table_info({_q(layer)})") if not r[5]]
    lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_q(layer)}").fetchone()
    return shape[0] if shape else None, columns, lo, hi


def layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, layer of files."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Opened(path) as db:
                    names = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents ORDER BY 1")]
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(names), pa.string()), "layer": pa.array(names, pa.string())})

    return spark.createDataFrame([(uri(spark, p),) for p in paths], "path string").mapInArrow(run, "path string, layer string")


def read(spark: SparkSession, paths: list[str], layer: str, rows: int = ROWS) -> DataFrame:
    """The rows of a layer of files with equal columns; the geometry is well-known binary under its own name."""
    full = [uri(spark, p) for p in paths]

    def facts(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Opened(path) as db:
                    shape, columns, lo, hi = _facts(db, layer)
                local = path.startswith("file:")
                yield pa.RecordBatch.from_pylist([{"path": path, "shape": shape, "names": [c for c, _ in columns], "kinds": [k for _, k in columns], "lo": lo, "hi": hi, "local": local}])

    known = spark.createDataFrame([(p,) for p in full], "path string").repartition(max(1, min(len(full), 10_000))).mapInArrow(facts, "path string, shape string, names array<string>, kinds array<string>, lo bigint, hi bigint, local boolean")
    found = known.collect()
    if not found:
        raise ValueError("no files")
    shape, names, kinds = found[0]["shape"], found[0]["names"], found[0]["kinds"]
    types = ["binary" if n == shape else _READ.get(k, "string") for n, k in zip(names, kinds, strict=True)]
    ranges = [(r["path"], lo, min(lo + rows - 1, r["hi"]) if r["local"] else r["hi"]) for r in found if r["lo"] is not None for lo in (range(r["lo"], r["hi"] + 1, rows) if r["local"] else [r["lo"]])]
    arrow = {"binary": pa.binary(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    select = f"SELECT {', '.join(map(_q, names))} FROM {_q(layer)} WHERE rowid BETWEEN ? AND ?"

    def value(x, kind):
        if x is None or kind == "binary":
            return x
        return {"bigint": int, "double": float, "boolean": bool, "string": str}[kind](x)

    def run(batches):
        for batch in batches:
            for path, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi")), strict=True):
                with Opened(path) as db:
                    cursor = db.execute(select, (lo, hi))
                    while got := cursor.fetchmany(5000):
                        columns = list(zip(*got, strict=True))
                        arrays = [pa.array([bare(x) for x in c] if n == shape else [value(x, k) for x in c], arrow[k]) for n, k, c in zip(names, types, columns, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, names)

    spread = spark.createDataFrame(ranges, "path string, lo bigint, hi bigint").repartition(max(1, min(len(ranges), 10_000)), "path", "lo")
    return spread.mapInArrow(run, ", ".join(f"{'`' + n.replace('`', '``') + '`'} {k}" for n, k in zip(names, types, strict=True)))


def bare(blob: bytes | None) -> bytes | None:
    """The well-known binary inside a stored geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + ENVELOPES[blob[3] >> 1 & 7] :]


def write(df: DataFrame, folder: str, layer: str, kind: int, shape: str = "geom", srs: int = 4326) -> DataFrame:
    """``df`` as files with one layer; column ``shape`` is well-known binary of ``kind`` (``functions.wkb``).

    Returns path, n of the files, one a partition that has rows. Arrays and other nested columns stand as JSON.
    """
    spark = df.sparkSession
    folder = uri(spark, folder)
    flat = df.select(*[F.to_json(f"`{c}`").alias(c) if k.startswith(("array", "struct", "map")) else F.col(f"`{c}`") if k in _STORED else F.col(f"`{c}`").cast("string").alias(c) for c, k in df.dtypes])
    names = flat.columns
    stored = [KINDS[kind] if n == shape else _STORED[k] for n, k in flat.dtypes]
    at = names.index(shape)

    def save(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        name, n, db, own = f"{layer}-{TaskContext.get().partitionId():05d}.gpkg", 0, None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if db is None:
                    handle, own = tempfile.mkstemp(suffix=".gpkg")
                    os.close(handle)
                    db = _begun(own, layer, names, stored, shape, kind, srs)
                rows = [list(r.values()) for r in batch.to_pylist()]
                for r in rows:
                    r[at] = None if r[at] is None else b"GP\0\1" + struct.pack("<i", srs) + r[at]
                db.executemany(f"INSERT INTO {_q(layer)} ({', '.join(map(_q, names))}) VALUES ({', '.join('?' * len(names))})", rows)
                n += len(rows)
            if db is not None:
                db.commit()
                db.close()
                fs, top = FileSystem.from_uri(folder)
                fs.create_dir(top, recursive=True)
                hidden = f"{top}/.{name}.{uuid.uuid4().hex}"
                with open(own, "rb") as data, fs.open_output_stream(hidden) as out:
                    while chunk := data.read(4 << 20):
                        out.write(chunk)
                fs.move(hidden, f"{top}/{name}")
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": pa.array([n], pa.int64())})
        finally:
            if own:
                os.remove(own)

    return flat.mapInArrow(save, "path string, n bigint")


def _begun(path: str, layer: str, names, stored, shape: str, kind: int, srs: int):
    db = sqlite3.connect(path)
    db.executescript(f"PRAGMA application_id = {APPLICATION}; PRAGMA user_version = {VERSION};" + TABLES)
    systems = [("Undefined cartesian", -1, "NONE", -1, "undefined", None), ("Undefined geographic", 0, "NONE", 0, "undefined", None), (f"EPSG:{srs}", srs, "EPSG", srs, "undefined", None)]
    db.executemany("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", systems)
    number = "fid"
    while number in {n.lower() for n in names}:
        number += "_"
    db.execute(f"CREATE TABLE {_q(layer)} ({_q(number)} INTEGER PRIMARY KEY AUTOINCREMENT, {', '.join(f'{_q(n)} {k}' for n, k in zip(names, stored, strict=True))})")
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, last_change, srs_id) VALUES (?, 'features', ?, '1970-01-01T00:00:00.000Z', ?)", (layer, layer, srs))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, 0, 0)", (layer, shape, KINDS[kind], srs))
    return db
