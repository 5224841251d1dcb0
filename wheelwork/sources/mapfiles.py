"""Map files (nodes, ways and relations in blocks of protocol buffers) as a partitioned source, and their writer.

``register(spark)`` adds the format ``mapfile``; ``nodes``, ``ways`` and ``relations`` read with it. A
partition is a range of bytes of a file: its task looks for the first block that begins in
the range and decodes blocks up to the range's end, so nothing is read twice and the driver
only lists files. Options: ``kind`` (nodes, ways, relations), ``tagged`` (only with tags), ``keys``
(only with one of these tag keys, by comma), ``tag`` (only with this ``key=value``),
``columns`` (those to decode, by comma), ``range_bytes``. Blocks without a wanted key in their string
table are skipped undecoded. Blocks may be raw, zlib or zstd; others are an error.

History files have several versions of one identifier; ``as_of`` takes those of a day.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wheelwork.operators.lineage import uri

_TAGS, _ABOUT = {"tags": T.MapType(T.StringType(), T.StringType())}, {"version": T.IntegerType(), "time": T.TimestampType(), "visible": T.BooleanType()}
_MEMBER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())])
#: Columns by kind; the worker that asks for them has no session to parse text with.
COLUMNS = {
    "nodes": {"id": T.LongType(), "lon": T.DoubleType(), "lat": T.DoubleType(), **_TAGS, **_ABOUT},
    "ways": {"id": T.LongType(), **_TAGS, "nodes": T.ArrayType(T.LongType()), **_ABOUT},
    "relations": {"id": T.LongType(), **_TAGS, "members": T.ArrayType(_MEMBER), **_ABOUT},
}
RANGE_BYTES = 64 << 20
#: Tasks from which on ranges below that size share one.
TASKS = 1000
#: Longest block of the format, and elements of a block that the writer makes.
MOST_BYTES, BLOCK_ROWS = 32 << 20, 8000
MEMBER_KINDS = ("node", "way", "relation")
_FIRST = b"\x0a\x07OSMData"
_ONE = [bytes([n]) for n in range(128)]


def varints(data: bytes) -> np.ndarray:
    """All whole numbers of a packed field."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    length, out = ends - begins + 1, np.zeros(len(ends), np.uint64)
    for k in range(int(length.max(initial=0))):
        some = length > k
        out[some] |= (b[begins[some] + k] & np.uint64(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def signed(values):
    """Numbers whose last bit is the sign."""
    return (values >> 1) ^ -(values & 1)


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a message in order: number and value (bytes where it has a length)."""
    at, end = 0, len(data)
    while at < end:
        key = data[at]
        key, at = (key, at + 1) if key < 128 else varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = (data[at], at + 1) if data[at] < 128 else varint(data, at)
        elif kind == 2:
            n, at = (data[at], at + 1) if data[at] < 128 else varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("a message of a map file is damaged")
        yield key >> 3, value


def fields(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in message(data):
        if number in out:
            out[number].append(value)
        else:
            out[number] = [value]
    return out


def unpacked(blob: bytes) -> bytes:
    """The content of a block."""
    got = fields(blob)
    if 1 in got:
        return got[1][0]
    if 3 in got:
        return zlib.decompress(got[3][0])
    if 7 in got:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(got[7][0])
    raise ValueError("a block of a map file is packed in an unknown way")


def _header(file, at: int, end: int):
    """(kind, start of the content, its length) of the block at a place, or None."""
    if at + 4 > end:
        return None
    file.seek(at)
    head = file.read(4)
    n = struct.unpack(">I", head)[0]
    if not 0 < n <= 64 << 10 or at + 4 + n > end:
        return None
    try:
        got = fields(file.read(n))
        kind, size = got[1][0], got[3][0]
    except (ValueError, KeyError, IndexError):
        return None
    return (kind, at + 4 + n, size) if 0 <= size <= MOST_BYTES and at + 4 + n + size <= end else None


def blobs(file, begin: int, to: int, end: int) -> Iterator[bytes]:
    """Contents of the data blocks that begin in [begin, to)."""
    at = begin if begin == 0 else _next(file, begin, to, end)
    while at is not None and at < to:
        head = _header(file, at, end)
        if head is None:
            raise ValueError(f"a map file is damaged at byte {at}")
        kind, start, size = head
        if kind == b"OSMData":
            file.seek(start)
            yield unpacked(file.read(size))
        at = start + size


def _next(file, begin: int, to: int, end: int) -> int | None:
    """Where the first block in a range begins: its header's bytes, confirmed by those of the block after it."""
    window = 1 << 20
    for at in range(begin, to, window):
        file.seek(at)
        data = file.read(min(end, to, at + window) - at + 4 + len(_FIRST))
        place = data.find(_FIRST)
        while place != -1:
            start = at + place - 4
            head = _header(file, start, end) if place >= 4 or at > begin else None
            if head and begin <= start < to and (head[1] + head[2] == end or _header(file, head[1] + head[2], end)):
                return start
            place = data.find(_FIRST, place + 1)
    return None


class Wanted:
    """What of a block is kept; as the options of the source say."""

    def __init__(self, options):
        self.kind = options.get("kind", "ways")
        self.tagged = options.get("tagged", "false") == "true"
        self.keys = {k.encode() for k in options.get("keys", "").split(",") if k}
        key, _, value = options.get("tag", "").partition("=")
        self.tag = (key.encode(), value.encode()) if key else None
        self.columns = [c for c in options.get("columns", "").split(",") if c]
        self.schema = T.StructType([T.StructField(name, kind) for name, kind in COLUMNS[self.kind].items() if not self.columns or name in self.columns])
        self.has = {f.name for f in self.schema}

    def somewhere(self, strings: list[bytes]) -> bool:
        """Whether a block with these strings can hold an element that is kept."""
        there = set(strings)
        return (not self.keys or bool(self.keys & there)) and (self.tag is None or (self.tag[0] in there and self.tag[1] in there))

    def keeps(self, tags: dict[bytes, bytes]) -> bool:
        return (not self.tagged or bool(tags)) and (not self.keys or not self.keys.isdisjoint(tags)) and (self.tag is None or tags.get(self.tag[0]) == self.tag[1])


def _tags(strings, got) -> dict[bytes, bytes]:
    keys, values = (varints(b"".join(got.get(i, []))) for i in (2, 3))
    return {strings[k]: strings[v] for k, v in zip(keys, values, strict=True)}


def _about(got, number: int, dates: int) -> dict:
    info = fields(got[number][0]) if number in got else {}
    time = info.get(2, [None])[0]
    return {"version": info.get(1, [None])[0], "time": None if time is None else time * dates, "visible": bool(info.get(6, [1])[0])}


def elements(block: bytes, want: Wanted) -> Iterator[dict]:
    """The kept elements of a block as rows."""
    got = fields(block)
    strings = fields(got[1][0]).get(1, []) if 1 in got else []
    if not want.somewhere(strings):
        return
    step, lat0, lon0, dates = got.get(17, [100])[0], got.get(19, [0])[0], got.get(20, [0])[0], got.get(18, [1000])[0]
    lat0, lon0 = (x - (1 << 64) if x >= 1 << 63 else x for x in (lat0, lon0))
    text = lambda tags: {k.decode(): v.decode() for k, v in tags.items()}
    for group in got.get(2, []):
        for number, data in message(group):
            if want.kind == "nodes" and number == 1:
                x = fields(data)
                tags = _tags(strings, x)
                if want.keeps(tags):
                    lat, lon = (signed(x[i][0]) for i in (8, 9))
                    yield {"id": signed(x[1][0]), "lon": (lon0 + step * lon) / 1e9, "lat": (lat0 + step * lat) / 1e9, "tags": text(tags), **_about(x, 4, dates)}
            elif want.kind == "nodes" and number == 2:
                yield from _dense(data, strings, want, step, lat0, lon0, dates, text)
            elif want.kind == "ways" and number == 3:
                x = fields(data)
                tags = _tags(strings, x)
                if want.keeps(tags):
                    yield {"id": x[1][0], "tags": text(tags), "nodes": np.cumsum(signed(varints(b"".join(x.get(8, []))))).tolist(), **_about(x, 4, dates)}
            elif want.kind == "relations" and number == 4:
                x = fields(data)
                tags = _tags(strings, x)
                if want.keeps(tags):
                    roles, refs, kinds = (varints(b"".join(x.get(i, []))) for i in (8, 9, 10))
                    members = [{"kind": MEMBER_KINDS[k], "ref": r, "role": strings[i].decode()} for i, r, k in zip(roles.tolist(), np.cumsum(signed(refs)).tolist(), kinds.tolist(), strict=True)]
                    yield {"id": x[1][0], "tags": text(tags), "members": members, **_about(x, 4, dates)}


def _dense(data, strings, want, step, lat0, lon0, dates, text) -> Iterator[dict]:
    x = fields(data)
    ids, lats, lons = (np.cumsum(signed(varints(b"".join(x.get(i, []))))) for i in (1, 8, 9))
    spots = varints(b"".join(x.get(10, []))).tolist()
    info = fields(x[5][0]) if 5 in x else {}
    version = varints(b"".join(info.get(1, []))).tolist()
    times = np.cumsum(signed(varints(b"".join(info.get(2, []))))).tolist()
    shown = varints(b"".join(info.get(6, []))).tolist()
    at = 0
    for i, (n, lat, lon) in enumerate(zip(ids.tolist(), ((lat0 + step * lats) / 1e9).tolist(), ((lon0 + step * lons) / 1e9).tolist(), strict=True)):
        tags = {}
        while at < len(spots) and spots[at]:
            tags[strings[spots[at]]] = strings[spots[at + 1]]
            at += 2
        at += 1
        if want.keeps(tags):
            yield {"id": n, "lon": lon, "lat": lat, "tags": text(tags), "version": version[i] if version else None, "time": times[i] * dates if times else None, "visible": bool(shown[i]) if shown else True}


def _packed(found: list[dict], number: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of a packed field of many elements, and where each element's begin and the last one's end."""
    parts = [x[number][0] if len(x.get(number, ())) == 1 else b"".join(x.get(number, ())) for x in found]
    data = b"".join(parts)
    before = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) < 128)])
    return varints(data), before[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences of each element as numbers."""
    sums = np.concatenate([[0], np.cumsum(signed(values))])
    return sums[1:] - np.repeat(sums[at[:-1]], np.diff(at))


def batch(block: bytes, want: Wanted, schema: pa.Schema) -> pa.RecordBatch | None:
    """The kept ways or relations of a block, column by column; None where an element has a key twice (``elements`` reads those)."""
    got = fields(block)
    strings = fields(got[1][0]).get(1, []) if 1 in got else []
    if not want.somewhere(strings):
        return pa.RecordBatch.from_pylist([], schema=schema)
    wanted = 3 if want.kind == "ways" else 4
    found = [fields(data) for group in got.get(2, []) for number, data in message(group) if number == wanted]
    first: dict[bytes, int] = {}
    same = np.array([first.setdefault(x, i) for i, x in enumerate(strings)], np.int64)
    (keys, at), (values, to) = _packed(found, 2), _packed(found, 3)
    if not np.array_equal(at, to):
        raise ValueError("tags of a map file are damaged")
    keys, values, row = same[keys], same[values], np.repeat(np.arange(len(found)), np.diff(at))
    if len(np.unique(row * len(strings) + keys)) < len(keys):
        return None
    keep = np.ones(len(found), bool)
    having = lambda hit: np.bincount(row[hit], minlength=len(found)) > 0
    if want.tagged:
        keep &= np.diff(at) > 0
    if want.keys:
        keep &= having(np.isin(keys, [first[k] for k in want.keys if k in first]))
    if want.tag:
        keep &= having((keys == first[want.tag[0]]) & (values == first[want.tag[1]]))
    columns = {"id": pa.array([x[1][0] for x in found], pa.int64())}
    used = [keys, values]
    if want.kind == "relations":
        (roles, r), (refs, m), (kinds, k) = _packed(found, 8), _packed(found, 9), _packed(found, 10)
        if not (np.array_equal(r, m) and np.array_equal(m, k)):
            raise ValueError("members of a map file are damaged")
        used.append(roles)
    some = set(np.concatenate(used).tolist())
    words = pa.array([x.decode() if i in some else None for i, x in enumerate(strings)], pa.string())
    if "tags" in want.has:
        columns["tags"] = pa.MapArray.from_arrays(pa.array(at, pa.int32()), words.take(pa.array(keys)), words.take(pa.array(values)))
    if "nodes" in want.has:
        refs, m = _packed(found, 8)
        columns["nodes"] = pa.ListArray.from_arrays(pa.array(m, pa.int32()), pa.array(_summed(refs, m)))
    if "members" in want.has:
        member = pa.StructArray.from_arrays([pa.array(MEMBER_KINDS, pa.string()).take(pa.array(kinds)), pa.array(_summed(refs, m)), words.take(pa.array(roles))], ["kind", "ref", "role"])
        columns["members"] = pa.ListArray.from_arrays(pa.array(m, pa.int32()), member)
    if want.has & set(_ABOUT):
        dates = got.get(18, [1000])[0]
        about = [_about(x, 4, dates) for x in found]
        columns["version"], columns["visible"] = ([a[c] for a in about] for c in ("version", "visible"))
        columns["time"] = [None if a["time"] is None else a["time"] * 1000 for a in about]
    made = [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema).filter(pa.array(keep))


class Ranges(InputPartition):
    """Ranges of bytes that one task reads: path, begin, to, and the file's end."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class MapFileReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.want = Wanted(self.options)

    def partitions(self):
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, top = FileSystem.from_uri(self.options["path"])
        info = fs.get_file_info(top)
        found = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(top, recursive=True)) if f.type == FileType.File and f.path.endswith(".pbf") and not f.base_name.startswith(".")]
        step = int(self.options.get("range_bytes", RANGE_BYTES))
        ranges = [(f.path, at, min(at + step, f.size), f.size) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, step)]
        # many small ranges share a task, which then reads no more than one range of the usual size
        each = max(1, min(-(-len(ranges) // TASKS), RANGE_BYTES // step))
        return [Ranges(ranges[i : i + each]) for i in range(0, len(ranges), each)] or [Ranges([])]

    def read(self, part):
        from pyarrow.fs import FileSystem
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = FileSystem.from_uri(self.options["path"])
        schema = to_arrow_schema(self.want.schema)
        for path, begin, to, end in part.ranges:
            with fs.open_input_file(path) as file:
                for block in blobs(file, begin, to, end):
                    found = None if self.want.kind == "nodes" else batch(block, self.want, schema)
                    found = self._rows(block, schema) if found is None else found
                    if found.num_rows:
                        yield found

    def _rows(self, block, schema):
        names, rows = self.want.has, []
        for e in elements(block, self.want):
            row = {k: v for k, v in e.items() if k in names}
            if row.get("time") is not None:
                row["time"] = row["time"] * 1000
            if "tags" in row:
                row["tags"] = list(row["tags"].items())
            rows.append(row)
        return pa.RecordBatch.from_pylist(rows, schema=schema)


class MapFile(DataSource):
    """``spark.read.format("mapfile")``; see the module."""

    @classmethod
    def name(cls):
        return "mapfile"

    def schema(self):
        return Wanted(self.options).schema

    def reader(self, schema):
        return MapFileReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MapFile)


def _read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    register(spark)
    given = {k: ("true" if v is True else "false" if v is False else str(v)) for k, v in options.items()}
    return spark.read.format("mapfile").options(kind=kind, **given).load(uri(spark, path))


def nodes(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, path, "nodes", **options)


def ways(spark: SparkSession, path: str, **options) -> DataFrame:
    """Ways of a file or a folder of files; ``tagged=True`` leaves out those without tags."""
    return _read(spark, path, "ways", **options)


def relations(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, path, "relations", **options)


def restrictions(spark: SparkSession, path: str) -> DataFrame:
    """id, tags, and the members by role: ``from``, ``to`` and ``via`` as arrays of struct(kind, ref)."""
    with_role = lambda role: F.transform(F.filter("members", lambda m: m["role"] == role), lambda m: F.struct(m["kind"].alias("kind"), m["ref"].alias("ref"))).alias(role)
    return relations(spark, path, tag="type=restriction", columns="id,tags,members").select("id", "tags", *map(with_role, ("from", "to", "via")))


def turn_rules(found: DataFrame) -> DataFrame:
    """osmid_in, osmid_out, restriction of ``restrictions`` for ``network.enforce_restrictions``: each way in with each way out."""
    way = lambda role: F.transform(F.filter(role, lambda m: m["kind"] == "way"), lambda m: m["ref"])
    rule = F.element_at("tags", "restriction")
    return found.select(rule.alias("restriction"), F.explode(way("from")).alias("osmid_in"), way("to").alias("_to")).select("osmid_in", F.explode("_to").alias("osmid_out"), "restriction").where("restriction IS NOT NULL")


def as_of(found: DataFrame, day: str) -> DataFrame:
    """Of each identifier its last version up to a day's end, unless it is deleted by then."""
    upto = found.where(F.col("time").isNull() | (F.col("time") < F.lit(day).cast("date") + F.expr("INTERVAL 1 DAY")))
    last = upto.groupBy("id").agg(F.max_by(F.struct(*found.columns), F.struct("version", "time")).alias("e"))
    return last.select("e.*").where("visible")


def packed_varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _ONE[n]
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return packed_varint(number << 3) + packed_varint(value)
    return packed_varint(number << 3 | 2) + packed_varint(len(value)) + value


def _sign(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _deltas(values) -> bytes:
    return b"".join(packed_varint(_sign(b - a)) for a, b in zip([0, *values], values))


def _numbers(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Whole numbers packed one after the other, and how many bytes each takes."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 10))
    begins = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[begins[some] + k] = (v[some] >> np.uint64(7 * k)) & np.uint64(127) | np.where(size[some] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes(), size


def _each(packed: tuple[bytes, np.ndarray], counts: list[int]) -> list[bytes]:
    """Packed numbers cut into runs of so many numbers."""
    data, size = packed
    cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _each_delta(lists: list[list[int]]) -> list[bytes]:
    """``_deltas`` of many lists."""
    counts = [len(x) for x in lists]
    flat = np.array([n for x in lists for n in x], np.int64)
    step = np.diff(flat, prepend=np.int64(0))
    begins = np.unique((np.cumsum(counts) - counts)[np.array(counts, np.int64) > 0]).astype(np.int64)
    step[begins] = flat[begins]
    return _each(_numbers((step << 1) ^ (step >> 63)), counts)


def blob(kind: bytes, content: bytes) -> bytes:
    data = _field(2, len(content)) + _field(3, zlib.compress(content))
    head = _field(1, kind) + _field(3, len(data))
    return struct.pack(">I", len(head)) + head + data


def block(rows: list[dict], kind: str) -> bytes:
    """Rows of one kind as the content of a data block."""
    strings: dict[str, int] = {"": 0}
    number = lambda s: strings.setdefault(s, len(strings))
    tags = lambda r: [(number(k), number(v)) for k, v in sorted(dict(r.get("tags") or []).items()) if v is not None]
    group = b""
    if kind == "nodes":
        spots = b"".join(b"".join(packed_varint(x) for pair in tags(r) for x in pair) + b"\0" for r in rows)
        at = lambda c: [round(r[c] * 1e7) for r in rows]
        group = _field(2, _field(1, _deltas([r["id"] for r in rows])) + _field(8, _deltas(at("lat"))) + _field(9, _deltas(at("lon"))) + _field(10, spots))
    else:
        refs = [r["nodes"] or [] for r in rows] if kind == "ways" else [[x["ref"] for x in r["members"] or []] for r in rows]
        out = []
        for r, own, there in zip(rows, _each(_numbers(np.array([r["id"] for r in rows], np.int64)), [1] * len(rows)), _each_delta(refs), strict=True):
            t = tags(r)
            body = b"\x08" + own + _field(2, b"".join([packed_varint(k) for k, _ in t])) + _field(3, b"".join([packed_varint(v) for _, v in t]))
            if r.get("version") is not None:
                when = b"" if r.get("time") is None else _field(2, int(r["time"].timestamp()))
                body += _field(4, _field(1, r["version"]) + when + (b"" if r.get("visible", True) is not False else _field(6, 0)))
            if kind == "ways":
                out.append(_field(3, body + _field(8, there)))
            else:
                m = r["members"] or []
                out.append(_field(4, body + _field(8, b"".join([packed_varint(number(x["role"] or "")) for x in m])) + _field(9, there) + _field(10, bytes([MEMBER_KINDS.index(x["kind"]) for x in m]))))
        group = b"".join(out)
    table = b"".join(_field(1, s.encode()) for s in strings)
    return _field(1, table) + _field(2, group)


def write(rows: DataFrame, folder: str, kind: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (columns as read; tags, version, time and visible may be missing) as files of blocks, one a partition that has rows, in order of id.

    Returns path, n. A file is complete in itself and moved into place when it is written.
    """
    spark = rows.sparkSession
    folder = uri(spark, folder)

    def save(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, top = FileSystem.from_uri(folder)
        name, n, out, held = f"{kind}-{TaskContext.get().partitionId():05d}.pbf", 0, None, []
        hidden = f"{top}/.{name}.{uuid.uuid4().hex}"
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                if len(held) == block_rows:
                    out = out or _begun(fs, top, hidden)
                    out.write(blob(b"OSMData", block(held, kind)))
                    n, held = n + len(held), []
        if held:
            out = out or _begun(fs, top, hidden)
            out.write(blob(b"OSMData", block(held, kind)))
            n += len(held)
        if out:
            out.close()
            fs.move(hidden, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": pa.array([n], pa.int64())})

    return rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(save, "path string, n bigint")


def _begun(fs, top: str, hidden: str):
    fs.create_dir(top, recursive=True)
    out = fs.open_output_stream(hidden)
    out.write(blob(b"OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes")))
    return out
