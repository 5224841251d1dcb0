r"""Deterministic, sharded WARC archives: range-sorted records, files rolled by compressed size.

Order and shards follow from the table alone: rows are ordered by identifier (nulls first)
and then by a hash of address and payload; the bounds of the shards are taken from a sample
of the keys that a hash of the key chooses, so neither partitions nor their sizes move
them. A shard is written by one task in that order as files ``shard-NNNNNN-NNNN.warc.gz``:
a ``warcinfo`` record and then one record a row, each a gzip member of its own, rolled when
a file has ``file_bytes`` compressed. Headers are made anew: record names are UUIDs of
identifier, address, digest and the count among equal rows; dates are the parameter ``date``; payload and block
digests are SHA-1 in base32. Equal tables give equal bytes.

A file is written under a temporary name and moved into place when complete. The manifest,
a Parquet table of all files with their records, bytes and CRC beside them, is written last
and is the commit: readers read what it lists and nothing else. A task that runs again
replaces its files by equal ones.

Of rows with equal payloads of at least ``least_bytes`` the one with the smallest identifier
(nulls last, then the smaller address) is a ``response``; the others are ``revisit`` records with
the HTTP header but no payload, which name it. It is found without windows over equal payloads: rows are counted and reduced
per (payload, slice of identifiers), then per payload, and joined back per (payload, slice), so
one payload may make up any share of the table. What a revisit refers to reaches its task in
the same range shuffle as the rows, so payloads cross the network once.

Cases: a null payload is empty; a null address is ``urn:page:IDENTIFIER``; control
characters, blanks and ``%`` in addresses are percent-encoded in headers; rows equal in identifier, address
and payload are written side by side, the first a response and the others revisits of it (all
responses below ``least_bytes``); they meet in one task, which writes them one by one; an empty
table gives no files; other columns are ignored. A payload is one row and may have up to 2 GB.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import urllib.parse
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import bounded, buckets_for, fresh_path, tidy
from wheelwork.llm.sstable import files

#: Payload bytes of a shard up to ``MANY_SHARDS`` of them, then it grows; compressed bytes after which a file is rolled, and the least share of a shard.
SHARD_BYTES, MANY_SHARDS, FILE_BYTES, FILES_A_SHARD = 32 << 20, 100_000, 4 << 20, 8
#: Keys of the sample per shard (collected to the driver: ``MANY_SHARDS`` times this at most, 16 bytes each, about).
SAMPLED = 20
#: Rows of equal payload that one slice of identifiers holds, about, if they are the whole table.
SLICE_ROWS, LEAST_SLICES = 100_000, 256
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "shard int, part int, path string, n_records bigint, n_bytes bigint, crc32 bigint"
RECORD = "record_id string, record_type string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def address(page_id: int | None, url: str | None) -> str:
    """The address as it stands in headers."""
    return f"urn:page:{'' if page_id is None else page_id}" if url is None else urllib.parse.quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%"))


def original(uri: str, page_id: int | None) -> str | None:
    return None if uri == address(page_id, None) else urllib.parse.unquote(uri)


def record_name(page_id: int | None, url: str | None, digest: bytes, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {address(page_id, url)} {digest.hex()} {nth}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))])
    zip_ = zlib.compressobj(6, wbits=31)
    return zip_.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + zip_.flush()


def http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def page_record(page_id, url, payload: bytes, digest: bytes, nth: int, first: tuple | None, date: str) -> bytes:
    """A response, or with ``first`` (identifier, address, count among equals) a revisit of that one."""
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_name(page_id, url, digest, nth)), ("WARC-Date", date), ("WARC-Target-URI", address(page_id, url))]
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32(digest))]
    if first is None:
        return member(head, http(len(payload)) + payload)
    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(first[0], first[1], digest, first[2]))]
    head += [("WARC-Refers-To-Target-URI", address(first[0], first[1])), ("WARC-Refers-To-Date", date)]
    if first[0] is not None:
        head.append(("Refers-To-Page-ID", str(first[0])))
    return member(head, http(len(payload)))


class File:
    """One archive file, complete once ``close`` has moved it into place."""

    def __init__(self, fs, folder: str, name: str, date: str):
        self.fs, self.path = fs, f"{folder}/{name}"
        self.hidden = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.n, self.size, self.crc = fs.open_output_stream(self.hidden, compression=None), 0, 0, 0
        info = b"software: wheelwork\r\nformat: WARC File Format 1.1\r\n"
        self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.n += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.hidden, self.path)


def keyed(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """page_id, url, payload (UTF-8), digest (SHA-1) and the hash ``_h`` that orders rows of one identifier."""
    payload = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    return rows.withColumn("_h", F.xxhash64("url", "digest"))


def revisits(rows: DataFrame, n_rows: int, least_bytes: int) -> DataFrame:
    """page_id, url, digest and _h of rows whose payload another row comes first with, and that row's first_id and first_url."""
    keys = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "url", "digest", "_h")
    own = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").isNull().alias("bare"), F.col("url").alias("url"))
    slices = buckets_for(n_rows, SLICE_ROWS, LEAST_SLICES)
    keys = keys.withColumn("_slice", F.pmod(F.xxhash64("page_id", "url"), F.lit(slices)).cast("int"))
    part = keys.groupBy("digest", "_slice").agg(F.min(own).alias("_own"), F.count("*").alias("_n"))
    whole = part.groupBy("digest").agg(F.min("_own").alias("_first"), F.sum("_n").alias("_all")).where("_all > 1").drop("_all")
    firsts = part.join(whole, "digest").select("digest", "_slice", "_first")
    other = (F.col("page_id").eqNullSafe(F.col("_first.id")) & F.col("url").eqNullSafe(F.col("_first.url")))
    return keys.join(firsts, ["digest", "_slice"]).where(~other).select("page_id", "url", "digest", "_h", F.col("_first.id").alias("first_id"), F.col("_first.url").alias("first_url"))


def shard_bounds(rows: DataFrame, n_rows: int, n_shards: int) -> list[tuple[bool, int, int]]:
    """Keys (not null, identifier, hash) at which shards begin, but the first; the same for equal tables."""
    one_in = max(1, n_rows // (SAMPLED * n_shards))
    key = [F.col("page_id").isNotNull().alias("some"), F.coalesce("page_id", F.lit(0)).alias("id"), "_h"]
    taken = rows.where(F.pmod(F.xxhash64(F.lit(3), "page_id", "_h"), F.lit(one_in)) == 0).select(*key)
    keys = sorted(taken.toArrow().to_pylist(), key=lambda r: tuple(r.values()))
    return sorted({tuple(keys[len(keys) * i // n_shards].values()) for i in range(1, n_shards) if keys})


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
                   id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write all pages as archives below ``folder``; returns the manifest, which is kept in ``folder``/manifest."""
    spark = pages.sparkSession
    bounded(spark)
    rows = keyed(pages, id_column, url_column, payload_column)
    facts = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(payload_column).cast("string")).cast("long")).alias("bytes")).first()
    total = (facts["bytes"] or 0) + 512 * facts["n"]
    shard_bytes = max(shard_bytes, total // MANY_SHARDS)
    file_bytes = max(file_bytes, shard_bytes // FILES_A_SHARD)
    n = buckets_for(total, shard_bytes, least=1)
    bounds = shard_bounds(rows, facts["n"], n) if n > 1 else []

    @F.pandas_udf("int")
    def shard_of(some: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, key) for key in zip(some, ids, hashes, strict=True)], dtype="int32")

    def nothing(kind):
        return F.lit(None).cast(kind)

    asked = revisits(rows, facts["n"], least_bytes).select("page_id", "url", "digest", "_h", nothing("binary").alias("payload"), F.lit(0).alias("_kind"), "first_id", "first_url")
    both = asked.unionByName(rows.select("page_id", "url", "digest", "_h", "payload", F.lit(1).alias("_kind"), nothing("bigint").alias("first_id"), nothing("string").alias("first_url")))
    both = both.withColumn("_shard", shard_of(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "_h"))
    # revisits are said before the rows that they are about
    dealt = both.repartition(n, "_shard").sortWithinPartitions("_shard", "page_id", "_h", "url", "digest", "_kind")

    def records(batches):
        """(shard, record) in order."""
        now, nth, first = None, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in ("_shard", "page_id", "url", "digest", "_kind", "first_id", "first_url", "payload")}
                key = r["page_id"], r["url"], r["digest"]
                if key != now:
                    now, nth, first = key, 0, None
                if r["_kind"] == 0:
                    first = (r["first_id"], r["first_url"], 0)
                    continue
                same = first or ((r["page_id"], r["url"], 0) if nth and len(r["payload"]) >= least_bytes else None)
                yield r["_shard"], page_record(r["page_id"], r["url"], r["payload"], r["digest"], nth, same, date)
                nth += 1

    @tidy
    def write(batches):
        fs, top = files(folder)
        fs.create_dir(top, recursive=True)
        for shard, group in itertools.groupby(records(batches), key=lambda x: x[0]):
            file, part, done = None, 0, []
            for _, record in group:
                file = file or File(fs, top, f"shard-{shard:06d}-{part:04d}.warc.gz", date)
                file.add(record)
                if file.size >= file_bytes:
                    done.append(file)
                    file.close()
                    file, part = None, part + 1
            if file:
                done.append(file)
                file.close()
            rows_ = [(shard, k, f"{folder}/{f.path.rsplit('/', 1)[1]}", f.n, f.size, f.crc) for k, f in enumerate(done)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows_, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "part", "path", "n_records", "n_bytes", "crc32"])

    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(file):
    """The gzip members of a file, each whole (one record), and the CRC of all bytes at last."""
    crc, zip_, parts, data = 0, zlib.decompressobj(wbits=31), [], b""
    while True:
        if not data:
            data = file.read(1 << 20)
            crc = zlib.crc32(data, crc)
            if not data:
                break
        parts.append(zip_.decompress(data))
        data = zip_.unused_data
        if zip_.eof:
            yield b"".join(parts), crc
            zip_, parts = zlib.decompressobj(wbits=31), []
    if parts:
        raise ValueError("a file ends within a record")
    yield None, crc


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record whose digest is right."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return headers, block


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records (but warcinfo) of all files in a manifest; with ``payload`` the bytes of responses too.

    Lengths, block digests, payload digests of responses, and the files' CRCs are verified.
    """
    bounded(manifest.sparkSession)
    kinds = RECORD + (", payload binary" if payload else "")
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in kinds.split(", ")]

    def number(text):
        return None if text is None else int(text)

    def rows(uri: str, crc_wanted: int):
        fs, path = files(uri)
        with fs.open_input_stream(path, compression=None) as file:
            for record, crc in members(file):
                if record is None:
                    if crc != crc_wanted:
                        raise ValueError(f"{uri} is not the file that was committed")
                    return
                head, block = parsed(record)
                if head["WARC-Type"] == "warcinfo":
                    continue
                said, _, body = block.partition(b"\r\n\r\n")
                n = int(said.rsplit(b"Content-Length: ", 1)[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (len(body) != n or digest != base32(hashlib.sha1(body).digest())):
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                page = number(head.get("Page-ID"))
                row = (head["WARC-Record-ID"], head["WARC-Type"], page, original(head["WARC-Target-URI"], page), digest, n, number(head.get("Refers-To-Page-ID")))
                yield (*row, body) if payload and head["WARC-Type"] == "response" else (*row, None) if payload else row

    @tidy
    def read(batches):
        for batch in batches:
            for uri, crc in zip(batch.column("path").to_pylist(), batch.column("crc32").to_pylist(), strict=True):
                held, size = [], 0
                for row in rows(uri, crc):
                    held.append(row)
                    size += 500 + (len(row[-1] or b"") if payload else 0)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), types, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), types, strict=True)], names)

    n = manifest.count()
    return manifest.select("path", "crc32").repartition(max(1, min(n, 20_000)), "path").mapInArrow(read, kinds)


def op11_warc_archives(spark, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = read_archives(write_archives(pages, fresh_path(spark, "archives")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
, d AS (SELECT *, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS k, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS f FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM d
"""
