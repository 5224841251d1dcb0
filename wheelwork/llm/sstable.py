r"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier. A task encodes one partition
and writes it as table files of about ``TABLE_BYTES`` of ids, one after the other, so the
number of tasks follows the data at ``TASK_BYTES`` of text each. A file holds, in this order:

* data blocks of about 64 KB: entries (shared key length, own key length, value length
  as varints, own key bytes, value), every 16th with its whole key, then the places of
  those (uint32 each) and their count; each block zstd-compressed, with a crc32;
* the Bloom filter of all keys (10 bits a key, 7 probes);
* the sparse index: last key, offset and length of every block;
* JSON facts (documents, tokens, id width) and a footer of fixed size with a magic.

A key is one byte (0 null, 1 not) and the identifier as a big-endian number with its
sign bit turned, so bytes sort as identifiers do, nulls first. A value is the document's
ids, 2 bytes each (4 for vocabularies over 65536). A lookup asks the Bloom filter, finds
the block in the index and the entry among the whole keys by binary search.

Files are written under a temporary name and moved into place, so a task that runs again
after a lost executor replaces its own file by an equal one.

Cases: null text counts as empty (the end id only); null identifiers come first; rows
with equal identifiers are kept side by side, ordered by text; an empty table gives no
files; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.llm.bpe import default_path, encoder, in_portions
from wheelwork.llm.common import bounded, buckets_for, fresh_path, text_bytes, tidy, written

MAGIC = b"WWSSTAB1"
BLOCK, RESTART, BITS, PROBES = 64 << 10, 16, 10, 7
FOOTER = struct.Struct("<QQQQQQ8s")
#: Text per task, and bytes of ids in a file.
TASK_BYTES, TABLE_BYTES = 32 << 20, 16 << 20
#: Tasks up to which a task keeps that size; then it grows with the table.
MANY_TASKS = 200_000
MANIFEST = "task int, part int, path string, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint"


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + struct.pack(">Q", (identifier + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def probes(digest: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", digest)
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class Writer:
    """Writes one table; keys must come in ascending order (equal keys may repeat)."""

    def __init__(self, stream):
        import zstandard

        self.out, self.at, self.zip = stream, 0, zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes, self.n_keys = bytearray(), 0
        self._start()
        self.before: bytes | None = None
        self._put(MAGIC)

    def _start(self):
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        if self.before != key:
            self.hashes += key_hash(key)
            self.before, self.n_keys = key, self.n_keys + 1
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self):
        if self.n:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            packed = self.zip.compress(raw)
            self.index.append((self.last, *self._put(struct.pack("<I", zlib.crc32(packed)) + packed)))
            self._start()

    def close(self, **facts) -> None:
        self._flush()
        bits = max(64, BITS * self.n_keys)
        bloom = bytearray((bits + 7) // 8)
        for i in range(0, len(self.hashes), 16):
            for p in probes(self.hashes[i : i + 16], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        places = [*self._put(struct.pack("<Q", bits) + bytes(bloom))]
        places += self._put(b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index))
        places += self._put(json.dumps(facts).encode())
        self._put(FOOTER.pack(*places, MAGIC))


class Reader:
    """Reads one table through a seekable file."""

    def __init__(self, file):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        *places, magic = FOOTER.unpack(self._get(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        bloom, index, facts = (self._get(places[i], places[i + 1]) for i in (0, 2, 4))
        (self.bits,), self.bloom = struct.unpack("<Q", bloom[:8]), bloom[8:]
        self.facts = json.loads(facts)
        self.lasts, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            self.lasts.append(index[at : at + n])
            offset, at = read_varint(index, at + n)
            length, at = read_varint(index, at)
            self.blocks.append((offset, length))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        data = self._get(*self.blocks[i])
        if struct.unpack("<I", data[:4])[0] != zlib.crc32(data[4:]):
            raise ValueError(f"block {i} is damaged")
        raw = self.zip.decompress(data[4:])
        (n,) = struct.unpack("<I", raw[-4:])
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack(f"<{n}I", raw[end:-4])), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = read_varint(raw, at)
            own, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + size]
            at += own + size

    def maybe(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key_hash(key), self.bits))

    def get(self, identifier: int | None) -> list[bytes]:
        """Values of an identifier (none, one, or several where rows repeat)."""
        key, out = key_of(identifier), []
        if not self.maybe(key):
            return out
        for i in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            raw, restarts, end = self._block(i)
            whole = lambda at: next(self._entries(raw, at, end))[0]  # noqa: B023, E731
            at = restarts[max(0, bisect.bisect_left(restarts, key, key=whole) - 1)]
            for k, value in self._entries(raw, at, end):
                if k == key:
                    out.append(value)
                elif k > key:
                    return out
        return out

    def scan(self):
        for i in range(len(self.blocks)):
            raw, _, end = self._block(i)
            for key, value in self._entries(raw, 0, end):
                yield id_of(key), value


def files(uri: str):
    """The file system of a URI and the path in it, as pyarrow reaches it from any executor."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None, special_as_text: bool = False, id_column: str = "doc_id", text_column: str = "text",
                 task_bytes: int = TASK_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Encode and write all documents; returns the manifest, one row per file in the order (task, part) of the keys.

    With ``special_as_text`` the strings of special tokens in texts are ordinary text.
    """
    bounded(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    total = text_bytes(docs, text_column)
    n = buckets_for(total, max(task_bytes, total // MANY_TASKS), least=1)
    pairs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # the hash deals out rows that share an identifier
    ranged = pairs.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["task", "part", "path", "first_id", "last_id", "n_docs", "n_tokens"]

    def entries(batches, encode):
        stop = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in in_portions(texts):
                for i, value in zip(ids[lo:hi], encode.encode(texts.slice(lo, hi - lo)), strict=True):
                    yield i, value + stop

    def table(task: int, part: int, first: tuple[int | None, bytes], rest, width: int) -> pa.RecordBatch:
        """Writes one file of ``first`` and what follows, until it is full; the row of the manifest."""
        fs, top = files(folder)
        fs.create_dir(top, recursive=True)
        name = f"table-{task:06d}-{part:04d}.sst"
        hidden = f"{top}/{name}.{uuid.uuid4().hex}.tmp"
        docs = size = 0
        with fs.open_output_stream(hidden) as stream:
            writer = Writer(stream)
            for i, value in itertools.chain([first], rest):
                writer.add(key_of(i), value)
                docs, size = docs + 1, size + len(value)
                if size >= table_bytes:
                    break
            writer.close(docs=docs, tokens=size // width, width=width)
        fs.move(hidden, f"{top}/{name}")
        row = (task, part, f"{folder}/{name}", first[0], i, docs, size // width)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    @tidy
    def write(batches):
        encode = encoder(tokenizer, special_as_text)
        rows, task = entries(batches, encode), TaskContext.get().partitionId()
        for part in itertools.count():
            if (first := next(rows, None)) is None:
                return
            yield table(task, part, first, rows, encode.dtype.itemsize)

    return written(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_tables(manifest: DataFrame, checksum: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (packed), width of every document.

    With ``checksum``, ids_crc32 (over the ids as 32-bit numbers) stands for the last two.
    A task reads the files of one writing task.
    """
    bounded(manifest.sparkSession)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # a row per writing task goes through one task, not one per file
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n")).select("task", F.coalesce(F.sum("n").over(before().orderBy("task")), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("n_tokens").over(before("task").orderBy("part")), F.lit(0))
    n = manifest.select("task").distinct().count()
    spread = manifest.join(tasks, "task").select("task", "part", "path", (F.col("_base") + within).alias("base")).repartitionByRange(max(1, n), "task").sortWithinPartitions("task", "part")

    def rows(ids, start, count, values, width):
        if checksum:
            last = {"ids_crc32": pa.array([zlib.crc32(np.frombuffer(v, f"<u{width}").astype("<u4")) for v in values], pa.int64())}
        else:
            last = {"ids": pa.array(values, pa.binary()), "width": pa.array([width] * len(ids), pa.int32())}
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(count, pa.int64()), **last})

    @tidy
    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = files(uri)
                with fs.open_input_file(path) as file:
                    table = Reader(file)
                    width = table.facts["width"]
                    ids, start, count, values, size = [], [], [], [], 0
                    for i, value in table.scan():
                        ids.append(i)
                        start.append(base)
                        count.append(len(value) // width)
                        values.append(value)
                        base += count[-1]
                        size += len(value)
                        if size > 4 << 20:
                            yield rows(ids, start, count, values, width)
                            ids, start, count, values, size = [], [], [], [], 0
                    if ids:
                        yield rows(ids, start, count, values, width)

    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if checksum else "ids binary, width int"))


def op1_sstable_ids(spark, sf_dir: str) -> DataFrame:
    """All documents' ids, written to table files and read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tables(write_tables(docs, fresh_path(spark, "tables")), checksum=True)
