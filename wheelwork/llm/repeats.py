r"""Suffix-array dedup by prefix-free parsing: byte strings that an earlier document has.

A 50-byte string's trigger is the least rolling hash of its 20-byte windows. Strings in
a row with one trigger make a phrase; it overlaps the next by 49 bytes, so every string
lies whole in one phrase, and equal strings have equal triggers wherever they stand.
The distinct phrases are the dictionary, the places of phrases in documents the parse.

1. Portions of documents are parsed and stored; their trigger values are dealt out by
   range, and those that only one document has come to an end here.
2. Phrases of the other triggers go out by range: each distinct phrase of a portion once,
   with the least and greatest document of its occurrences in the parse. Per range, the
   dictionary's suffix array (to the depth of 50 bytes) puts all strings in corpus order;
   equal strings are ordered by the parse, that is by document, and the first one is to
   keep. What follows a string in the parse would order equals by later bytes, which
   nothing here asks for; so the parse gets no suffix array of its own.
3. Each portion gets back the first document per string of its phrases, and marks the
   strings of later documents. Bytes under a marked string are removed.

All comparisons of strings are exact, but that phrases of one range are known by a
64-bit hash. Portions are files in the shared folder, read by path through pyarrow.

Cases: null and short texts have no strings; rows with a null identifier are compared
with nothing and stay whole; equal identifiers count as one document (neither is
smaller); matches never cross documents; an empty table gives no rows; other columns are
carried along, those named like an output column as ``<name>_in``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import apart, bounded, buckets_for, extended, fresh_path, spread, text_bytes, tidy, written
from wheelwork.llm.packed import groups, pack, record, small, unpack
from wheelwork.llm.shingles import BASE, CHUNK, mix, stretch_hashes
from wheelwork.llm.sstable import files
from wheelwork.llm.words import column_bytes, with_columns

LENGTH, GRAM = 50, 20
#: Bits of a trigger value as it is dealt out.
BITS = 47
PORTION, RANGE, MOST_DOCS = 4 << 20, 16 << 20, 60_000
ROWS = "range bigint, portion bigint, data binary"
NAMES, KINDS = ["range", "portion", "data"], [pa.int64(), pa.int64(), pa.binary()]
OUTPUT = {"n_bytes": "bigint", "spans": "array<struct<start:bigint,end:bigint>>", "kept": "binary"}


def loads(data: bytes, kind: str) -> np.ndarray:
    """The number that starts at each byte; ``data`` is padded so that every byte has one."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(data) - size + 1,), kind, data, strides=(1,))


def phrases(texts: list[bytes | None], known: list[bool]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text of a portion, and of each phrase: start, number of strings, trigger value, document's place."""
    data = b"".join(t or b"" for t in texts)
    ends = np.cumsum([len(t or b"") for t in texts])
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return data, none, none, none.astype(np.uint64), none
    grams = len(data) - GRAM + 1
    eights = loads(data, "<u8")
    g = eights[:grams] * np.uint64(BASE)
    g += eights[8 : 8 + grams] * np.uint64(0xD6E8FEB86659FD93)
    g += loads(data, "<u4")[16 : 16 + grams] * np.uint64(0xA0761D6478BD642F)
    g = mix(g)
    width = LENGTH - GRAM + 1
    step = 1
    while step * 2 <= width:
        g = np.minimum(g[:-step], g[step:])
        step *= 2
    least = np.minimum(g[: n], g[width - step : width - step + n])
    open_ = np.zeros(len(data) + 2, np.int8)
    for a, b, k in zip([0, *ends[:-1].tolist()], ends.tolist(), known, strict=True):
        if k and b - a >= LENGTH:
            open_[a] += 1
            open_[b - LENGTH + 1] -= 1
    valid = np.cumsum(open_[:n], dtype=np.int8) > 0
    turn = np.ones(n, bool)
    turn[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(turn & valid)
    # a phrase ends where the next begins or where strings cease to be valid
    stop = np.flatnonzero(np.append(turn[1:] | ~valid[1:], True) & valid) + 1
    value = mix(least[start]) >> np.uint64(64 - BITS)
    return data, start, stop - start, value, np.searchsorted(ends, start, side="right")


def hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of ``data``, a chunk of it at a time."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    begins = start[order]
    lo = 0
    while lo < len(order):
        base = int(begins[lo])
        hi = int(np.searchsorted(begins, base + CHUNK // 2, side="right"))
        some = order[lo:hi]
        part = np.frombuffer(data, np.uint8, int(end[some].max()) - base, base)
        out[some] = mix(stretch_hashes(part, start[some] - base, end[some] - base) + (end[some] - start[some]).astype(np.uint64))
        lo = hi
    return out


def bounds(n_ranges: int) -> np.ndarray:
    return (np.arange(n_ranges + 1, dtype=object) * (1 << BITS) // n_ranges).astype(np.uint64)


def store(path: str, table: pa.Table) -> None:
    fs, place = files(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place) as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)


def load(path: str) -> pa.RecordBatch:
    fs, place = files(path)
    with fs.open_input_stream(place) as source, pa.ipc.open_stream(source) as reader:
        return reader.read_all().combine_chunks().to_batches()[0]


def portion_phrases(batch: pa.RecordBatch, id_column: str, text_column: str):
    ids = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
    texts = column_bytes(batch, text_column)
    return ids, texts, phrases(texts, [i is not None for i in ids])


def parsed(docs: DataFrame, folder: str, n_ranges: int, portion_bytes: int, id_column: str, text_column: str) -> DataFrame:
    """Stores portions; their trigger values by range, and a row of range -1 with the path."""
    cuts = bounds(n_ranges)

    def emit(portion: int, batches: list[pa.RecordBatch]):
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        path = f"{folder}/{portion}-{uuid.uuid4().hex}"
        store(path, pa.Table.from_batches([batch]))
        yield -1, portion, path.encode()
        _, _, (_, _, _, value, doc) = portion_phrases(batch, id_column, text_column)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(value)) - 1 if len(value) else first
        several = doc[first] != doc[last]
        value = value[first]
        at = np.searchsorted(value, cuts)
        for r in np.flatnonzero(at[1:] > at[:-1]):
            part = slice(at[r], at[r + 1])
            yield int(r), portion, pack(small(np.diff(value[part], prepend=cuts[r])), np.packbits(several[part]))

    @tidy
    def run(batches):
        task, n, kept, size, count = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            sizes = [len(t or b"") for t in column_bytes(batch, text_column)]
            lo = 0
            for i, s in enumerate(sizes):
                size, count = size + s, count + 1
                if size >= portion_bytes or count >= MOST_DOCS * portion_bytes // PORTION:
                    yield record(emit((task << 24) + n, [*kept, batch.slice(lo, i + 1 - lo)]), NAMES, KINDS)
                    lo, n, kept, size, count = i + 1, n + 1, [], 0, 0
            if lo < len(sizes):
                kept.append(batch.slice(lo))
        if kept:
            yield record(emit((task << 24) + n, kept), NAMES, KINDS)

    return docs.mapInArrow(run, ROWS)


def by_range(rows: DataFrame, n: int) -> DataFrame:
    """Rows of portions (range -1) are dealt by portion, all others by range, to ``n`` partitions."""
    return rows.repartition(n, "range", F.when(F.col("range") < 0, F.col("portion"))).sortWithinPartitions("range", "portion")


def by_portion(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "portion").sortWithinPartitions("portion", "range")


def shared_triggers(rows: DataFrame, n_ranges: int, n_parts: int) -> DataFrame:
    """Per range and portion, the trigger values that two documents have."""
    cuts = bounds(n_ranges)

    def one(group: list[dict]):
        values, several, owner = [], [], []
        for i, r in enumerate(group):
            gaps, flags = unpack(r["data"])
            values.append(cuts[r["range"]] + np.cumsum(gaps.astype(np.uint64)))
            several.append(np.unpackbits(flags, count=len(gaps)).astype(bool))
            owner.append(np.full(len(gaps), i, np.int32))
        value, several, owner = np.concatenate(values), np.concatenate(several), np.concatenate(owner)
        order = np.argsort(value)
        v = value[order]
        edge = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1], [True])))
        times = np.diff(edge)
        shared = (times > 1) | np.logical_or.reduceat(several[order], edge[:-1])
        keep = order[np.repeat(shared, times)]
        keep.sort()  # portions one after the other, values ascending in each
        at = np.searchsorted(owner[keep], np.arange(len(group) + 1))
        for i in np.flatnonzero(at[1:] > at[:-1]):
            yield group[i]["range"], group[i]["portion"], pack(small(np.diff(value[keep[at[i] : at[i + 1]]], prepend=cuts[group[i]["range"]])))

    @tidy
    def run(batches):
        for group in groups(batches, "range"):
            out = [(r["range"], r["portion"], r["data"]) for r in group] if group[0]["range"] < 0 else list(one(group))
            if out:
                yield record(out, NAMES, KINDS)

    return by_range(rows, n_parts).mapInArrow(run, ROWS)


def shared_phrases(rows: DataFrame, n_ranges: int, n_parts: int, id_column: str, text_column: str) -> DataFrame:
    """Per range and portion, the distinct phrases of shared triggers; the parse is stored by portion."""
    import zstandard

    cuts = bounds(n_ranges)

    def one(group: list[dict]):
        path = next(r["data"] for r in group if r["range"] < 0).decode()
        portion = group[0]["portion"]
        yield -1, portion, path.encode()
        wanted = [cuts[r["range"]] + np.cumsum(unpack(r["data"])[0].astype(np.uint64)) for r in group if r["range"] >= 0]
        if not wanted:
            return
        wanted = np.concatenate(wanted)
        ids, texts, (data, start, count, value, doc) = portion_phrases(load(path), id_column, text_column)
        near = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
        keep = wanted[near] == value
        start, count, value, doc = start[keep], count[keep], value[keep], doc[keep]
        h = hashes(data, start, start + count + LENGTH - 1)
        order = np.lexsort((start, h, value))
        start, count, value, doc, h = start[order], count[order], value[order], doc[order], h[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (value[1:] != value[:-1])))
        first = np.flatnonzero(new)
        phrase = np.cumsum(new) - 1
        begins = np.cumsum([0, *(len(t or b"") for t in texts)])
        fs_path = path + "-parse"
        store(fs_path, pa.table({"phrase": phrase.astype("<u4"), "doc": doc.astype("<u4"), "at": (start - begins[doc]).astype("<i8")}))
        number = np.array([i if i is not None else 0 for i in ids], np.int64)[doc]
        low, high = np.minimum.reduceat(number, first), np.maximum.reduceat(number, first)
        start, count, value = start[first], count[first], value[first]
        at = np.searchsorted(value, cuts)
        zip_ = zstandard.ZstdCompressor(level=3)
        for r in np.flatnonzero(at[1:] > at[:-1]):
            a, b = int(at[r]), int(at[r + 1])
            text = b"".join([data[s : s + c] for s, c in zip(start[a:b].tolist(), (count[a:b] + LENGTH - 1).tolist(), strict=True)])
            part = pack(np.array([a], "<i8"), count[a:b].astype("<u4"), low[a:b], high[a:b] - low[a:b], small(np.diff(value[a:b], prepend=cuts[r])), np.frombuffer(text, np.uint8))
            yield int(r), portion, zip_.compress(part)

    @tidy
    def run(batches):
        for group in groups(batches, "portion"):
            yield record(one(group), NAMES, KINDS)

    return by_portion(rows, n_parts).mapInArrow(run, ROWS)


def ranks(key: np.ndarray) -> np.ndarray:
    """Places of equal keys among the distinct ones, in order."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1])))
    return out


def suffix_ranks(text: bytes) -> np.ndarray:
    """Order of all suffixes of ``text`` by their first 50 bytes: suffix array by doubling."""
    n = len(text)
    r = ranks(loads(text + bytes(8), "<u8")[:n].byteswap())
    span = 8
    for step in (8, 16, LENGTH - 32):
        later = np.zeros(n, np.uint64)
        later[: n - step] = r[step:] + np.uint64(1)
        r = ranks(r * np.uint64(n + 1) + later)
        span += step
    assert span == LENGTH
    return r


def first_documents(rows: DataFrame, n_ranges: int, n_parts: int) -> DataFrame:
    """Per range and portion: for stretches of strings of its phrases, the first document that has them."""
    import zstandard

    def one(group: list[dict]):
        unzip = zstandard.ZstdDecompressor()
        cut = bounds(n_ranges)[group[0]["range"]]
        base, count, low, high, value, owner, texts = [], [], [], [], [], [], []
        for i, r in enumerate(group):
            (first,), c, lo, more, gaps, text = unpack(unzip.decompress(r["data"]))
            base.append(first + np.arange(len(c)))
            count.append(c.astype(np.int64))
            low.append(lo)
            high.append(lo + more)
            value.append(cut + np.cumsum(gaps.astype(np.uint64)))
            owner.append(np.full(len(c), i, np.int32))
            texts.append(text.tobytes())
        data = b"".join(texts)
        base, count, low, high, value, owner = map(np.concatenate, (base, count, low, high, value, owner))
        end = np.cumsum(count + LENGTH - 1)
        start = end - count - LENGTH + 1
        # the dictionary: equal phrases of all portions are one
        h = hashes(data, start, end)
        order = np.lexsort((h, value))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (value[order][1:] != value[order][:-1])))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        some = order[new]
        least = np.minimum.reduceat(low[order], np.flatnonzero(new))
        # corpus order: the dictionary's suffix array puts every string beside its equals, wherever it stands
        words = b"".join([data[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
        n_strings = count[some]
        place = np.cumsum(n_strings + LENGTH - 1) - n_strings - LENGTH + 1
        offset = np.arange(int(n_strings.sum())) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)
        of = np.repeat(np.arange(len(some)), n_strings)
        rank = suffix_ranks(words)[place[of] + offset]
        # among equals the parse decides: the first document of all phrases that hold the string
        first = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        by = np.argsort(rank)
        at = np.flatnonzero(np.concatenate(([True], rank[by][1:] != rank[by][:-1])))
        first[rank[by][at]] = np.minimum.reduceat(least[of][by], at)
        doc = first[rank]
        # per stretch of strings with one first document: entry, first string, past string, document
        turn = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]))))
        last = np.append(turn[1:], len(doc)) - 1
        e, a, b, doc = of[turn], offset[turn], offset[last] + 1, doc[turn]
        lo, hi = np.searchsorted(e, entry), np.searchsorted(e, entry, side="right")
        which = np.repeat(np.arange(len(entry)), hi - lo)
        s = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        use = doc[s] < high[which]
        which, s = which[use], s[use]
        at = np.searchsorted(owner[which], np.arange(len(group) + 1))
        for i in np.flatnonzero(at[1:] > at[:-1]):
            w, t = which[at[i] : at[i + 1]], s[at[i] : at[i + 1]]
            yield group[i]["range"], group[i]["portion"], pack(base[w].astype("<u4"), a[t].astype("<u4"), b[t].astype("<u4"), doc[t])

    @tidy
    def run(batches):
        for group in groups(batches, "range"):
            out = [(r["range"], r["portion"], r["data"]) for r in group] if group[0]["range"] < 0 else list(one(group))
            if out:
                yield record(out, NAMES, KINDS)

    return by_range(rows, n_parts).mapInArrow(run, ROWS)


def spans_of(ids: list, n_docs: int, parse: pa.RecordBatch, found: list[list[np.ndarray]]) -> list[list[tuple[int, int]]]:
    """Merged removed spans per document of a portion."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    phrase, a, b, doc = (np.concatenate([f[i] for f in found]) for i in range(4))
    by = np.argsort(phrase, kind="stable")
    phrase, a, b, doc = phrase[by], a[by].astype(np.int64), b[by].astype(np.int64), doc[by]
    own, row, at = (parse.column(c).to_numpy(zero_copy_only=False) for c in ("phrase", "doc", "at"))
    number = np.array([i if i is not None else 0 for i in ids], np.int64)
    lo, hi = np.searchsorted(phrase, own), np.searchsorted(phrase, own, side="right")
    n = hi - lo
    which = np.repeat(np.arange(len(own)), n)
    s = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    use = doc[s] < number[row[which]]
    which, s = which[use], s[use]
    row, begin, end = row[which], at[which] + a[s], at[which] + b[s] + LENGTH - 1
    order = np.lexsort((begin, row))
    row, begin, end = row[order].astype(np.int64), begin[order], end[order]
    if len(row):
        # spans of one document that touch or overlap become one
        shift = row * (int(end.max()) + 2)
        reach = np.maximum.accumulate(end + shift)
        turn = np.flatnonzero(np.concatenate(([True], (begin + shift)[1:] > reach[:-1])))
        past = np.append(turn[1:], len(row)) - 1
        for r, x, y in zip(row[turn].tolist(), begin[turn].tolist(), (reach[past] - shift[past]).tolist(), strict=True):
            out[r].append((x, y))
    return out


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, spans (removed, in UTF-8 bytes) and kept (the remaining bytes).

    With ``as_text``, kept is a string; bytes of characters cut in two are left out of it.
    """
    docs = apart(docs, list(OUTPUT))
    docs = docs.withColumn(id_column, F.col(id_column).cast("long"))
    folder = fresh_path(docs.sparkSession, "portions")
    bounded(docs.sparkSession)
    total = text_bytes(docs, text_column)
    portion_bytes, range_bytes = spread(total, PORTION, RANGE)
    n_ranges = buckets_for(total, range_bytes)
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(total, range_bytes, least=1))
    rows = written(parsed(docs, folder, n_ranges, portion_bytes, id_column, text_column), "triggers")
    rows = shared_phrases(shared_triggers(rows, n_ranges, n_parts), n_ranges, n_parts, id_column, text_column)

    @tidy
    def run(batches):
        for group in groups(batches, "portion"):
            path = next(r["data"] for r in group if r["range"] < 0).decode()
            batch = load(path)
            texts = column_bytes(batch, text_column)
            ids = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
            found = [unpack(r["data"]) for r in group if r["range"] >= 0]
            spans = spans_of(ids, len(ids), load(path + "-parse"), found) if found else [[] for _ in ids]
            kept = []
            for t, cut in zip(texts, spans, strict=True):
                parts, at = [], 0
                for a, b in cut:
                    parts.append((t or b"")[at:a])
                    at = b
                kept.append(b"".join([*parts, (t or b"")[at:]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield with_columns(batch, [], {
                "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()), "spans": pa.array([[{"start": a, "end": b} for a, b in cut] for cut in spans], span),
                "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            })

    return by_portion(first_documents(rows, n_ranges, n_parts), n_parts).mapInArrow(run, extended(docs, OUTPUT | ({"kept": "string"} if as_text else {})))


def op6_prefix_free_parsing(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
