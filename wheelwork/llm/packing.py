r"""Packing of documents into fixed windows by non-negative least squares.

Documents are encoded, ended and cut into whole windows and a rest. Rests are put in
classes of ``UNIT`` tokens (rounded up), so the histogram has at most window / UNIT
classes whatever the corpus. On the driver, combinations of up to three classes that
fill a window are enumerated, their repeat counts are solved against the histogram by
non-negative least squares (active set), rounded down and cut to what there is; what is
left is packed greedily, largest class first, again by histogram. Each piece then finds
its place from its rank in its class alone:

* the encoding tasks number the pieces of each class as they write them; counts per
  task and class give each task's first rank, so ranking moves no ids;
* a pattern that repeats m times owns a run of ranks in each of its classes;
* one shuffle by sequence brings the ids of a sequence together.

Cases: null text counts as empty (the end id only); null and repeated identifiers are
kept as they are; an empty table gives no sequences; other columns are ignored. A very
long text yields many whole windows and one rest.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.llm.bpe import default_path, encoder, in_portions
from wheelwork.llm.common import bounded, tidy, written
from wheelwork.llm.words import with_columns

UNIT = 4
#: Rows of the table of first ranks that are broadcast at most (20 bytes each); beyond it is joined by a shuffle.
MOST_BROADCAST = 1_000_000
PIECES = "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary, class int, task int, place bigint"


def nnls(a: np.ndarray, target: np.ndarray, most: int = 600) -> np.ndarray:
    """Lawson-Hanson active set: x >= 0 that minimises |ax - target|.

    After ``most`` steps it takes what it has; the greedy rest packs what is then left over.
    """
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    rest, enough = target.copy(), 1e-6 * max(1.0, target.max())
    for _ in range(most):
        slope = a.T @ rest
        slope[passive] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= enough:
            break
        passive[k] = True
        while passive.any():
            ks = np.flatnonzero(passive)
            m = a[:, ks]
            s = np.linalg.solve(m.T @ m + 1e-9 * np.eye(len(ks)), m.T @ target)
            if s.min() > 0:
                x[:] = 0
                x[ks] = s
                break
            bad = s <= 0
            old = x[ks]
            step = np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-12))
            x[ks] = old + step * (s - old)
            off = ks[bad & (x[ks] <= 1e-9)]
            off = off if len(off) else ks[bad]
            passive[off] = False
            x[off] = 0
        rest = target - a[:, passive] @ x[passive]
    return x


def combinations(size: int, present: np.ndarray) -> np.ndarray:
    """Pairs and triples of present classes that fill ``size`` units, as rows of three (-1: none)."""
    out = [(a, size - a, -1) for a in range(1, size // 2 + 1) if present[a] and present[size - a]]
    out += [(a, b, size - a - b) for a in range(1, size // 3 + 1) if present[a] for b in range(a, (size - a) // 2 + 1) if present[b] and present[size - a - b]]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes (largest first) with their repeat counts; they use up the histogram.

    Classes run from 1 to ``size`` units.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for c, n in histogram.items():
        left[c] = n
    out = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    combos = combinations(size, left > 0)
    if len(combos):
        matrix = np.zeros((size + 2, len(combos)))
        np.add.at(matrix, (combos.ravel(), np.repeat(np.arange(len(combos)), 3)), 1.0)  # row -1 takes the gaps
        counts = np.floor(nnls(matrix[:-1], left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            use = Counter(int(c) for c in combos[k] if c >= 0)
            times = min(int(counts[k]), *(int(left[c]) // u for c, u in use.items()))
            if times > 0:
                for c, u in use.items():
                    left[c] -= u * times
                out.append((tuple(sorted(use.elements(), reverse=True)), times))
    while (some := np.flatnonzero(left)).size:
        pattern, room, free = [], size, left.copy()
        for c in some[::-1]:
            u = int(min(room // c, free[c]))
            if u and pattern and u > 4:
                u = 4  # keeps patterns short; the rest follows in later ones
            pattern += [int(c)] * u
            room -= u * int(c)
        use = Counter(pattern)
        times = min(int(left[c]) // u for c, u in use.items())
        for c, u in use.items():
            left[c] -= u * times
        out.append((tuple(pattern), times))
    return out


def encoded_pieces(docs: DataFrame, window: int, end_id: int, tokenizer: str, special_as_text: bool, id_column: str, text_column: str) -> DataFrame:
    """Whole windows and rests of all documents, numbered by class within each task."""
    pairs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    @tidy
    def run(batches):
        encode, task = encoder(tokenizer, special_as_text), TaskContext.get().partitionId()
        width, stop = encode.dtype.itemsize, np.array([end_id], encode.dtype).tobytes()
        places = [0] * (window // UNIT + 2)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in in_portions(texts):
                out = [[] for _ in range(8)]
                for i, value in zip(ids[lo:hi], encode.encode(texts.slice(lo, hi - lo)), strict=True):
                    value += stop
                    total = len(value) // width
                    for start in range(0, total, window):
                        n = min(window, total - start)
                        c = -(-n // UNIT)
                        for column, x in zip(out, (i, start, n, total, value[start * width : (start + n) * width], c, task, places[c]), strict=True):
                            column.append(x)
                        places[c] += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids", "class", "task", "place"])

    return pairs.mapInArrow(run, PIECES)


def runs(patterns: list[tuple[tuple[int, ...], int]]):
    """Per pattern and class: class, first rank, past rank, repeats, first sequence, first member."""
    used, base = Counter(), 0
    for pattern, times in patterns:
        member = 0
        for c, u in sorted(Counter(pattern).items(), reverse=True):
            yield c, used[c], used[c] + u * times, times, base, member
            used[c] += u * times
            member += u
        base += times


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, tokenizer: str | None = None, special_as_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Sequences: sequence_id, n_tokens, padded_to, ids (packed), pieces in order.

    A piece has doc_id, start, length, doc_tokens and its offset in the sequence.
    ``padded_to`` is the window, or n_tokens itself where that is a power of two.
    With ``special_as_text`` the strings of special tokens in texts are ordinary text.
    """
    spark = docs.sparkSession
    bounded(spark)
    pieces = written(encoded_pieces(docs, window, end_id, tokenizer or default_path(), special_as_text, id_column, text_column), "pieces")
    counts = pieces.groupBy("task", "class").count()
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select("task", "class", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"), "count"), "ranks")
    # at most window / UNIT + 1 rows
    histogram = {r["class"]: r["n"] for r in firsts.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    small = firsts.count() <= MOST_BROADCAST
    firsts = firsts.drop("count")
    table = list(runs(plan(histogram, window // UNIT))) or [(0, 0, 0, 1, 0, 0)]
    # a few rows for each class and pattern, whatever the corpus
    where = spark.createDataFrame(table, "class int, lo bigint, hi bigint, times bigint, base bigint, member0 int")
    ranked = pieces.join(F.broadcast(firsts) if small else firsts, ["task", "class"]).withColumn("rank", F.col("first") + F.col("place"))
    placed = ranked.join(F.broadcast(where), (ranked["class"] == where["class"]) & (ranked["rank"] >= where["lo"]) & (ranked["rank"] < where["hi"]))
    placed = placed.select(
        (F.col("base") + (F.col("rank") - F.col("lo")) % F.col("times")).alias("sequence_id"),
        F.struct((F.col("member0") + F.expr("(rank - lo) div times")).alias("member"), "doc_id", "start", "length", "doc_tokens", "ids").alias("p"),
    )
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    lengths = lambda upto: F.aggregate(upto, F.lit(0), lambda n, p: n + p["length"])
    n = lengths(F.col("ps"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return grouped.select(
        "sequence_id", n.alias("n_tokens"),
        F.aggregate("ps", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
        F.transform("ps", lambda p, i: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), p["doc_tokens"].alias("doc_tokens"), lengths(F.slice("ps", 1, i)).alias("offset"))).alias("pieces"),
    ).select("sequence_id", "n_tokens", F.when(power, F.col("n_tokens")).otherwise(window).alias("padded_to"), "ids", "pieces")


def unpacked(sequences: DataFrame) -> DataFrame:
    """One row per piece, with the crc32 of its ids as 32-bit numbers, read from the sequences."""
    width = F.expr("length(ids) div n_tokens")
    flat = sequences.select("sequence_id", width.alias("w"), "ids", F.explode("pieces").alias("p"))
    flat = flat.select(
        F.col("p.doc_id").alias("doc_id"), F.col("p.start").alias("start"), F.col("p.length").cast("long").alias("length"), F.col("p.doc_tokens").alias("doc_tokens"),
        "sequence_id", F.col("p.offset").cast("long").alias("offset"), "w", F.expr("substring(ids, cast(p.offset * w + 1 as int), cast(p.length * w as int))").alias("ids"),
    )

    @tidy
    def run(batches):
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(v, f"<u{w}").astype("<u4").tobytes()) for v, w in zip(b.column("ids").to_pylist(), b.column("w").to_pylist(), strict=True)]
            yield with_columns(b, ["ids", "w"], {"ids_crc32": pa.array(crc, pa.int64())})

    return flat.mapInArrow(run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint")


def op8_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return unpacked(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
