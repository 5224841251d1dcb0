r"""Fill-in-middle transformation by a parallel automaton scan.

Units of a text are ``[A-Za-z]+|[^A-Za-z]``, left to right. A text is cut after two drawn
numbers of units into prefix, middle and suffix, and written as ``<P>prefix<S>suffix<M>middle``
(psm), ``<S>suffix<P>prefix<M>middle`` (spm) or as it is (plain).

The scan is an automaton of four states: after another character, after a letter, after
``<``, and after ``<`` with one of P, S, M. It counts where units begin and where a sentinel
ends. A chunk of text is scanned without knowing the state it is entered in: it emits, for
each of the four, the state it is left in and both counts (``scan``). Such functions compose
associatively (``then``), so chunks are scanned anywhere and in any order; composing those
before a chunk gives the state it is entered in and the units before it. A cut is found by
selection: the one chunk where the wanted unit begins is known from the counts, and only
it looks at its bytes again.

Texts up to ``giant_bytes`` are scanned, cut and written in the task that reads them, chunk
by chunk. Longer ones are cut into chunk rows that are dealt over the cluster, kept in the
shared folder; their functions (some 100 bytes a chunk) meet per text, the cuts go back to
the chunks, and the pieces meet once more to form the row that is asked for. A row of Spark
holds at most 2 GB, so a text has at most some 8,000 chunks.

Draws: h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:identifier``.

Cases: null text is empty, empty text is plain with null lengths; a null identifier draws
as the empty string; repeated rows get equal results, as draws depend on the identifier
alone; an empty table gives no rows; input columns named like an output column go on as
``<name>_in``; all other columns are carried. Characters are code points; unpaired
surrogates cannot stand in Spark's strings.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import apart, bounded, drop_written, extended, tidy, written
from wheelwork.llm.words import column_bytes, with_columns

OUTPUT = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
#: Bytes of a chunk, and of a text from which on its chunks are dealt over the cluster.
CHUNK, GIANT = 256 << 10, 1 << 20
P, S, M = b"<P>", b"<S>", b"<M>"
#: States: after another character, a letter, "<", "<" and one of P, S, M.
OTHER, LETTER, OPEN, NAMED = range(4)
STATES = 4

_letter = np.zeros(256, bool)
_letter[list(range(65, 91)) + list(range(97, 123))] = True


def starts(chunk: bytes, entered: int) -> np.ndarray:
    """Byte places where a unit begins in a chunk that is entered in a state."""
    b = np.frombuffer(chunk, np.uint8)
    letter = _letter[b]
    inside = np.empty_like(letter)
    inside[:1] = entered in (LETTER, NAMED)
    inside[1:] = letter[:-1]
    return np.flatnonzero(np.where(letter, ~inside, (b & 0xC0) != 0x80))


def scan(chunk: bytes) -> np.ndarray:
    """The chunk's function: for each state of entry the state of exit, units begun, sentinels ended."""
    out = np.zeros((STATES, 3), np.int64)
    out[:, 0] = range(STATES)
    if not chunk:
        return out
    out[:, 1] = len(starts(chunk, OTHER))
    if _letter[chunk[0]]:
        out[[LETTER, NAMED], 1] -= 1
    out[:, 2] = sum(chunk.count(x) for x in (P, S, M))
    out[OPEN, 2] += chunk[:2] in (b"P>", b"S>", b"M>")
    out[NAMED, 2] += chunk[:1] == b">"
    last = chunk[-1:]
    out[:, 0] = OPEN if last == b"<" else LETTER if _letter[chunk[-1]] else OTHER
    if last in (b"P", b"S", b"M"):
        if len(chunk) == 1:
            out[OPEN, 0] = NAMED
        elif chunk[-2:-1] == b"<":
            out[:, 0] = NAMED
    return out


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The function of two chunks in a row."""
    out = second[first[:, 0]].copy()
    out[:, 1:] += first[:, 1:]
    return out


def chunks(text: bytes, size: int) -> list[bytes]:
    """The text in chunks of about ``size`` bytes that begin with a character."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def entries(functions: list[np.ndarray]) -> tuple[list[tuple[int, int]], int, int]:
    """Per chunk its state of entry and the units before it; units and sentinels of all."""
    whole, out = scan(b""), []
    for f in functions:
        out.append((int(whole[OTHER, 0]), int(whole[OTHER, 1])))
        whole = then(whole, f)
    return out, int(whole[OTHER, 1]), int(whole[OTHER, 2])


def drawn(identifier, n: int, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple[int, int, str]:
    """Units before both cuts, and the form of a text that may be cut."""
    digest = hashlib.sha256(f"{seed}:{'' if identifier is None else identifier}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, "plain" if h3 % 100 >= plain_from else "spm" if h4 % 100 < spm_below else "psm"


def selected(entry: list[tuple[int, int]], n: int, unit: int) -> tuple[int, int] | None:
    """The chunk in which a unit begins, and which of that chunk's units it is; None is the end of the text."""
    if unit >= n:
        return None
    k = int(np.searchsorted([before for _, before in entry], unit, side="right")) - 1
    return k, unit - entry[k][1]


def n_chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    return P + prefix + S + suffix + M + middle if form == "psm" else S + suffix + P + prefix + M + middle


def restored(output: bytes, form: str) -> bytes:
    """The text, from what was written and its form: the text itself holds no sentinel, so each is found once."""
    if form == "plain":
        return output
    marks = (P, S, M) if form == "psm" else (S, P, M)
    one, two = output.index(marks[1]), output.index(marks[2])
    first, second, middle = output[3:one], output[one + 3 : two], output[two + 3 :]
    return first + middle + second if form == "psm" else second + middle + first


def infilled(identifier, text: bytes, size: int = CHUNK, **draw) -> tuple[int, str, int | None, int | None, bytes]:
    """One text in one task: units, form, characters of prefix and middle, what is written."""
    parts = chunks(text, size)
    entry, n, hits = entries([scan(x) for x in parts])
    a, b, form = drawn(identifier, n, **draw)
    if not text or hits or form == "plain":
        return n, "plain", None, None, text
    base = np.cumsum([0, *map(len, parts)])
    cut = []
    for unit in (a, b):
        at = selected(entry, n, unit)
        cut.append(len(text) if at is None else int(base[at[0]] + starts(parts[at[0]], entry[at[0]][0])[at[1]]))
    prefix, middle, suffix = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    return n, form, n_chars(prefix), n_chars(middle), joined(form, prefix, middle, suffix)


def result(rows: list[tuple]) -> dict[str, pa.Array]:
    """The output columns from tuples of ``infilled``."""
    n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
    return {
        "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()),
        "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string()),
    }


def _giants(docs: DataFrame, id_column: str, text_column: str, size: int, draw: dict) -> DataFrame:
    """``docs``, whose texts are all long, with the output columns; chunks are dealt over the cluster."""
    # written once, so the number of a row stays the same for all that follows
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "giants")

    @tidy
    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), column_bytes(batch, text_column), strict=True):
                for k, x in enumerate(chunks(text or b"", size)):
                    yield pa.RecordBatch.from_pydict({"_row": pa.array([row], pa.int64()), "_k": pa.array([k], pa.int32()), "_chunk": pa.array([x], pa.binary())})

    pieces = rows.select("_row", text_column).mapInArrow(cut, "_row bigint, _k int, _chunk binary")
    pieces = written(pieces.repartition(F.xxhash64("_row", "_k")), "chunks")

    @tidy
    def functions(batches):
        for batch in batches:
            found = [scan(x).tobytes() for x in batch.column("_chunk").to_pylist()]
            yield with_columns(batch, ["_chunk"], {"_f": pa.array(found, pa.binary())})

    scanned = pieces.mapInArrow(functions, "_row bigint, _k int, _f binary")

    def compose(table: pa.Table) -> pa.Table:
        """Per chunk of one text: the state it is entered in, which of its units each cut stands before (-1: the text's end, null: elsewhere)."""
        table = table.sort_by("_k")
        entry, n, hits = entries([np.frombuffer(x, np.int64).reshape(STATES, 3) for x in table.column("_f").to_pylist()])
        a, b, form = drawn(table.column(id_column)[0].as_py(), n, **draw)
        form = "plain" if hits else form
        places = [(selected(entry, n, u) or (len(entry) - 1, -1)) if form != "plain" else (-1, 0) for u in (a, b)]
        own = [[p if k == at else None for k in range(len(entry))] for at, p in places]
        before = [[None if form == "plain" else int(k < at) for k in range(len(entry))] for at, _ in places]
        return pa.table({
            "_row": table.column("_row"), "_k": table.column("_k"), "_entered": pa.array([s for s, _ in entry], pa.int32()), "n": pa.array([n] * len(entry), pa.int64()),
            "form": pa.array([form] * len(entry)), "_a": pa.array(own[0], pa.int64()), "_b": pa.array(own[1], pa.int64()),
            "_to_a": pa.array(before[0], pa.int32()), "_to_b": pa.array(before[1], pa.int32()),
        })

    kinds = "_row bigint, _k int, _entered int, n bigint, form string, _a bigint, _b bigint, _to_a int, _to_b int"
    cuts = scanned.join(rows.select("_row", id_column), "_row").groupBy("_row").applyInArrow(compose, kinds)

    @tidy
    def split(batches):
        """The chunk's bytes of prefix (0), middle (1) and suffix (2)."""
        for batch in batches:
            for r in batch.to_pylist():
                chunk, at = r["_chunk"], []
                for cut_, whole in ((r["_a"], r["_to_a"]), (r["_b"], r["_to_b"])):
                    here = len(chunk) if cut_ == -1 or (cut_ is None and whole != 0) else 0 if cut_ is None else int(starts(chunk, r["_entered"])[cut_])
                    at.append(here)
                parts = (chunk[: at[0]], chunk[at[0] : at[1]], chunk[at[1] :])
                rows_ = [(i, x) for i, x in enumerate(parts) if x]
                yield pa.RecordBatch.from_pydict({
                    "_row": pa.array([r["_row"]] * len(rows_), pa.int64()), "_k": pa.array([r["_k"]] * len(rows_), pa.int32()), "n": pa.array([r["n"]] * len(rows_), pa.int64()),
                    "form": pa.array([r["form"]] * len(rows_), pa.string()), "_part": pa.array([i for i, _ in rows_], pa.int32()), "_text": pa.array([x for _, x in rows_], pa.binary()).cast(pa.string()),
                })

    placed = pieces.join(cuts, ["_row", "_k"]).mapInArrow(split, "_row bigint, _k int, n bigint, form string, _part int, _text string")
    length = lambda i: F.sum(F.when(F.col("_part") == i, F.char_length("_text").cast("long")).otherwise(0))
    whole = placed.groupBy("_row", "n", "form").agg(F.array_sort(F.collect_list(F.struct("_part", "_k", "_text"))).alias("_p"), length(0).alias("_np"), length(1).alias("_nm"))
    text = lambda i: F.concat_ws("", F.transform(F.filter("_p", lambda x: x["_part"] == i), lambda x: x["_text"]))
    sentinel = lambda x: F.lit(x.decode())
    output = (
        F.when(F.col("form") == "psm", F.concat(sentinel(P), text(0), sentinel(S), text(2), sentinel(M), text(1)))
        .when(F.col("form") == "spm", F.concat(sentinel(S), text(2), sentinel(P), text(0), sentinel(M), text(1)))
        .otherwise(F.concat(text(0), text(1), text(2)))
    )
    cut_only = lambda c: F.when(F.col("form") != "plain", F.col(c)).cast("long")
    done = whole.select("_row", "n", "form", cut_only("_np").alias("prefix_chars"), cut_only("_nm").alias("middle_chars"), output.alias("output"))
    out = written(rows.join(done, "_row").select(*docs.columns, *OUTPUT), "infilled")
    drop_written(rows, pieces)
    return out


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20,
                   chunk_bytes: int = CHUNK, giant_bytes: int = GIANT) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    Of a hundred draws, those from ``plain_from`` on stay plain, and of the rest those of a
    second draw below ``spm_below`` have the suffix first. Texts over ``giant_bytes`` are
    scanned in chunks over the cluster.
    """
    bounded(docs.sparkSession)
    draw = {"seed": seed, "plain_from": plain_from, "spm_below": spm_below}
    docs = apart(docs, [*OUTPUT, "_row"])
    giant = F.coalesce(F.octet_length(text_column) > giant_bytes, F.lit(False))

    @tidy
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index(id_column)).to_pylist(), column_bytes(batch, text_column)
            # rows that together hold a few MB, as what is written comes on top of what is read
            at = 0
            for _, group in itertools.groupby(zip(itertools.accumulate(len(t or b"") for t in texts), ids, texts, strict=True), key=lambda x: x[0] >> 22):
                done = [infilled(i, t or b"", chunk_bytes, **draw) for _, i, t in group]
                yield with_columns(batch.slice(at, len(done)), [], result(done))
                at += len(done)

    small = docs.where(~giant).mapInArrow(run, extended(docs, OUTPUT))
    if docs.where(giant).limit(1).isEmpty():
        return small
    return small.unionByName(_giants(docs.where(giant), id_column, text_column, chunk_bytes, draw))


def op12_parallel_infill(spark, sf_dir: str) -> DataFrame:
    """All documents, written for infilling and rebuilt from what was written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)

    @tidy
    def digests(batches):
        for batch in batches:
            written_, forms = column_bytes(batch, "output"), batch.column("form").to_pylist()
            hexes = [hashlib.sha256(x).hexdigest() for x in written_]
            back = [hashlib.sha256(restored(x, form)).hexdigest() for x, form in zip(written_, forms, strict=True)]
            yield with_columns(batch, ["output"], {"output_sha256": pa.array(hexes, pa.string()), "restored_sha256": pa.array(back, pa.string())})

    kinds = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return out.select("doc_id", *OUTPUT).mapInArrow(digests, kinds)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents)
, d AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t)
, c AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:least(c1, c2)::BIGINT], '') AS prefix,
    array_to_string(units[least(c1, c2)::BIGINT + 1:greatest(c1, c2)::BIGINT], '') AS middle, array_to_string(units[greatest(c1, c2)::BIGINT + 1:], '') AS suffix FROM d)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
