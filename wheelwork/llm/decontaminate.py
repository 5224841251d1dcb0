r"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over the normalised words of all items. Each document's words
run through it once; after each word the state and the matched length name the longest
item substring that ends there. Where that length reaches the window (10 words), the
last window of words occurs in the items found on the state's suffix path; an item
shorter than the window counts as one window of its own length.

The items are a stated query set. Tasks build them into automata of at most
``BLOCK_WORDS`` words each and store those in the shared folder; an item that is longer
is cut into pieces that overlap by a window less a word, so each of its windows lies
whole in one. All documents are read once: a task takes a portion of them through one
automaton after the other and holds one at a time. The usual benchmark is one automaton.
Documents are looked at alone and whole; no document is shuffled.

Cases: null or empty document texts have no words and no hits; items with null or
wordless texts have no windows; a null item id is written as the empty string; repeated
items and documents give repeated findings (items are counted by id); an empty benchmark
hits nothing; input columns named like an output column go on as ``<name>_in``.
"""

from __future__ import annotations

import pickle
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import apart, bounded, buckets_for, extended, fresh_path, text_bytes, tidy
from wheelwork.llm.sstable import files
from wheelwork.llm.words import column_bytes, with_columns, words_of

#: Words of items per automaton: some 60 MB in a Python worker.
BLOCK_WORDS = 100_000
#: Text that a task takes through all automata at once, where there are several.
PORTION = 32 << 20
OUTPUT = {"n_words": "bigint", "hits": "array<struct<first:bigint,end:bigint>>", "items": "array<string>"}
REMOVED = {"n_hit": "bigint", "coverage": "double", "contaminated": "boolean", "clean_text": "string"}


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.short: dict[int, list[tuple[int, str]]] = {}
        ends: dict[int, set[str]] = {}
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.setdefault(last, set()).add(item)
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][self.vocabulary[w]]
                self.short.setdefault(state, []).append((len(words), item))
        self._close(ends)

    def _extend(self, last: int, w: int) -> int:
        length, link, follow = self.length, self.link, self.next
        if (q := follow[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p != -1:
            q = follow[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.length.append(length)
        self.next.append(follow)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _close(self, ends: dict[int, set[str]]) -> None:
        """Per state: the state of its last window, that one's items, the short items on its path."""
        n, order = len(self.length), sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.at_window: list[int] = [-1] * n
        self.path_short: list[list[tuple[int, str]]] = [[]] * n
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.at_window[v] = v if self.length[up] < self.window else self.at_window[up]
            self.path_short[v] = [*self.short[v], *self.path_short[up]] if v in self.short else self.path_short[up]
        self.items: dict[int, set[str]] = {}
        for v in order:
            if v in ends and self.at_window[v] >= 0:
                self.items.setdefault(self.at_window[v], set()).update(ends[v])

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [first, end) of words inside windows, and the items concerned."""
        length, link, follow, window = self.length, self.link, self.next, self.window
        at_window, path_short = self.at_window, self.path_short
        spans: list[list[int]] = []
        items: set[str] = set()
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            while (to := follow[state].get(w)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state = to
            matched += 1
            first = i + 1
            if matched >= window:
                first = i + 1 - window
                items |= self.items[at_window[state]]
            for n, item in path_short[state]:
                if n <= matched:
                    first = min(first, i + 1 - n)
                    items.add(item)
            if first <= i:
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return [tuple(s) for s in spans], items


def pieces(words: list[bytes], window: int):
    """``words`` in runs of at most BLOCK_WORDS (twice the window at least) that overlap by a window less one."""
    most = max(BLOCK_WORDS, 2 * window)
    for at in range(0, max(1, len(words) - window + 1), most - window + 1):
        yield words[at : at + most]


def automata(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> list[str]:
    """Paths of stored automata over all items; the driver sees nothing but the paths."""
    folder = fresh_path(benchmark.sparkSession, "automata")
    items = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("i"), F.col(text_column).alias("t"))
    n = buckets_for(text_bytes(items, "t"), 6 * BLOCK_WORDS, least=1)

    def saved(block: list[tuple[str, list[bytes]]]) -> pa.RecordBatch:
        path = f"{folder}/{uuid.uuid4().hex}"
        fs, place = files(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(place) as out:
            out.write(pickle.dumps(SuffixAutomaton(block, window), protocol=pickle.HIGHEST_PROTOCOL))
        return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    @tidy
    def run(batches):
        block, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "t"), strict=True):
                for words in pieces(words_of(text), window):
                    if block and size + len(words) > BLOCK_WORDS:
                        yield saved(block)
                        block, size = [], 0
                    if words:
                        block.append((item, words))
                        size += len(words)
        if block:
            yield saved(block)

    return [r["path"] for r in items.repartition(n).mapInArrow(run, "path string").collect()]


def held(path: str) -> SuffixAutomaton:
    fs, place = files(path)
    with fs.open_input_stream(place) as source:
        return pickle.loads(source.read())


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")


def without(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """The text without each span, from its first word's start to its last word's end."""
    if not hits:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for first, end in hits:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, max_coverage: float | None, text_column: str, item_column: str, item_text: str) -> DataFrame:
    """``docs`` with OUTPUT, and with REMOVED if ``max_coverage`` is given."""
    bounded(docs.sparkSession)
    docs = apart(docs, [*OUTPUT, *REMOVED])
    paths = automata(benchmark, window, item_column, item_text)

    def judged(batch: pa.RecordBatch, texts: list, n: list[int], spans: list, items: list) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        more = {
            "n_words": pa.array(n, pa.int64()), "hits": pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], span),
            "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        }
        if max_coverage is not None:
            hit = [sum(b - a for a, b in s) for s in spans]
            share = [h / m if m else 0.0 for h, m in zip(hit, n, strict=True)]
            clean = [None if t is None or c > max_coverage else without(t, s).decode() for t, c, s in zip(texts, share, spans, strict=True)]
            more |= {"n_hit": pa.array(hit, pa.int64()), "coverage": pa.array(share, pa.float64()), "contaminated": pa.array([h > 0 for h in hit], pa.bool_()), "clean_text": pa.array(clean, pa.string())}
        return with_columns(batch, [], more)

    @tidy
    def run(batches):
        now, automaton = None, None
        for portion in in_portions(batches, PORTION if len(paths) > 1 else 0):
            texts = [column_bytes(batch, text_column) for batch in portion]
            n = [[len(words_of(t)) for t in ts] for ts in texts]
            spans, items = [[[] for _ in ts] for ts in texts], [[set() for _ in ts] for ts in texts]
            for path in paths:
                if now != path:
                    automaton = None  # one at a time
                    now, automaton = path, held(path)
                for k, ts in enumerate(texts):
                    for j, text in enumerate(ts):
                        s, i = automaton.matches(words_of(text))
                        if s:
                            spans[k][j] = merge([*spans[k][j], *s])
                            items[k][j] |= i
            yield from map(judged, portion, texts, n, spans, items)

    return docs.mapInArrow(run, extended(docs, OUTPUT | (REMOVED if max_coverage is not None else {})))


def in_portions(batches, most: int):
    """Batches in lists of ``most`` bytes or a little more."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hits (spans of hit words) and items (sorted ids)."""
    return _found(docs, benchmark, window, None, text_column, item_column, item_text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Findings plus n_hit, coverage, contaminated and clean_text.

    clean_text lacks every span; it is null where more than ``max_coverage`` of the
    words are hit (the document is to go).
    """
    return _found(docs, benchmark, window, max_coverage, text_column, item_column, item_text)


def op4_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, list_slice(ws, i, i + least(len(ws), 10) - 1) AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
w AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN it USING (doc_id)
"""
