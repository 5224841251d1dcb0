r"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their 4, 5 and 6 byte beginnings,
hashed into a table of ``SLOTS`` places, whatever the vocabulary. The machine adds a
weight per slot and, for every pair of slots, the inner product of their factors, so
that an insult beside the mention of a group can weigh more than both alone.

It is fitted in numpy on a bounded sample of labelled rows. Two tests say which slots
carry evidence: a slot's own toxic share, and, for every pair of slots that chance alone
would bring together in ``LEAST_TOGETHER`` documents, the pair's toxic share beside the
one that the sum of both slots' own effects foretells. So slots that tell nothing alone
but something together reach the machine. Slots without evidence of either kind weigh 0.
Scoring runs over every whole text in Arrow batches with the fitted table sent to the
workers. Nothing is shuffled but the labels and the sample's slots.

Bounds (parameters): ``MAX_PER_CLASS`` labelled rows of each class, taken in the order
of a seeded hash of the identifier, and ``SLOTS`` places (20 bytes each in the model).
One task fits on the slots of the sample: one row an identifier, 4 bytes a distinct
slot. What comes to the driver is the model.

Cases: null or empty text has no terms, its score is the intercept's; a null identifier
is not held out and never a training row; of several texts of one identifier one is
learned (the least by hash); several labels of one identifier count as toxic if any is;
null labels are left out; without labels of both classes every score is 0; input columns
named like an output column go on as ``<name>_in``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import apart, bounded, extended, tidy
from wheelwork.llm.words import column_bytes, with_columns, words_of

MAX_PER_CLASS = 5_000
SLOTS = 1 << 20
#: Training documents that hold a term, at least; standard errors that its share of toxic ones is off.
LEAST_DOCS, LEAST_APART = 4, 4.0
#: Documents in which chance alone brings a pair together, at least; standard errors off the sum of both effects.
LEAST_TOGETHER, LEAST_JOINT = 16, 6.0
#: Slots whose pairs are counted at once.
BLOCK = 512
FACTORS = 4
PREFIXES = (4, 5, 6)
OUTPUT = {"toxicity": "double"}


def word_terms(word: bytes) -> tuple[int, ...]:
    """The slots of a word and its beginnings."""
    return tuple(zlib.crc32(t) % SLOTS for t in (b"=" + word, *(b"^" + word[:n] for n in PREFIXES if len(word) >= n)))


class Terms:
    """Slots of texts; remembers what it has hashed, up to a bound."""

    def __init__(self, keep=None, most: int = 150_000):
        self.keep, self.most, self.known = keep, most, {}

    def of(self, text: bytes | None) -> set[int]:
        out: set[int] = set()
        known, keep = self.known, self.keep
        for w in set(words_of(text)):
            if (t := known.get(w)) is None:
                t = word_terms(w)
                if keep is not None:
                    t = tuple(keep[x] for x in t if x in keep)
                if len(known) >= self.most:
                    known.clear()
                known[w] = t
            out.update(t)
        return out


def alone(docs: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How far the toxic share of each slot is from the overall one, in standard errors."""
    return np.abs(toxic - docs * share) / np.sqrt(docs * share * (1 - share))


def together(rows: list[np.ndarray], y: np.ndarray, docs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slots that tell something in a pair beyond what both tell by themselves.

    ``docs`` and ``toxic`` count rows by slot. Pairs are counted in blocks of ``BLOCK`` by
    ``BLOCK`` slots, so memory follows the rows alone.
    """
    n, share = len(rows), y.mean()
    least = np.sqrt(LEAST_TOGETHER * n)
    some = np.flatnonzero((docs >= least) & (n - docs >= least))
    place = np.full(SLOTS, -1, np.int32)
    place[some] = np.arange(len(some))
    places = [p[p >= 0] for p in (place[t] for t in rows)]
    row = np.repeat(np.arange(n, dtype=np.int32), [len(p) for p in places])
    column = np.concatenate(places)
    docs, rate = docs[some], toxic[some] / docs[some]
    found = np.zeros(len(some), bool)

    def block(lo: int, hi: int) -> np.ndarray:
        part = np.zeros((n, hi - lo), np.float32)
        inside = (column >= lo) & (column < hi)
        part[row[inside], column[inside] - lo] = 1
        return part

    for a in range(0, len(some), BLOCK):
        to_a = min(a + BLOCK, len(some))
        left = block(a, to_a)
        for b in range(a, len(some), BLOCK):
            to_b = min(b + BLOCK, len(some))
            right = left if a == b else block(b, to_b)
            both, both_toxic = left.T @ right, (left * y[:, None]).T @ right
            expected = np.clip(rate[a:to_a, None] + rate[None, b:to_b] - share, 1 / n, 1 - 1 / n)
            with np.errstate(divide="ignore", invalid="ignore"):
                far = np.abs(both_toxic - both * expected) / np.sqrt(both * expected * (1 - expected))
            # a word and its own beginning stand together always: no pair
            far[(both < LEAST_TOGETHER) | (both >= np.minimum(docs[a:to_a, None], docs[None, b:to_b]) * 0.99)] = 0
            far[~np.isfinite(far)] = 0
            found[a:to_a] |= (far >= LEAST_JOINT).any(1)
            found[b:to_b] |= (far >= LEAST_JOINT).any(0)
    return some[found]


def sum_by(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    for f in range(rows.shape[1]):
        out[:, f] = np.bincount(place, rows[:, f], n)
    return out


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = 20, rate: float = 0.02, decay: float = 1e-4, seed: int = 5, factors: int = FACTORS) -> dict:
    """Fit on (label, slots) rows; returns features (slot to place), weights, factors, intercept."""
    once = {(label, hashlib.blake2b(t.tobytes(), digest_size=16).digest()): (label, t) for label, t in rows}  # copies count once
    y = np.array([label for label, _ in once.values()], dtype=np.float32)
    rows = [t for _, t in once.values()]
    if not rows or y.min() == y.max():
        return {"features": {}, "w": np.zeros(0, np.float32), "v": np.zeros((0, factors), np.float32), "b": -np.inf}
    docs, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for label, t in zip(y, rows, strict=True):  # a row has each slot once
        docs[t] += 1
        toxic[t] += label
    share = float(y.mean())
    often = np.flatnonzero(docs >= LEAST_DOCS)
    chosen = np.union1d(often[alone(docs[often], toxic[often], share) >= LEAST_APART], together(rows, y, docs, toxic))
    place = np.full(SLOTS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    data = [p[p >= 0] for p in (place[t] for t in rows)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen), np.float32), rng.normal(0, 0.05, (len(chosen), factors)).astype(np.float32)
    b = np.float32(np.log(share / (1 - share)))
    class_weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    gw, gv = np.full(len(w), 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32)
    gb = 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            idx = np.concatenate([data[i] for i in part])
            seg = np.repeat(np.arange(len(part)), [len(data[i]) for i in part])
            vi = v[idx]
            s = sum_by(seg, vi, len(part))
            sq = np.bincount(seg, (vi * vi).sum(1), len(part))
            z = b + np.bincount(seg, w[idx], len(part)) + 0.5 * ((s * s).sum(1) - sq)
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * class_weight[part] / len(part)).astype(np.float32)
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, d[seg], len(used)).astype(np.float32) + decay * w[used]
            dv = d[seg][:, None] * (s[seg] - vi)
            dv = sum_by(back, dv, len(used)) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += float(d.sum()) ** 2
            w[used] -= rate * 2 * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            b -= np.float32(rate * d.sum() / np.sqrt(gb))
    return {"features": {int(t): i for i, t in enumerate(chosen)}, "w": w, "v": v, "b": float(b)}


def probability(model: dict, places: set[int]) -> float:
    z = model["b"]
    if z == -np.inf:
        return 0.0
    if places:
        i = np.fromiter(places, np.int64, len(places))
        v = model["v"][i]
        s = v.sum(0)
        z += float(model["w"][i].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def training_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, text_column: str) -> DataFrame:
    """doc_id, t, _y: slots of the bounded sample of labelled documents, 4 bytes a slot."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y")).where(may_learn)
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    part = [marked.where(F.col("_y") == c).orderBy(order, "doc_id").limit(MAX_PER_CLASS) for c in (0, 1)]
    # at most 2 * MAX_PER_CLASS rows of 12 bytes
    sample = F.broadcast(part[0].unionAll(part[1]))
    texts = docs.select("doc_id", F.col(text_column).alias("_text")).join(sample, "doc_id").select("doc_id", "_y", "_text")

    @tidy
    def run(batches):
        terms = Terms()
        for batch in batches:
            packed = [np.sort(np.fromiter(terms.of(t), np.uint32)).tobytes() for t in column_bytes(batch, "_text")]
            yield with_columns(batch, ["_text"], {"t": pa.array(packed, pa.binary())})

    slots = texts.mapInArrow(run, "doc_id bigint, _y int, t binary")
    # one text an identifier, so that repeated identifiers do not multiply the sample
    return slots.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "_y")).alias("x")).select("doc_id", "x.t", "x._y")


def fitted(rows: DataFrame) -> dict:
    """``fit`` over ``training_rows`` in one task, as their number is bounded; the driver gets the model alone, a row a slot."""

    @tidy
    def run(batches):
        found = sorted(((i, y, t) for batch in batches for i, y, t in zip(batch["doc_id"].to_pylist(), batch["_y"].to_pylist(), batch["t"].to_pylist(), strict=True)), key=lambda r: r[0])
        model = fit([(y, np.frombuffer(t, np.uint32)) for _, y, t in found])
        vectors = [b"", *(x.tobytes() for x in model["v"])]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model["features"]], pa.int64()), pa.array([model["b"], *model["w"].tolist()], pa.float64()), pa.array(vectors, pa.binary())], ["slot", "w", "v"])

    # the row of slot -1 has the intercept; the others come in the order of slots
    got = sorted(rows.repartition(1).mapInArrow(run, "slot bigint, w double, v binary").collect(), key=lambda r: r["slot"])
    slots = got[1:]
    return {
        "features": {r["slot"]: i for i, r in enumerate(slots)}, "w": np.array([r["w"] for r in slots], np.float32),
        "v": np.frombuffer(b"".join(r["v"] for r in slots), np.float32).reshape(len(slots), FACTORS), "b": got[0]["w"] if got else -np.inf,
    }


def learnable(column: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the identifier as text mod 5 not 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, text_column: str = "text") -> dict:
    bounded(docs.sparkSession)
    return fitted(training_rows(docs, labels, learnable(), text_column))


def score(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, from 0 to 1."""
    bounded(docs.sparkSession)
    docs = apart(docs, list(OUTPUT))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        model = sent.value
        terms = Terms(model["features"])
        for batch in batches:
            scores = [probability(model, terms.of(t)) for t in column_bytes(batch, text_column)]
            yield with_columns(batch, [], {"toxicity": pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, extended(docs, OUTPUT))


def op9_factorization_machine(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
