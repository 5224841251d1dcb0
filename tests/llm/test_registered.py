"""The registered queries, as they are, against brute force over a small table with odd cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from test_ops import brute_components, brute_repeats, lower
from wheelwork.llm import bpe, licenses, packing, registry, sharding, toxicity

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(150), prose(70)
    texts = [None, "", "one", base, base, base + " more", passage + "\n" + prose(30), prose(20) + " " + passage, prose(3000), "aa " * 2000]
    texts += ["Use it under the MIT License. Apache License, Version 2.0; CC-BY-NC 4.0 under the mit license", "special <|endoftext|> token <|endoftext|>", "日本語 the end.", "x" * 5000]
    texts += [prose(40) for _ in range(20)]
    ids = rng.sample(range(-50, 10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{top}/documents.parquet")
    marks = [(i, int(k % 4 == 0)) for k, (i, _) in enumerate(rows)]
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    return {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def run(spark, folder, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, folder).collect()]


def test_op1(spark, folder, ids):
    want, at = [], 0
    for i in sorted(ids):
        own = [*ids[i], 2]
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert 50256 in itertools.chain(*ids.values())
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op1_sstable_ids")) == want


def test_op2(spark, folder, rows):
    want = {}
    for i, t in rows:
        words = re.findall(WORDS, lower(t))
        places = [(k, label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want[i] = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
    out = run(spark, folder, "op2_license_rules")
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out} == want
    assert sum(r["n_base"] for r in out) == 4
    for r in out:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op2_containment_by_brute_force():
    rng = random.Random(4)
    words = b"licensed under the apache mit license version 2 0 3 gnu general public cc by nc sa creative commons terms of see spdx identifier or and all rights reserved x".split()
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        joined = b" " + b" ".join(text) + b" "
        every = []
        for k, (p, label, gates, rx) in enumerate(licenses.rules()):
            if any(b" " + g in joined for g in gates):
                for m in rx.finditer(joined):
                    first = joined.count(b" ", 0, m.start()) - 1
                    every.append((-p, m.start() - m.end(), first, k, label, first + m[0].count(b" ") + 1))
        kept = []
        for p, _, first, _, label, end in sorted(every):
            if not any(a <= first and end <= b for _, a, b, _ in kept):
                kept.append((label, first, end, -p))
        assert licenses.detect(text)[1] == sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def test_op3(spark, folder, rows):
    out = run(spark, folder, "op3_two_pass_shuffle")
    data = {i: (t or "").encode() for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out} == {i: (len(b) + 8, zlib.crc32(b), "rows", None) for i, b in data.items()}
    sizes = collections.Counter(r["shard"] for r in out)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_op3_seed_decides(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    places = lambda df, **o: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(df, 5, bucket_bytes=200, **o).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    one = places(docs)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert places(docs.repartition(5)) == one
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert places(docs, seed=18) != one


def test_op3_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_EQUAL", 10)
    same = spark.range(600).selectExpr("cast(null as bigint) AS doc_id", "cast(null as string) AS text").repartition(4)
    out = sharding.shuffled(same, 6, bucket_bytes=64).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(6) for k in range(100)]
    assert max(collections.Counter(r["bucket"] for r in out).values()) < 30


def test_op3_order_of_equal_rows_does_not_depend_on_partitions(spark, tmp_path):
    same = spark.range(2500).selectExpr("7L AS doc_id", "'equal' AS text")
    other = spark.range(1500).selectExpr("id + 100 AS doc_id", "concat('text ', id) AS text")
    same.unionByName(other).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    places = lambda df: sorted((r["shard"], r["slot"], r["bucket"], r["text"]) for r in sharding.shuffled(df, 6, bucket_bytes=4000).collect())
    one, before = places(docs), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", "11k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert places(docs) == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert places(docs.repartition(7, "text")) == one == places(docs.orderBy(docs.doc_id.desc()))
    assert sum(t == "equal" for *_, t in one) == 2500 and len(one) == 4000


def test_op6(spark, folder, rows):
    want = collections.Counter()
    for (i, n, gone, kept), c in brute_repeats(rows).items():
        want[i, n, gone, hashlib.sha256(kept).hexdigest()] += c
    out = run(spark, folder, "op6_prefix_free_parsing")
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in out) == want
    assert any(r["n_spans"] for r in out) and all((r["n_spans"] > 0) == (r["n_removed"] > 0) for r in out)


def test_op8(spark, folder, ids):
    out = run(spark, folder, "op8_nnls_packing")
    by = collections.defaultdict(list)
    for r in out:
        own = [*ids[r["doc_id"]], 0]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        by[r["doc_id"]].append((r["start"], r["length"]))
    for i, pieces in by.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(ids[i]) + 1
    assert set(by) == set(ids)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024


def test_special_tokens_and_random_texts_as_the_library(rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(5)
    pieces = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", ", ", ". ", "word", "Ünï", "日本", "123", "\t", "\x01", "\x02", "'s", "!?", "é."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for special in (False, True):
        tok = Tokenizer.from_file(bpe.default_path())
        tok.encode_special_tokens = special
        got = bpe.Encoder(bpe.default_path(), special).encode(pa.array(texts))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizer_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_op9(spark, folder, rows):
    out = run(spark, folder, "op9_factorization_machine")
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op9_learns_what_only_pairs_tell():
    """Toxic exactly if insult and group stand both or neither: each alone tells nothing."""

    def made(n, seed):
        rng, out = random.Random(seed), []
        for _ in range(n):
            words = [f"w{rng.randrange(300)}" for _ in range(30)]
            a, b = rng.random() < 0.5, rng.random() < 0.5
            if a:
                words[0] = f"insult{rng.randrange(4)}"
            if b:
                words[1] = f"group{rng.randrange(4)}"
            out.append((int(a == b), " ".join(words).encode()))
        return out

    train, test = made(3200, 1), made(800, 2)
    slots = [(y, np.sort(np.fromiter(toxicity.Terms().of(t), np.uint32))) for y, t in train]

    def right(model):
        terms = toxicity.Terms(model["features"])
        return np.mean([(toxicity.probability(model, terms.of(t)) >= 0.5) == bool(y) for y, t in test])

    model = toxicity.fit(slots)
    assert right(model) >= 0.9
    assert right(toxicity.fit(slots, factors=0)) < 0.6
    terms = toxicity.Terms(model["features"])
    for _, t in test[:50]:  # pair by pair
        places = sorted(terms.of(t))
        z = model["b"] + sum(float(model["w"][i]) for i in places) + sum(float(model["v"][i] @ model["v"][j]) for i, j in itertools.combinations(places, 2))
        assert abs(toxicity.probability(model, set(places)) - 1 / (1 + np.exp(-z))) < 1e-3


def test_op10(spark, folder, rows):
    out = run(spark, folder, "op10_vertical_jaccard")
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, 4, 85, 100)


def test_packing_nnls_stops_whole():
    histogram = {c: 10 + c % 7 for c in range(1, 257)}
    use = collections.Counter()
    for pattern, times in packing.plan(histogram, 256):
        for c in pattern:
            use[c] += times
    assert use == histogram
