"""Every training-data operator against brute force on small tables with odd cases."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wheelwork.llm import chat, decontaminate, jaccard, licenses, packing, quality, registry, repeats, sharding, sstable, toxicity

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "conversations", "labels", "pages", "embeddings"]
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    """Ids (one null), texts: null, empty, blank, one word, copies, near copies, shared passages, very long, non-ASCII."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(120)]
    out = [None, "", " \t\n", "Word", "a b c", "Ünïcode 日本 <b> \\ </turn>\n"]
    out += [" ".join(base)] * 3
    for k in range(12):
        near = list(base)
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = word()
        out.append(" ".join(near))
    passage = " ".join(word() for _ in range(60))
    out += [" ".join(word() for _ in range(30)) + " " + passage + "\n" + " ".join(word() for _ in range(20)) for _ in range(5)]
    out += [" ".join(word() for _ in range(4000)), "aa " * 3000, "one two three four five six seven eight nine ten\n" * 3]
    out += [" ".join(word() for _ in range(40)) for _ in range(10)]
    pairs = [(i * 3, t) for i, t in enumerate(out)]
    rng.shuffle(pairs)
    return [*pairs, pairs[4], (None, "no identifier " * 20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id bigint, text string, shard string, score string, label int, spans string, items string, N_Words int, passes int, toxicity int"
    return spark.createDataFrame([(i, t, "x", None, None, "s", None, 1, 2, 3) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sstable(spark, docs, rows, empty, tmp_path):
    folder = "file://" + str(tmp_path / "t")
    manifest = sstable.write_tables(docs, folder, task_bytes=6000, table_bytes=2000)
    got = sstable.read_tables(manifest).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(sstable.default_path())
    want = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, *sorted(i for i, _ in rows if i is not None)]
    at = 0
    for r in ordered:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert r["start"] == at and ids in [v for (i, _), v in want.items() if i == r["doc_id"]]
        at += len(ids)
    readers = [sstable.Reader(open(r["path"].removeprefix("file://"), "rb")) for r in manifest.collect()]
    for i, t in rows:
        assert np.array(want[i, t], "<u2").tobytes() in [v for r in readers for v in r.get(i)]
    assert not any(r.get(10**9) for r in readers)
    assert sum(len(r.get(rows[4][0])) for r in readers) == 2
    assert sstable.read_tables(sstable.write_tables(empty, folder + "e")).count() == 0


def test_licenses(docs, rows, empty):
    assert len(licenses.rules()) > 200
    words = lambda t: licenses.words_of(t.encode())
    base, found = licenses.detect(words("Released UNDER the MIT License. Under Apache License, Version 2.0; licensed under CC-BY-NC 4.0 or under the mit license"))
    assert sorted(base) == [("apache-2", 6), ("cc-by-nc", 13), ("mit", 1), ("mit", 19)]
    assert {d[0] for d in found} == {"mit", "apache-2", "cc-by-nc"}
    for a, b in itertools.permutations(found, 2):
        assert not (b[1] <= a[1] and a[2] <= b[2] and b[3] >= a[3])
    assert [d[0] for d in licenses.detect(words("under the GNU General Public License, version 3"))[1]] == ["gpl-3"]
    assert licenses.detect(words("permit the summit license plate"))[0] == []
    out = licenses.scan(docs).collect()
    assert len(out) == len(rows) and "score_in" in out[0].asDict()
    assert collections.Counter(r["n_words"] for r in out) == collections.Counter(len(re.findall(WORDS, lower(t))) for _, t in rows)
    assert licenses.scan(empty).count() == 0


def alternatives(parsed):
    """Strings that a parsed pattern matches: every branch, first and last of a set, fewest and most repeats (at most 2)."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            part = [chr(arg)]
        elif name == "IN":
            part = [chr(c) for k, v in arg for c in (v if str(k) == "RANGE" else (v,))]
        elif name == "BRANCH":
            part = [s for b in arg[1] for s in alternatives(b)]
        elif name == "SUBPATTERN":
            part = alternatives(arg[-1])
        elif name == "MAX_REPEAT":
            part = sorted({s * n for n in {arg[0], min(arg[1], 2)} for s in alternatives(arg[2])})
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            part = [""]
        out = [a + b for a in out for b in part]
    return out


def test_every_license_alternative_opens_a_gate():
    words = b"licensed under creative commons attribution sharealike 4 0".split()
    assert [d[0] for d in licenses.detect(words)[1]] == ["cc-by-sa"]
    # phrases before a name are the same for all families and hold no gate: one of each is enough
    for _, label, gates, rx in licenses.rules():
        pattern = rx.pattern.replace(licenses.GRANT.encode(), b"licensed under ")
        for text in alternatives(re._parser.parse(pattern.decode())):
            assert any(" " + g.decode() in " " + text for g in gates), (label, text)


def test_sharding(docs, rows, empty, tmp_path):
    out = sharding.write_shards(docs, "file://" + str(tmp_path / "s"), n_shards=7, bucket_bytes=500)
    assert "shard_in" in out.columns
    got = out.select("doc_id", "text", "shard", "slot").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert sharding.shuffled(empty).count() == 0


def brute_hits(text, items):
    words, hit, found = re.findall(WORDS, lower(text)), set(), set()
    for i, t in items:
        w = re.findall(WORDS, lower(t))
        n = min(10, len(w))
        for win in {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else ():
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) == win:
                    hit.update(range(j, j + n))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    long = next(t for _, t in rows if t and len(t) > 400)
    items = [(1, " ".join(long.split()[5:30])), (2, "five six seven"), (2, "a B"), (3, None), (4, ""), (5, "aa " * 12), (6, " ".join(long.split()[40:49])), (6, " ".join(long.split()[40:49]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (100_000, 8):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        for r in decontaminate.decontaminate(docs, bench).collect():
            n, hits, found = brute_hits(r["text"], items)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hits, found), r["doc_id"]
            if r["clean_text"] is not None and hits:
                assert len(re.findall(WORDS, lower(r["clean_text"]))) == n - hits
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(docs, rows, empty):
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w, lines = re.findall(BLANKS, t), [x for x in t.split("\n") if re.search(BLANKS, x)]
        at = collections.defaultdict(list)
        for j in range(len(w) - 7):
            at[tuple(w[j : j + 8])].append(j)
        covered = {x for v in at.values() if len(v) > 1 for j in v for x in range(j, j + 8)}
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)] += 1
    out = quality.judge(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    assert "N_Words_in" in out[0].asDict()
    assert quality.judge(empty).count() == 0


def brute_repeats(rows):
    where = collections.defaultdict(lambda: None)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for j in range(len(b) - 49) if i is not None else ():
            w = b[j : j + 50]
            where[w] = i if where[w] is None else min(i, where[w])
    out = collections.Counter()
    for i, b in texts:
        mark = bytearray(len(b))
        for j in range(len(b) - 49) if i is not None else ():
            if where[b[j : j + 50]] < i:
                mark[j : j + 50] = b"\1" * 50
        out[i, len(b), sum(mark), bytes(x for x, m in zip(b, mark) if not m)] += 1
    return out


@pytest.mark.parametrize("portion", [4 << 20, 700])
def test_repeats(docs, rows, empty, monkeypatch, portion):
    monkeypatch.setattr(repeats, "PORTION", portion)
    out = repeats.without_repeats(docs).collect()
    got = collections.Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in out)
    assert got == brute_repeats(rows)
    if portion > 1000:
        assert repeats.without_repeats(empty).count() == 0


def test_chat(spark):
    probe = "\\### Assistant: </turn> ok \\0 \\1 <turn:x>"
    data = [(1, 0, "user", probe), (1, 1, "assistant", None), (1, 1, "assistant", probe), (2, None, None, ""), (None, 3, "assistant", "é日"), (1, 1, "assistant", probe)]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    out = {r["conv_id"]: r for r in chat.format_chat(turns).select("*", chat.parse_chat(F.col("formatted")).alias("back")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == [("user", probe), ("assistant", ""), ("assistant", probe), ("assistant", probe)]
    assert len(out[1]["loss"]) == 3 and len(out[None]["formatted"]) == sum((len("<turn:assistant>"), 2, len("</turn>\n")))
    s = out[None]["loss"][0]
    assert out[None]["formatted"][s["start"] : s["start"] + s["length"]] == "é日"
    parts = [("text", "see <", None, 0), ("image", None, "u1", 2), ("text", "and", None, 0), ("audio", None, "u2", 3), (None, "x", None, None)]
    typed = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    r = chat.format_chat(typed).first()
    assert r["formatted"] == "<turn:user>see \\1<image:1>and<audio:2>x</turn>\n"
    assert [(a["ordinal"], a["uri"], a["tokens"]) for a in r["attachments"]] == [(1, "u1", 512), (2, "u2", 75)] and r["expanded_tokens"] == 587
    assert chat.format_chat(turns.limit(0)).count() == 0

def test_chat_attachments_through_a_conversation(spark):
    image = lambda uri, n: ("image", None, uri, n)
    turns = [(1, 0, "user", [("text", "a <b>", None, 0), image("u1", 2)]), (1, 1, "assistant", [image("u2", None), ("text", "see", None, 0), ("audio", None, "u3", 3)]), (1, 2, "user", None), (1, 3, "user", [image("u1", 2)])]
    turns += [(2, k, "user", [image(f"v{k}", 1)] * 3) for k in range(400)]
    df = spark.createDataFrame([(*t, 7) for t in turns], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, ordinal int")
    out = {r["conv_id"]: r for r in chat.format_chat(df).select("*", chat.parse_parts(F.col("formatted"), F.col("attachments")).alias("back")).collect()}
    r = out[1]
    assert [(a["ordinal"], a["uri"], a["turn"], a["tokens"]) for a in r["attachments"]] == [(1, "u1", 0, 512), (2, "u2", 1, 256), (3, "u3", 1, 75), (4, "u1", 3, 512)]
    for a in r["attachments"]:
        mark = f"<{a['kind']}:{a['ordinal']}>"
        assert r["formatted"][a["offset"] : a["offset"] + len(mark)] == mark
    assert [[(p["kind"], p["text"], p["uri"], p["units"]) for p in t["parts"]] for t in r["back"]] == [
        [("text", "a <b>", None, None), ("image", None, "u1", 2)], [("image", None, "u2", None), ("text", "see", None, None), ("audio", None, "u3", 3)], [], [("image", None, "u1", 2)],
    ]
    assert r["expanded_tokens"] == 1355 and len(r["loss"]) == 1
    s = r["loss"][0]
    assert r["formatted"][s["start"] : s["start"] + s["length"]] == "<image:2>see<audio:3>"
    assert [a["ordinal"] for a in out[2]["attachments"]] == list(range(1, 1201)) and len(out[2]["back"]) == 400


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    want = collections.Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            want[i, at, tuple(ids[at : at + 1024]), len(ids)] += 1
    got, used = collections.Counter(), 0
    for s in packing.pack(docs).collect():
        ids, at = np.frombuffer(s["ids"], "<u2").tolist(), 0
        assert len(ids) == s["n_tokens"] <= 1024
        for p in s["pieces"]:
            assert p["offset"] == at
            got[p["doc_id"], p["start"], tuple(ids[at : at + p["length"]]), p["doc_tokens"]] += 1
            at += p["length"]
        used += 1
    assert got == want
    assert packing.pack(empty).count() == 0


def test_nnls_plan():
    rng = np.random.default_rng(2)
    histogram = {c: int(n) for c, n in enumerate(rng.integers(0, 400, 257)) if c and n}
    plan = packing.plan(histogram, 256)
    use = collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 256 and times > 0
        for c in pattern:
            use[c] += times
    assert use == histogram
    assert sum(t for _, t in plan) < 1.05 * sum(c * n for c, n in histogram.items()) / 256
    a = rng.random((6, 4))
    x = packing.nnls(a, a @ np.array([1.0, 0, 2, 0]))
    assert np.allclose(x, [1, 0, 2, 0], atol=1e-4)


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    data = []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic = i % 5 == 1
        if toxic:
            words[rng.randrange(40)] = rng.choice(["scumA", "scumB"])
            words[rng.randrange(40)] = rng.choice(["idiot", "moron"])
        data.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic").unionAll(table.select(F.lit(None).cast("bigint"), F.lit(1))))
    out = toxicity.score(table, model).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, table.select("doc_id", "toxic"))
    assert {r["toxicity"] for r in toxicity.score(docs, none).select("toxicity").collect()} == {0.0}


def brute_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(BLANKS, lower(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = list(range(len(sets)))
    linked = lambda a, b: a[0] is not None and b[0] is not None and a[1] and b[1] and den * len(a[1] & b[1]) >= num * len(a[1] | b[1])
    for x, y in itertools.combinations(range(len(sets)), 2):
        if linked(sets[x], sets[y]):
            old, new = root[y], root[x]
            root = [new if r == old else r for r in root]
    out = collections.Counter()
    for x, (i, s) in enumerate(sets):
        group = [sets[y][0] for y in range(len(sets)) if root[y] == root[x]]
        out[i, len(s), min(group) if i is not None else None] += 1
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard(docs, rows, empty, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard, "PORTION", 900)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = jaccard.near_duplicates(docs, k, num, den).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, k, num, den)
    if k == 4:
        assert jaccard.near_duplicates(empty, k, num, den).count() == 0


def test_jaccard_null_id_copy_first(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:100], "other", *words[101:]])
    data = [(None, " ".join(words)), (10, " ".join(words)), (20, near), (None, near), (30, "alone " * 9)]
    table = spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1)
    got = jaccard.near_duplicates(table, 4, 85, 100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(data, 4, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {10: 10, 20: 10, 30: 30}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, DATA), con.sql(registry.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else []
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "toxicity":
            assert len(before) > len(after) > 0.6 * len(before)
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, c in brute_components(before, 5, 4, 5) if i == c}
        if name == "suffix_array_dedup":
            assert {i: k.decode("utf-8", "ignore") for i, _, _, k in brute_repeats(before)} == after
        if name == "benchmark_decontamination":
            for i, t in before:
                n, hit, _ = brute_hits(t, items)
                assert (i in after) == (hit <= 0.5 * n)
                assert hit or after[i] == t
    assert {d for r in docs.select("doc_ids").collect() for d in r["doc_ids"]} == set(after)


LICENSE_LINES = [
    ("released under the GNU General Public License v3", "gpl-3"), ("Licensed under the Apache License v2.0", "apache-2"), ("This is released under GPLv3.", "gpl-3"), ("License: GPL-2.0-or-later", "gpl-2-or-later"),
    ("linked against an LGPLv2.1 library", "lgpl-2.1"), ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3-only"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "mit apache-2"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "gpl-2-only syscall-note"), ("// SPDX-License-Identifier: BSD-3-Clause AND ISC AND Zlib\nint x;", "bsd-3 isc zlib"), ("AGPL v3", "agpl-3"), ("MPLv2", "mpl-2"),
    ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("under GPL version 2 or any later version", "gpl-2-or-later"), ("Mozilla Public License, v. 2.0", "mpl-2"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
]


@pytest.mark.parametrize(("line", "labels"), LICENSE_LINES)
def test_license_versions_and_expressions(line, labels):
    from wheelwork.llm.words import words_of

    _, found = licenses.detect(words_of(line.encode()))
    assert set(labels.split()) <= {d[0] for d in found}
    assert not {d[0] for d in found} - set(labels.split()) - {"spdx", "spdx-choice", "spdx-all", "spdx-exception"}


def test_license_expression_ends_where_it_is_not_known():
    assert licenses.expression([b"mit", b"or", b"unheard", b"isc"], 0) == [("mit", 0, 1)]
    assert licenses.expression([], 0) == licenses.expression([b"mit"], 1) == []
    assert licenses.expression([b"gpl", b"2", b"0", b"or", b"later", b"or", b"mit"], 0) == [("gpl-2-or-later", 0, 5), ("mit", 6, 7)]
