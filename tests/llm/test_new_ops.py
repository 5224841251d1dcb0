"""Archives, infilling and clustering against brute force, on odd tables too."""

import base64
import gzip
import hashlib
import math
import random
import re

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from wheelwork.llm import infill, lloyd, registry, warc

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute_infill(identifier, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if identifier is None else identifier}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [None, "", "a", "<", "<P", "<P>", "x<S>y", "é日本", "<M <PS> >", "word " * 500, "a" * 3000, "é" * 700, "<" * 300, "ab<" + "P>" * 40]
    out += ["".join(rng.choice("aZé<PSM> \n日") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return [(None if i % 9 == 8 else i - 5, t) for i, t in enumerate(out)] + [(3, "again and again")] * 3


@pytest.mark.parametrize(("chunk", "giant"), [(1 << 18, 1 << 20), (7, 1 << 20), (5, 40), (1, 0)])
def test_infill(spark, texts, chunk, giant):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id bigint, text string, N int").repartition(3)
    out = infill.fill_in_middle(docs, chunk_bytes=chunk, giant_bytes=giant)
    assert out.columns == ["doc_id", "text", "N_in", *infill.OUTPUT]
    got = {r["N_in"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()}
    assert got == {k: brute_infill(i, t) for k, (i, t) in enumerate(texts)}
    for k, (_, t) in enumerate(texts):
        assert infill.restored(got[k][4].encode(), got[k][1]).decode() == (t or "")


def test_infill_composes():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aP<>S é") for _ in range(rng.randint(0, 30))).encode()
        parts = infill.chunks(text, rng.randint(1, 8))
        assert b"".join(parts) == text
        functions = [infill.scan(x) for x in parts]
        left = right = infill.scan(b"")
        for f in functions:
            left = infill.then(left, f)
        for f in reversed(functions):
            right = infill.then(f, right)
        assert (left == right).all() and (left == infill.scan(text)).all()


def test_infill_empty(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    bodies = [None, "", "<p>one</p>", "<p>zwei é</p>", "x" * 20000, "\r\n\r\nHTTP/1.1 500"]
    rows = [(rng.choice([None, *range(-5, 60)]), rng.choice([None, "http://a/é b?%20=%25", "urn:page:7", f"http://h/{i}"]), rng.choice(bodies) if i % 2 else f"body {i} " * rng.randint(1, 60)) for i in range(150)]
    return [*rows, *rows[:4], rows[1], rows[1]]


def brute_archive(pages, least):
    groups = {}
    for k, (i, url, html) in enumerate(pages):
        groups.setdefault((html or "").encode(), []).append((i is None, i or 0, url is None, url or "", k))
    out = []
    for payload, rows in groups.items():
        for place, (none, i, *_, k) in enumerate(sorted(rows)):
            first = place == 0 or len(payload) < least
            of = None if first or min(rows)[0] else min(rows)[1]
            out.append((None if none else i, pages[k][1], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", of))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 15])
def test_archives(spark, pages, tmp_path, least):
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, digest string")
    manifest = warc.write_archives(df.repartition(3), f"file://{tmp_path}/a", least_bytes=least, shard_bytes=20_000, file_bytes=2_000)
    back = warc.read_archives(manifest, payload=True).collect()
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back]
    # an address that is the identifier's own stands for none
    want = [(i, None if url == f"urn:page:{'' if i is None else i}" else url, *rest) for i, url, *rest in brute_archive(pages, least)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r["record_id"] for r in back}) == len(back)
    assert {r["payload"] for r in back if r["record_type"] == "response"} == {(h or "").encode() for *_, h in pages}
    listed = manifest.collect()
    assert len({r["shard"] for r in listed}) > 2 and any(r["part"] for r in listed)
    for r in listed:
        data = open(r["path"].removeprefix("file://"), "rb").read()
        assert len(data) == r["n_bytes"] and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type:") == r["n_records"] + 1
    files = pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(f"{tmp_path}/a"))
    assert not [f.path for f in files if f.path.endswith(".tmp")]


def test_archives_do_not_depend_on_partitions(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    facts = []
    for k, n in enumerate((1, 5, 11)):
        manifest = warc.write_archives(df.repartition(n), f"file://{tmp_path}/{k}", shard_bytes=20_000, file_bytes=2_000)
        facts.append(sorted((r["path"].rsplit("/", 1)[1], r["n_records"], r["crc32"]) for r in manifest.collect()))
    assert facts[0] == facts[1] == facts[2]


def test_archives_damage_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "body" * 50) for i in range(5)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(df, f"file://{tmp_path}/a")
    path = manifest.first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception, match="record|committed"):
        warc.read_archives(manifest).count()
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def brute_lloyd(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    means = [v for _, v in order[:k]]
    squared = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for step in range(rounds + 1):
        owner = [min((squared(v, c), j) for j, c in enumerate(means)) for _, v in kept]
        if step < rounds:
            for j in range(len(means)):
                own = [v for (_, v), (_, o) in zip(kept, owner, strict=True) if o == j]
                if own:
                    means[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in owner)
    return sorted((i, j, d, sum(e for e, o in owner if o == j), total, hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, owner, strict=True))


@pytest.mark.parametrize("n", [0, 7, 260])
def test_op13(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in (middles[i % 5] + rng.normal(size=64) * (0.01 if i % 2 else 0.5)).astype(np.float32)]) for i in range(n)]
    if n:
        rows += [(1000 + i, rows[0][1]) for i in range(30)]
        rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64)]
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["op13_dual_tree_lloyd"](spark, str(tmp_path))
    got = sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect())
    assert got == brute_lloyd(rows, 40, 5)


def test_dual_tree_ties_and_pruning():
    rng = np.random.default_rng(5)
    for scale, dim in ((2, 3), (300, 8), (1 << 20, 4)):
        rows = rng.integers(-scale, scale, (700, dim))
        rows[100:300] = rows[0]
        means = rows[rng.choice(700, 30)]
        tree = lloyd.Tree(rows, lloyd.LEAF_ROWS)
        # covering: each vector within its node's radius; children lie in their parent's range
        for v in range(len(tree.lo)):
            below = rows[tree.order[tree.lo[v] : tree.hi[v]]]
            assert np.sqrt(((below - rows[tree.centre[v]]) ** 2).sum(1)).max() <= tree.radius[v] * (1 + 1e-12)
        block = lloyd.Block(rows[tree.order], tree.packed())
        owner, squared, compared = lloyd.nearest(block, means, lloyd.Tree(means, lloyd.CENTROID_LEAF))
        away = ((block.vectors[:, None] - means[None]) ** 2).sum(2)
        assert (owner == away.argmin(1)).all() and (squared == away.min(1)).all()
        assert compared < away.size


def test_too_large_components(spark):
    wide = spark.createDataFrame([(1, [1e9, 0.0])], "id bigint, v array<double>").select("id", lloyd.scaled(F.col("v"), 2).alias("v"))
    with pytest.raises(Exception, match="beyond"):
        lloyd.lloyd(wide, k=1, rounds=1)
