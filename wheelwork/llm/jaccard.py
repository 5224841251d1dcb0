r"""N-gram Jaccard join by vertical partitioning.

The n-grams (word shingles) of all documents have one global order. It is cut into
fragments; overlaps are counted in each fragment separately and summed per pair:

1. **Cut.** Each document's shingle set is hashed; a portion of documents sends each
   distinct shingle once, with its frequency there, to the range of its hash. A range
   sums the frequencies and sends back those of shingles that two documents have. Only
   these can add to an overlap. A document with fewer of them than the threshold asks of
   its own size links with none and goes no further.
2. **Prefix.** In the order rarest first a document can only link with one that shares
   one of its first n - ceil(t n) + 1 shingles; unshared ones come first and use up
   most of it.
3. **Count.** Pairs that share a prefix shingle are counted fragment by fragment
   (``FRAGMENTS`` ranges of the hash), partial overlaps are summed, and the sum decides.
   Documents with equal sets are one class from the start. Pairs of one posting list
   are tested in rounds, each document against one leader, the one with the fewest
   unshared shingles; then all pairs that are not yet in one component and whose sizes
   and places of the shared shingle in both orders still allow a link. So a group of n near copies costs some n pairs, and no link
   between components is missed.

Exact up to the 48-bit hash of a shingle. Links of classes inside one component are not
all listed: the result is the component of each document.

Cases: a null text is empty; an empty set links with nothing; rows with a null
identifier or an empty set are components of their own; rows with one identifier and
different texts are looked at one by one; equal rows are in one component; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import bounded, buckets_for, drop_written, spread, text_bytes, tidy, written
from wheelwork.llm.packed import groups, pack, record, small, unpack
from wheelwork.llm.shingles import set_digests, shingle_sets
from wheelwork.llm.words import column_bytes
from wheelwork.operators.components import stars

#: Ranges of the global order in which overlaps are counted.
FRAGMENTS = 8
#: Rounds in which each document is compared with one leader, before the rest of the pairs.
ROUNDS = 3
#: Documents of a block in the last comparison of small components with large ones.
BLOCK = 100
#: Text per portion of documents in a task and per range of the first cut; both grow with the root of the table.
PORTION, RANGE = 8 << 20, 32 << 20
CUT = "range bigint, portion bigint, data binary"
NAMES, KINDS = ["range", "portion", "data"], [pa.int64(), pa.int64(), pa.binary()]
DOCS = "doc_id bigint, d1 bigint, d2 bigint, n bigint, shared binary"
#: Documents in a portion at most, before it grows.
MOST_DOCS = 60_000
_HASH_BITS = 48


def _low(r: int, n_ranges: int) -> np.uint64:
    """The least hash of a range."""
    return np.uint64(r * (1 << _HASH_BITS) // n_ranges)


def _cut(docs: DataFrame, k: int, n_ranges: int, portion_bytes: int, most_docs: int) -> DataFrame:
    """Distinct shingles of portions of documents with their frequency there, by range; range -1 has the portion's documents."""

    def emit(portion: int, ids: list[int], texts: list[bytes]):
        sizes, sets = shingle_sets(texts, k)
        d1, d2 = set_digests(sizes, sets)
        known = np.array([i is not None for i in ids], "u1")
        first: dict[tuple[int, int], int] = {}
        # rows without an identifier send nothing: they link with none, and must not stand for one that does
        own = [ids[i] is not None and first.setdefault(d, i) == i for i, d in enumerate(zip(d1.tolist(), d2.tolist(), strict=True))]
        place = np.repeat(np.arange(len(ids), dtype="<u2" if len(ids) < 1 << 16 else "<u4"), sizes)
        keep = np.repeat(np.array(own, bool), sizes)
        sets, place = sets[keep], place[keep]
        order = np.argsort(sets)
        sets, place = sets[order], place[order]
        new = np.ones(len(sets), bool)
        new[1:] = sets[1:] != sets[:-1]
        yield -1, portion, pack(np.array([i or 0 for i in ids], "<i8"), known, d1, d2, sizes, place, np.packbits(new))
        at = np.flatnonzero(new)
        one, times = sets[at], np.minimum(np.diff(at, append=len(sets)), 255).astype("u1")
        edge = np.searchsorted(one, np.array([_low(r, n_ranges) for r in range(n_ranges + 1)]))
        for r in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            part = slice(edge[r], edge[r + 1])
            yield r, portion, pack(edge[r : r + 1].astype("<i8"), small(np.diff(one[part], prepend=_low(r, n_ranges))), times[part])

    @tidy
    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= portion_bytes or len(ids) >= most_docs:
                    yield record(emit((task << 24) + n, ids, texts), NAMES, KINDS)
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield record(emit((task << 24) + n, ids, texts), NAMES, KINDS)

    return docs.mapInArrow(run, CUT)


def _shared(cut: DataFrame, n_ranges: int, n_parts: int) -> DataFrame:
    """Per range and portion: the shingles that two documents or more have, with their frequency.

    A portion sends a shingle once however many of its documents have it, so the list of
    a shingle that all documents share is as long as there are portions.
    """

    def reduce_range(rows: list[dict]):
        if rows[0]["range"] < 0:
            yield from ((-1, r["portion"], r["data"]) for r in rows)
            return
        low = _low(rows[0]["range"], n_ranges)
        firsts, hashes, times = [], [], []
        for r in rows:
            (first,), gaps, count = unpack(r["data"])
            firsts.append(first)
            hashes.append(low + np.cumsum(gaps.astype(np.uint64)))
            times.append(count)
        size = [len(x) for x in hashes]
        h, times = np.concatenate(hashes), np.concatenate(times).astype(np.int64)
        order = np.argsort(h)
        edge = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        total = np.empty(len(h), np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order], edge), np.diff(edge, append=len(h)))
        past = np.cumsum(size)
        for r, first, n, end in zip(rows, firsts, size, past.tolist(), strict=True):
            at = np.flatnonzero(total[end - n : end] > 1)
            if len(at):
                mine = at + end - n
                yield r["range"], r["portion"], pack((first + at).astype("<u4"), small(np.diff(h[mine], prepend=low)), np.minimum(total[mine], (1 << 32) - 1).astype("<u4"))

    @tidy
    def run(batches):
        for group in groups(batches, "range"):
            if out := list(reduce_range(group)):
                yield record(out, NAMES, KINDS)

    # rows of documents are dealt by portion, all others by range
    return cut.repartition(n_parts, "range", F.when(F.col("range") < 0, F.col("portion"))).sortWithinPartitions("range", "portion").mapInArrow(run, CUT)


def _documents(shared: DataFrame, n_ranges: int, n_parts: int, num: int, den: int) -> DataFrame:
    """A row per document; ``shared`` holds its shared shingles rarest first, if they can suffice for a link."""

    @tidy
    def run(batches):
        names, kinds = ["doc_id", "d1", "d2", "n", "shared"], [pa.int64()] * 4 + [pa.binary()]
        for group in groups(batches, "portion"):
            ids, known, d1, d2, n, place, new = next(unpack(r["data"]) for r in group if r["range"] < 0)
            ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
            packed: list[bytes | None] = [None] * len(ids)
            parts = [(_low(r["range"], n_ranges), *unpack(r["data"])) for r in group if r["range"] >= 0]
            if parts:
                which = np.cumsum(np.unpackbits(new, count=len(place)).astype(bool)) - 1
                h, count = np.zeros(int(which[-1]) + 1, np.uint64), np.zeros(int(which[-1]) + 1, "<u4")
                for low, at, gaps, total in parts:
                    h[at], count[at] = low + np.cumsum(gaps.astype(np.uint64)), total
                common = count[which] > 0
                place, which = place[common], which[common]
                have = np.bincount(place, minlength=len(ids))
                # a link needs overlap >= t * union >= t * own size
                keep = (have * den >= num * n)[place]
                place, which = place[keep], which[keep]
                h, count = h[which], count[which]
                order = np.lexsort((h, count, place))
                h, place = h[order], place[order]
                at = np.searchsorted(place, np.arange(len(ids) + 1))
                for i in np.flatnonzero(at[1:] > at[:-1]):
                    packed[i] = h[at[i] : at[i + 1]].astype("<i8").tobytes()
            for lo in range(0, len(ids), 4096):
                rows = zip(ids[lo : lo + 4096], d1[lo : lo + 4096].view("<i8").tolist(), d2[lo : lo + 4096].view("<i8").tolist(), n[lo : lo + 4096].tolist(), packed[lo : lo + 4096], strict=True)
                yield record(rows, names, kinds)

    return shared.repartition(n_parts, "portion").sortWithinPartitions("portion", "range").mapInArrow(run, DOCS)


def _unpacked(classes: DataFrame, num: int, den: int) -> DataFrame:
    """root, n, spare (unshared), and shared shingles as arrays: by fragment and as prefix."""

    @tidy
    def run(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            fragments, prefix, spare = [], [], []
            for n, data in zip(b.column("n").to_pylist(), b.column("shared").to_pylist(), strict=True):
                h = np.frombuffer(data, "<i8")
                s = n - len(h)
                f = h // ((1 << _HASH_BITS) // FRAGMENTS + 1)
                order = np.argsort(f, kind="stable")
                at = np.searchsorted(f[order], np.arange(FRAGMENTS + 1))
                fragments.append([{"f": int(i), "h": h[order[at[i] : at[i + 1]]]} for i in np.flatnonzero(at[1:] > at[:-1])])
                length = n - -(-num * n // den) + 1
                prefix.append(h[: max(0, length - s)])
                spare.append(s)
            yield pa.RecordBatch.from_arrays(
                [b.column("root"), b.column("n"), pa.array(spare, pa.int64()), pa.array(prefix, longs), pa.array(fragments, pa.list_(pa.struct([("f", pa.int32()), ("h", longs)])))],
                ["root", "n", "spare", "prefix", "fragments"],
            )

    return classes.mapInArrow(run, "root bigint, n bigint, spare bigint, prefix array<bigint>, fragments array<struct<f:int,h:array<bigint>>>")


def _possible(num: int, den: int) -> Column:
    """Whether sizes and unshared shingles of a and b still allow a link."""
    most = F.least(F.col("an") - F.col("aspare"), F.col("bn") - F.col("bspare"))
    return most * den >= (F.col("an") + F.col("bn") - most) * num


def _possible_from(num: int, den: int) -> Column:
    """Whether a link is possible if the shingle at places ``aat`` and ``bat`` of the order is the first that a and b share."""
    most = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat"))
    return most * den >= (F.col("an") + F.col("bn") - most) * num


def _counted(pairs: DataFrame, fragments: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, an, bn) that link: partial overlaps per fragment, summed."""
    one = fragments.select(F.col("root").alias("a"), "f", F.col("h").alias("ah"))
    two = fragments.select(F.col("root").alias("b"), F.col("f").alias("g"), F.col("h").alias("bh"))
    partial = pairs.join(one, "a").join(two, (pairs["b"] == two["b"]) & (F.col("f") == F.col("g"))).select("a", pairs["b"], "an", "bn", F.size(F.array_intersect("ah", "bh")).alias("part"))
    total = partial.groupBy("a", "b", "an", "bn").agg(F.sum("part").alias("x"))
    return total.where(F.col("x") * den >= (F.col("an") + F.col("bn") - F.col("x")) * num).select("a", "b")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, an, bn) with a < b, from columns a, an, b, bn in any order."""
    left, right = F.struct(F.col("a").alias("r"), F.col("an").alias("n")), F.struct(F.col("b").alias("r"), F.col("bn").alias("n"))
    both = rows.select(F.least(left, right).alias("x"), F.greatest(left, right).alias("y")).distinct()
    return both.select(F.col("x.r").alias("a"), F.col("y.r").alias("b"), F.col("x.n").alias("an"), F.col("y.n").alias("bn"))


def _labelled(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    """Postings with the label of their component."""
    if links is None:
        return postings.withColumn("label", F.col("root"))
    roots = stars(links, "a", "b").select(F.col("node").alias("root"), F.col("component").alias("label"))
    return postings.join(roots, "root", "left").withColumn("label", F.coalesce("label", "root"))


def _links(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between classes that span each component, and the written tables that they are read from."""
    sets = written(_unpacked(classes, num, den), "sets")
    fragments = written(sets.select("root", F.explode("fragments").alias("x")).select("root", "x.f", "x.h"), "fragments")
    every = sets.where(F.size("prefix") > 0).select("root", "n", "spare", F.posexplode("prefix").alias("at", "h")).withColumn("at", F.col("at") + F.col("spare"))
    several = every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    postings = written(every.join(several, "h"), "postings")
    links, tested, used = None, None, [sets, fragments, postings]
    for _ in range(ROUNDS):
        # each document with one leader: the most central one in its lists that is in another component
        labelled = _labelled(postings, links)
        central = F.struct((F.col("spare") / F.col("n")).alias("s"), "root", "n", "spare", "label")
        leads = labelled.groupBy("h", "label").agg(F.min(central).alias("lead")).groupBy("h").agg(F.count("*").alias("k"), F.min("lead").alias("lead")).where("k > 1").select("h", "lead")
        led = labelled.join(leads, "h").where("label <> lead.label")
        led = led.select(F.col("root").alias("a"), F.col("n").alias("an"), F.col("spare").alias("aspare"), F.col("lead.root").alias("b"), F.col("lead.n").alias("bn"), F.col("lead.spare").alias("bspare"), (F.col("lead.s")).alias("s")).where(_possible(num, den))
        if tested is not None:
            done = tested.select("a", "b").unionAll(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            led = led.join(done, ["a", "b"], "left_anti")
        one = led.groupBy("a", "an").agg(F.min(F.struct("s", "b", "bn")).alias("m")).select("a", "an", F.col("m.b").alias("b"), F.col("m.bn").alias("bn"))
        pairs = written(_ordered(one), "pairs")
        found = written(_counted(pairs, fragments, num, den), "found")
        used += [pairs, found]
        tested, links = (pairs if tested is None else tested.unionAll(pairs)), (found if links is None else links.unionAll(found))
    # posting lists that still hold several components: the small ones against all others
    labelled = _labelled(postings, links)
    sizes = labelled.groupBy("h", "label").count().groupBy("h").agg(F.count("*").alias("k"), F.max(F.struct("count", "label")).alias("top")).where("k > 1")
    open_lists = written(labelled.join(sizes.select("h", F.col("top.label").alias("main")), "h"), "open")
    small, main = open_lists.where("label <> main"), open_lists.where("label = main")
    one = small.select("h", F.col("root").alias("a"), F.col("n").alias("an"), F.col("at").alias("aat"), F.col("label").alias("alabel"))
    two = small.select("h", F.col("root").alias("b"), F.col("n").alias("bn"), F.col("at").alias("bat"), F.col("label").alias("blabel"))
    # a pair is made where it first shares a shingle, so later places of the two may say no
    more = _ordered(one.join(two, "h").where((F.col("alabel") != F.col("blabel")) & (F.col("a") < F.col("b")) & _possible_from(num, den)))
    pairs = written(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    late = _counted(pairs, fragments, num, den)
    return links.unionAll(late).unionAll(_against_main(main.select("main", "root", "n", "spare").distinct(), small.select("main", "root", "n", "spare").distinct(), classes.select("root", "shared"), num, den)), [*used, open_lists, pairs]


def _against_main(main: DataFrame, small: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """A link (a, b) of each document of ``small`` to its list's main component, if it has any.

    Both sides are cut into blocks of about ``BLOCK`` documents; a task counts the
    overlaps of two blocks, fragment by fragment, so no task holds a whole group.
    """
    blocks = lambda rows, name: rows.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = blocks(main, "ni").join(blocks(small, "nj"), "main")
    own = lambda n: F.pmod(F.xxhash64(F.lit(3), "root"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = main.join(counts, "main").select("main", "root", "n", "spare", F.lit(0).alias("side"), own("ni").alias("i"), every("nj").alias("j"))
    right = small.join(counts, "main").select("main", "root", "n", "spare", F.lit(1).alias("side"), every("ni").alias("i"), own("nj").alias("j"))
    rows = left.unionAll(right).join(shared, "root")

    def count(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        root, n, spare, data = (table.column(c).to_pylist() for c in ("root", "n", "spare", "shared"))
        many, few = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        if len(many) and len(few):
            sets = [np.frombuffer(data[k], "<i8") for k in many]
            h, doc = np.concatenate(sets), np.repeat(np.arange(len(many)), [len(x) for x in sets])
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            size, free = np.array([n[k] for k in many]), np.array([spare[k] for k in many])
            width = (1 << _HASH_BITS) // FRAGMENTS + 1
            cuts = np.searchsorted(h, np.arange(FRAGMENTS + 1) * width)
            for k in few:
                most = np.minimum(size - free, n[k] - spare[k])
                if not (most * den >= (size + n[k] - most) * num).any():
                    continue
                own_set = np.sort(np.frombuffer(data[k], "<i8"))
                mine = np.searchsorted(own_set, np.arange(FRAGMENTS + 1) * width)
                x = np.zeros(len(many), np.int64)
                for f in range(FRAGMENTS):
                    part, place = h[cuts[f] : cuts[f + 1]], doc[cuts[f] : cuts[f + 1]]
                    x += np.bincount(place[np.isin(part, own_set[mine[f] : mine[f + 1]])], minlength=len(many))
                hit = np.flatnonzero(x * den >= (size + n[k] - x) * num)
                if len(hit):
                    out.append((root[k], root[many[hit[0]]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("main", "i", "j").applyInArrow(count, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Two documents link when overlap / union of their sets of k-word shingles is at
    least num / den; component_id is the smallest identifier reachable by links.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    bounded(docs.sparkSession)
    total = text_bytes(rows)
    portion_bytes, range_bytes = spread(total, PORTION, RANGE)
    n_ranges = buckets_for(total, range_bytes)
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(total, range_bytes, least=1))
    cut = _cut(rows, k, n_ranges, portion_bytes, MOST_DOCS * portion_bytes // PORTION)
    table = written(_documents(_shared(cut, n_ranges, n_parts), n_ranges, n_parts, num, den), "documents")
    known = table.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("shared", ignorenulls=True).alias("shared")), "classes")
    # classes are known by their least identifier and, where one identifier has several texts, a digest
    links, used = _links(classes.where("shared IS NOT NULL").select(F.col("d1").alias("root"), "n", "shared"), num, den)
    roots = stars(links, "a", "b")
    drop_written(*used)
    rooted = classes.select("d1", "d2", "least").join(roots.select(F.col("node").alias("d1"), F.col("component").alias("root")), "d1", "left").withColumn("root", F.coalesce("root", "d1"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(least, "root").select("d1", "d2", "component_id")
    return (
        table.select("doc_id", "n", "d1", "d2").join(placed, ["d1", "d2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op10_vertical_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
, s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))) END AS sh FROM w)
, h AS MATERIALIZED (SELECT r, len(sh) AS n, unnest(sh) AS x FROM s WHERE doc_id IS NOT NULL)
, links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM h a JOIN h b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*)))
, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links)
, c(node, root) USING KEY (node) AS (SELECT r, doc_id FROM s UNION SELECT e.b, min(c.root) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS k ON k.node = e.b WHERE c.root < k.root GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, root AS component_id FROM s JOIN c ON node = r
"""
