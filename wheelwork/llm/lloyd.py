r"""Exact Lloyd clustering of integer vectors by dual trees.

Vectors are kept in blocks of ``BLOCK_ROWS`` rows, one block a row of a table in the shared
folder, made where the vectors are read (no shuffle). Over a block stands a cover tree,
built once: a node is a centre vector, the greatest distance from it to any vector below,
and a contiguous range of the block; its children cover the range at that distance over ``BASE`` and
their centres lie further apart than that. Every round builds such a tree over the
centroids too and goes down both at once: a pair (node of vectors, node of centroids) is
dropped if nothing below it can be nearest, as the triangle inequality says from the centres'
distance and both radii. Pairs of leaves are compared exactly. A round returns, per
centroid, the sum and count of its vectors; Spark adds those up, and only they reach the driver
(centroids times components, bounded by parameters).

All arithmetic that decides is on whole numbers: bounds are loosened by a part in 10^9, so
rounding cannot drop the nearest or one that ties with it, and ties go to the smaller number.

Cases: vectors that are null, of another length, or hold a null, NaN or infinity are left
out; a null identifier hashes as the empty string; of vectors with equal hashes those with smaller
components come first; repeated rows count each time (equal vectors form one leaf of radius
0); fewer vectors than centroids give that many centroids; an empty table gives no rows; columns
other than the identifier and the vector are ignored. A component beyond 2^27 in
size after scaling is an error: squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelwork.llm.common import bounded, drop_written, tidy, written
from wheelwork.llm.packed import pack, unpack

BLOCK_ROWS, LEAF_ROWS, CENTROID_LEAF = 2048, 16, 2
#: Radius of a node over that of its children.
BASE = 1.3
LARGEST = 1 << 27
#: Pairs of a vector and a centroid compared at once.
AT_ONCE = 1 << 14


def scaled(vector: Column, dim: int, scale: int = 256) -> Column:
    """floor(scale * x) of each component as longs, or null for a vector that is not kept."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) == dim) & finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class Tree:
    """A cover tree over the rows of an integer matrix; ``order`` puts the rows into its ranges."""

    def __init__(self, rows: np.ndarray, leaf: int):
        self.order = np.arange(len(rows))
        self.lo, self.hi, self.centre, self.radius, self.first, self.n = [], [], [], [], [], []
        values = rows.astype(np.float64)
        away = np.sqrt(((values - values[0]) ** 2).sum(1))
        self._node(0, len(rows), 0, away.max())
        todo = [(0, away)]
        while todo:
            node, away = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf or self.radius[node] == 0:
                continue
            within, left, parts = self.radius[node] / BASE, self.order[lo:hi], []
            centre = self.centre[node]
            while len(left):
                near = away <= within
                parts.append((centre, left[near], away[near]))
                left = left[~near]
                if len(left):
                    centre = left[0]
                    gap = values[left] - values[centre]
                    away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            self.first[node], self.n[node] = len(self.lo), len(parts)
            at = lo
            for centre, members, away in parts:
                self.order[at : at + len(members)] = members
                todo.append((len(self.lo), away))
                self._node(at, at + len(members), centre, away.max())
                at += len(members)
        self.lo, self.hi, self.centre, self.first, self.n = (np.array(x, np.int32) for x in (self.lo, self.hi, self.centre, self.first, self.n))
        self.radius = np.array(self.radius)

    def _node(self, lo: int, hi: int, centre: int, radius: float) -> None:
        for x, value in ((self.lo, lo), (self.hi, hi), (self.centre, centre), (self.radius, radius), (self.first, -1), (self.n, 0)):
            x.append(value)

    def packed(self) -> bytes:
        place = np.empty_like(self.order)
        place[self.order] = np.arange(len(place))
        return pack(self.lo, self.hi, place[self.centre].astype(np.int32), self.radius, self.first, self.n)


class Block:
    """Vectors in the order of their tree, and the tree."""

    def __init__(self, vectors: np.ndarray, tree: bytes):
        self.vectors = vectors
        self.lo, self.hi, self.centre, self.radius, self.first, self.n = unpack(tree)


def children(first: np.ndarray, n: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the children of ``nodes``, and for each the place of its parent among ``nodes``."""
    count = n[nodes]
    parent = np.repeat(np.arange(len(nodes)), count)
    within = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
    return first[nodes][parent] + within, parent


def nearest(block: Block, centroids: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector of the block its nearest centroid and the squared distance; pairs that were compared."""
    points, means = block.vectors.astype(np.float64), centroids.astype(np.float64)
    most = np.full(len(block.lo), np.inf)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves_q, leaves_r = [], []
    while len(q):
        gap = points[block.centre[q]] - means[tree.centre[r]]
        away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        # every vector below q has a centroid, r's centre, within this
        np.minimum.at(most, q, away + block.radius[q])
        reach = block.radius[q] + tree.radius[r]
        keep = away - reach <= most[q] + 1e-9 * (away + reach + most[q])
        q, r = q[keep], r[keep]
        end_q, end_r = block.n[q] == 0, tree.n[r] == 0
        both = end_q & end_r
        leaves_q.append(q[both])
        leaves_r.append(r[both])
        q, r, end_q, end_r = (x[~both] for x in (q, r, end_q, end_r))
        down_q = ~end_q & (end_r | (block.radius[q] >= tree.radius[r]))
        child, parent = children(block.first, block.n, q[down_q])
        np.minimum.at(most, child, most[q[down_q]][parent])
        other, above = children(tree.first, tree.n, r[~down_q])
        q, r = np.concatenate([child, q[~down_q][above]]), np.concatenate([r[down_q][parent], other])
    q, r = np.concatenate(leaves_q), np.concatenate(leaves_r)
    best = np.full(len(points), np.iinfo(np.int64).max)
    owner = np.zeros(len(points), np.int64)
    sizes = (block.hi - block.lo)[q].astype(np.int64) * (tree.hi - tree.lo)[r]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        n_r = (tree.hi - tree.lo)[r[at:to]]
        pair = np.repeat(np.arange(at, to), sizes[at:to])
        within = np.arange(len(pair)) - np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to])
        width = np.repeat(n_r, sizes[at:to])
        point = block.lo[q[pair]] + within // width
        number = tree.order[tree.lo[r[pair]] + within % width]
        gap = block.vectors[point].astype(np.int64) - centroids[number]
        squared = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((number, squared, point))
        point, number, squared = point[order], number[order], squared[order]
        one = np.flatnonzero(np.diff(point, prepend=-1))
        point, number, squared = point[one], number[one], squared[one]
        better = (squared < best[point]) | ((squared == best[point]) & (number < owner[point]))
        best[point[better]], owner[point[better]] = squared[better], number[better]
        at = to
    return owner, best, int(sizes.sum())


def blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` (id bigint, v array<bigint>) in blocks with their trees, written in the shared folder."""

    @tidy
    def build(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                n += held[-1].num_rows
                if n >= block_rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = table.column("id").combine_chunks()
        rows = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        if np.abs(rows).max(initial=0) > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST} after scaling")
        tree = Tree(rows, LEAF_ROWS)
        small = rows[tree.order].astype(np.int16 if np.abs(rows).max() < 1 << 15 else np.int32)
        order = pa.array(tree.order)
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([ids.take(order).to_pylist()], pa.list_(pa.int64())), "dim": pa.array([rows.shape[1]], pa.int32()),
            "vectors": pa.array([pack(small.ravel())], pa.binary()), "tree": pa.array([tree.packed()], pa.binary()),
        })

    return written(vectors.mapInArrow(build, "ids array<bigint>, dim int, vectors binary, tree binary"), "blocks")


def _opened(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            dim = batch.column("dim")[i].as_py()
            vectors = unpack(batch.column("vectors")[i].as_py())[0].reshape(-1, dim)
            yield batch.column("ids").slice(i, 1), Block(vectors, batch.column("tree")[i].as_py())


def round_sums(spread: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Per centroid that has vectors: its number, how many, and their sum by component."""
    k, dim = centroids.shape

    @tidy
    def run(batches):
        tree = Tree(centroids, CENTROID_LEAF)
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, block in _opened(batches):
            owner, _, _ = nearest(block, centroids, tree)
            np.add.at(sums, owner, block.vectors.astype(np.int64))
            counts += np.bincount(owner, minlength=k)
        some = np.flatnonzero(counts)
        if len(some):
            arrays = [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), *(pa.array(sums[some, i], pa.int64()) for i in range(dim))]
            yield pa.RecordBatch.from_arrays(arrays, ["c", "n", *(f"s{i}" for i in range(dim))])

    parts = spread.mapInArrow(run, "c int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(dim)))
    # a sum beyond a long is an error in Spark, never a wrong number
    total = parts.groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)))
    return [(r["c"], r["n"], [r[f"s{i}"] for i in range(dim)]) for r in total.collect()]


def moved(centroids: np.ndarray, sums: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """Centroids at the floored means of their vectors; those without any stay."""
    out = centroids.copy()
    for c, n, s in sums:
        out[c] = [x // n for x in s]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The ``k`` vectors with the smallest hex sha256 of ``seed:identifier``, as rows in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Assignments (id, cluster, distance) after ``rounds`` rounds and once more, and the final centroids.

    ``vectors`` has id and v (array of longs, all of one length, see ``scaled``).
    """
    spark = vectors.sparkSession
    bounded(spark)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), centroids
    spread = blocks(vectors, block_rows)
    for _ in range(rounds):
        centroids = moved(centroids, round_sums(spread, centroids))

    @tidy
    def assign(batches):
        tree = Tree(centroids, CENTROID_LEAF)
        for ids, block in _opened(batches):
            owner, squared, _ = nearest(block, centroids, tree)
            yield pa.RecordBatch.from_pydict({"id": ids.flatten(), "cluster": pa.array(owner, pa.int32()), "distance": pa.array(squared, pa.int64())})

    out = written(spread.mapInArrow(assign, "id bigint, cluster int, distance bigint"), "assigned")
    drop_written(spread)
    return out, centroids


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in 40 clusters."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select(F.col("vec_id").alias("id"), scaled(F.col("embedding"), 64).alias("v")).where("v IS NOT NULL")
    found, centroids = lloyd(vectors)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row a centroid, 40 at most
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string")
    whole = own.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = own.join(F.broadcast(named), "cluster").join(F.broadcast(whole))
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same by comparing every vector with every centroid."""
    squared = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS j, v AS c FROM (SELECT * FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.id, v.v, min({{'d': {squared}, 'j': c.j}}) AS b FROM v, c{i} c GROUP BY v.n, v.id, v.v)")
        if i < rounds:
            steps.append(f"e{i} AS (SELECT b.j AS j, unnest(v) AS x, unnest(range({dim})) AS p FROM a{i})")
            steps.append(f"m{i} AS (SELECT j, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM e{i} GROUP BY j, p)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list(x ORDER BY p) AS c FROM m{i} GROUP BY j) n USING (j))")
    last = rounds
    return "WITH " + "\n, ".join(steps) + f"""
SELECT a.id AS vec_id, a.b.j AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.j))::BIGINT AS cluster_inertia, (sum(a.b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.j = a.b.j
"""
