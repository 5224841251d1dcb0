"""K-modes clustering of categorical rows: Hamming distance, most frequent value per column.

Rows are first counted per distinct combination. All models of a sweep (every k, way and
start) are fitted side by side: a round is one pass over the combinations and one aggregation for all
of them; centroids are all that the driver holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheelwork.operators.lineage import drop_written, written


def _distance(columns: list[str], centre: tuple):
    return sum(((~F.col(c).eqNullSafe(F.lit(v))).cast("int") for c, v in zip(columns, centre, strict=True)), F.lit(0))


def assign(rows: DataFrame, columns: list[str], centres: list[tuple]) -> DataFrame:
    """Rows with cluster (ties: the first) and distance."""
    best = F.least(*[F.struct(_distance(columns, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]) if len(centres) > 1 else F.struct(_distance(columns, centres[0]).alias("distance"), F.lit(0).alias("cluster"))
    return rows.withColumn("_b", best).select("*", "_b.cluster", "_b.distance").drop("_b")


def first_centres(counted: DataFrame, columns: list[str], k: int, seed: int, way: str) -> list[tuple]:
    """First centres by ``way``, all of them combinations of the table.

    ``frequent``: the most frequent ones; ``random``: a seeded draw; ``cao``: the densest
    one, then always the one whose least (distance times density) to those taken is
    greatest; ``huang``: for each column the values by frequency are dealt to the centres,
    and each is replaced by its nearest combination that is not taken. Ties go by value.
    """
    if way == "cao":
        return _by_density(counted, columns, k)
    if way == "huang":
        return _by_values(counted, columns, k)
    order = [F.desc("_n"), *columns] if way == "frequent" else [F.xxhash64(F.lit(seed), *columns), *columns]
    return [tuple(r) for r in counted.orderBy(*order).limit(k).select(*columns).collect()]


def _by_density(counted: DataFrame, columns: list[str], k: int) -> list[tuple]:
    total = counted.agg(F.sum("_n").alias("_all"))
    dense = counted
    for c in columns:
        share = counted.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("_n").alias(f"_d_{c}"))
        dense = dense.join(share, F.col(c).eqNullSafe(F.col(f"_{c}"))).drop(f"_{c}")
    dense = written(dense.join(F.broadcast(total)).withColumn("_density", sum((F.col(f"_d_{c}") for c in columns), F.lit(0)) / (len(columns) * F.col("_all"))).select(*columns, "_density"))
    taken = [tuple(dense.orderBy(F.desc("_density"), *columns).select(*columns).first())]
    while len(taken) < k:
        reach = [_distance(columns, c) * F.col("_density") for c in taken]
        best = dense.withColumn("_r", F.least(*reach) if len(reach) > 1 else reach[0]).where("_r > 0").orderBy(F.desc("_r"), *columns).select(*columns).first()
        if best is None:
            break
        taken.append(tuple(best))
    drop_written(dense)
    return taken


def _by_values(counted: DataFrame, columns: list[str], k: int) -> list[tuple]:
    values = []
    for c in columns:
        values.append([r[0] for r in counted.groupBy(c).agg(F.sum("_n").alias("n")).orderBy(F.desc("n"), c).limit(k).collect()])
    taken: list[tuple] = []
    for j in range(k):
        aim = tuple(v[j % len(v)] for v in values)
        free = counted
        for t in taken:
            free = free.where(_distance(columns, t) > 0)
        best = free.orderBy(_distance(columns, aim), F.desc("_n"), *columns).select(*columns).first()
        if best is None:
            break
        taken.append(tuple(best))
    return taken


def _coded(counted: DataFrame, columns: list[str]) -> DataFrame:
    """codes (a hash per column, equal for equal values and nulls), _n of counted combinations."""
    return counted.select(F.array(*[F.xxhash64(c) for c in columns]).alias("codes"), F.col("_n").cast("bigint").alias("n"))


def _codes_of(counted: DataFrame, columns: list[str], centres: list[list[tuple]]) -> list[np.ndarray]:
    """The codes of first centres, looked up once for all models."""
    every = list(dict.fromkeys(c for model in centres for c in model))
    kinds = T.StructType([T.StructField("i", T.IntegerType())] + [T.StructField(f.name, f.dataType) for f in counted.select(*columns).schema])
    rows = counted.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(every)], kinds).select("i", F.array(*[F.xxhash64(c) for c in columns]).alias("codes")).collect()
    known = {every[r["i"]]: r["codes"] for r in rows}
    return [np.array([known[c] for c in model], np.int64).reshape(len(model), len(columns)) for model in centres]


def _counts(coded: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """model, cluster, place, code, n: how often each value stands in each cluster of each model; place -1 has the cost.

    One pass over the combinations for all models; a task sums up before it sends.
    """
    kinds = [("model", pa.int32()), ("cluster", pa.int32()), ("place", pa.int32()), ("code", pa.int64()), ("n", pa.int64())]

    def run(batches):
        sums: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, -1)
            n = batch.column("n").to_numpy()
            for m, centres in models.items():
                away = np.zeros((len(codes), len(centres)), np.int32)
                for j in range(codes.shape[1]):
                    away += codes[:, j, None] != centres[None, :, j]
                own = away.argmin(1)
                sums[m, -1, -1, 0] = sums.get((m, -1, -1, 0), 0) + int((away[np.arange(len(own)), own] * n).sum())
                for j in range(codes.shape[1]):
                    values, inverse = np.unique(codes[:, j], return_inverse=True)
                    table = np.bincount(own * len(values) + inverse, weights=n, minlength=len(centres) * len(values))
                    for place in np.flatnonzero(table):
                        key = (m, int(place // len(values)), j, int(values[place % len(values)]))
                        sums[key] = sums.get(key, 0) + int(table[place])
        rows = [(*k, v) for k, v in sums.items()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 50_000]], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return coded.mapInArrow(run, "model int, cluster int, place int, code bigint, n bigint").groupBy("model", "cluster", "place", "code").agg(F.sum("n").alias("n"))


def _fitted(rows: DataFrame, columns: list[str], starts: list[tuple[str, int, int]], rounds: int) -> list[tuple[list[tuple], int]]:
    """Centres and cost of models (way, k, seed), all fitted side by side: a round is one pass and one aggregation for all.

    Per model the most frequent value of each column in a cluster (ties: the smaller, nulls first)
    comes to the driver, models times k times columns in all.
    """
    counted = written(rows.groupBy(*columns).agg(F.count("*").alias("_n")), "combinations")
    coded = written(_coded(counted, columns), "coded")
    names = written(counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.xxhash64(c).alias("code"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])).alias("v")).select("v.*").distinct(), "values")
    # first centres of a smaller k are the first of a larger one
    widest: dict[tuple[str, int], int] = {}
    for way, k, seed in starts:
        widest[way, seed] = max(k, widest.get((way, seed), 0))
    first = {start: first_centres(counted, columns, k, start[1], start[0]) for start, k in widest.items()}
    values = [first[way, seed][:k] for way, k, seed in starts]
    codes = _codes_of(counted, columns, values)
    kinds = [dict(rows.dtypes)[c] for c in columns]
    costs: list[int | None] = [None] * len(starts)
    going = [m for m in range(len(starts)) if values[m]]
    for _ in range(rounds):
        if not going:
            break
        counts = written(_counts(coded, {m: codes[m] for m in going}), "counts")
        now = {r["model"]: r["n"] for r in counts.where("place < 0").collect()}
        better = [m for m in going if costs[m] is None or now.get(m, 0) < costs[m]]
        for m in better:
            costs[m] = now.get(m, 0)
        modes = counts.where(F.col("place") >= 0).join(names, ["place", "code"]).groupBy("model", "cluster", "place").agg(F.min_by(F.struct("code", "value"), F.struct(-F.col("n"), F.col("value"))).alias("m"))
        for r in modes.where(F.col("model").isin(better)).collect() if better else ():
            m, j, i, value = r["model"], r["cluster"], r["place"], r["m"]["value"]
            codes[m][j, i] = r["m"]["code"]
            centre = list(values[m][j])
            centre[i] = int(value) if value is not None and kinds[i] in ("int", "bigint") else value
            values[m][j] = tuple(centre)
        drop_written(counts)
        going = better
    drop_written(counted, coded, names)
    return [(v, c or 0) for v, c in zip(values, costs, strict=True)]


def fit(rows: DataFrame, columns: list[str], k: int, rounds: int = 20, restarts: int = 1, seed: int = 1, way: str = "frequent") -> tuple[list[tuple], float]:
    """Centres and cost of the best of ``restarts`` starts: the first by ``way``, further ones at random."""
    found = _fitted(rows, columns, [(way if r == 0 else "random", k, seed + r) for r in range(restarts)], rounds)
    return min(found, key=lambda x: x[1])


def sweep(rows: DataFrame, columns: list[str], ks: list[int], ways=("frequent", "random"), restarts: int = 1, rounds: int = 20) -> DataFrame:
    """way, k, cost: the cost curve; of several starts the least. A way that draws nothing has one start."""
    starts = [(way, k, 1 + r) for way in ways for k in ks for r in range(restarts if way == "random" else 1)]
    best: dict[tuple[str, int], int] = {}
    for (way, k, _), (_, cost) in zip(starts, _fitted(rows, columns, starts, rounds), strict=True):
        best[way, k] = min(cost, best.get((way, k), cost))
    return rows.sparkSession.createDataFrame([(way, k, float(c)) for (way, k), c in best.items()], "way string, k int, cost double")
