"""K-modes against a plain loop: many models at once, ties, nulls, restarts."""

import random

from wheelwork.operators import kmodes


def brute(rows, centres, rounds):
    centres, cost = list(centres), None
    away = lambda r, c: sum(a != b for a, b in zip(r, c, strict=True))
    for _ in range(rounds):
        own = [min((away(r, c), j) for j, c in enumerate(centres)) for r in rows]
        now = sum(d for d, _ in own)
        if cost is not None and now >= cost:
            break
        cost = now
        for j in range(len(centres)):
            members = [r for r, (_, o) in zip(rows, own, strict=True) if o == j]
            if members:
                mode = lambda values: min(set(values), key=lambda v: (-values.count(v), v is not None, v or ""))
                centres[j] = tuple(mode([m[i] for m in members]) for i in range(len(rows[0])))
    return centres, cost


def table(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice(["a", "b", "c", None, "d"][: 2 + i]) for i in range(4)) for _ in range(120)]
    return rows, spark.createDataFrame(rows, "p string, q string, r string, s string").repartition(3)


def test_models_side_by_side(spark):
    rows, df = table(spark)
    columns = ["p", "q", "r", "s"]
    counted = df.groupBy(*columns).count().withColumnRenamed("count", "_n")
    got = {(r["way"], r["k"]): r["cost"] for r in kmodes.sweep(df, columns, [1, 2, 3, 7], ("random", "cao", "huang", "frequent")).collect()}
    for (way, k), cost in got.items():
        assert cost == brute(rows, kmodes.first_centres(counted, columns, k, 1, way), 20)[1]
    assert len(got) == 16


def test_restarts_and_prediction(spark):
    rows, df = table(spark)
    columns = ["p", "q", "r", "s"]
    counted = df.groupBy(*columns).count().withColumnRenamed("count", "_n")
    centres, cost = kmodes.fit(df, columns, 4, restarts=6, way="huang")
    every = [brute(rows, kmodes.first_centres(counted, columns, 4, 1 + r, "huang" if r == 0 else "random"), 20) for r in range(6)]
    assert cost == min(c for _, c in every) and (centres, cost) in every
    best = kmodes.assign(df, columns, centres).groupBy().sum("distance").first()[0]
    assert best <= cost
    assert kmodes.fit(df.limit(0), columns, 3) == ([], 0)
