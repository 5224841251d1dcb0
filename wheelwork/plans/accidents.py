"""Queries of accident statistics over orders seen as accidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from wheelwork.functions.codes import CODES
from wheelwork.operators import accidents as A
from wheelwork.plans.inputs import table

QUERIES, SQL = {}, {}
CITY = [(0.1, 0.1), (0.9, 0.2), (0.8, 0.9), (0.2, 0.8)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _accidents(spark, d):
    """Orders as accidents: state by customer, time by date and key, light and surface partly unknown."""
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("id"), (cust % 3 + 8).cast("int").alias("ULAND"), F.month("o_orderdate").alias("UMONAT"), F.dayofweek("o_orderdate").alias("UWOCHENTAG"), (key % 24).cast("int").alias("USTUNDE"),
        F.when(key % 4 < 3, key % 4).cast("int").alias("ULICHTVERH"), F.when(cust % 5 < 3, cust % 5).cast("int").alias("IstStrassenzustand"), (key % 2).cast("int").alias("IstRad"),
        ((key * 7919 % 1000) / 1000.0 + 0.00037).alias("XGCSWGS84"), ((cust * 104729 % 1000) / 1000.0 + 0.00041).alias("YGCSWGS84"),
    )


def _inside(x: str, y: str) -> str:
    """Inside the city: an odd number of sides to the right, and on none (no test point is)."""
    sides = [f"((({y1} > {y}) <> ({y2} > {y})) AND {x} < ({x2} - {x1}) * ({y} - {y1}) / ({y2} - {y1}) + {x1})::INT" for (x1, y1), (x2, y2) in zip(CITY, [*CITY[1:], CITY[0]], strict=True)]
    edges = [f"(({x} - {x1}) * ({y2} - {y1}) = ({y} - {y1}) * ({x2} - {x1}) AND {x} BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND {y} BETWEEN {min(y1, y2)} AND {max(y1, y2)})" for (x1, y1), (x2, y2) in zip(CITY, [*CITY[1:], CITY[0]], strict=True)]
    return f"({' + '.join(sides)}) % 2 = 1 AND NOT ({' OR '.join(edges)})"


_ACC = f"""acc AS (SELECT o_orderkey AS id, (o_custkey % 3 + 8)::INT AS uland, month(o_orderdate)::INT AS month, (dayofweek(o_orderdate) + 1)::INT AS weekday, (o_orderkey % 24)::INT AS hour,
  CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey % 4)::INT END AS light, CASE WHEN o_custkey % 5 < 3 THEN (o_custkey % 5)::INT END AS surface, o_orderkey % 2 AS rad,
  (o_orderkey * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE + 0.00037::DOUBLE AS x, (o_custkey * 104729 % 1000)::DOUBLE / 1000.0::DOUBLE + 0.00041::DOUBLE AS y FROM orders),
hit AS (SELECT * FROM acc WHERE uland = 9 AND rad = 1 AND {_inside('x', 'y')})"""


@query(f"WITH {_ACC} SELECT id FROM hit")
def accident_filter(spark, d):
    return A.with_bicycles(_accidents(spark, d), 9, CITY).select("id")


@query(f"WITH {_ACC} " + " UNION ALL ".join(f"SELECT '{by}' AS \"by\", {by} AS code, count(*) AS n FROM hit WHERE {by} IS NOT NULL GROUP BY 2" for by in A.BY))
def accident_counts(spark, d):
    return A.all_counts(A.with_bicycles(_accidents(spark, d), 9, CITY))


def _named(by: str) -> str:
    kind = A.BY[by][1]
    names = " ".join(f"WHEN {c} THEN '{n}'" for c, n in CODES[kind][0].items())
    return f"WITH {_ACC} SELECT {by} AS code, CASE {by} {names} ELSE '{CODES[kind][1]}' END AS name, count(*) AS n FROM hit WHERE {by} IS NOT NULL GROUP BY 1"


def _register(by: str) -> None:
    def run(spark, d):
        return A.counts(A.with_bicycles(_accidents(spark, d), 9, CITY), by)

    run.__name__ = f"accidents_by_{by}"
    run.__doc__ = f"Accidents with bicycles inside the city by {by}."
    query(_named(by))(run)


for _by in A.BY:
    _register(_by)
