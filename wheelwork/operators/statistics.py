"""Aggregates behind the statistics: extremes, percentiles, histograms, shares, flows, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.operators.lineage import written


#: Ranks are sketched to a part in so many, and groups up to so many values are counted whole.
ACCURACY = 10_000


def extremes(daily: DataFrame, day: str, n: str) -> DataFrame:
    """min, max, mean, median of daily counts, with the earliest day of least and most."""
    return daily.agg(
        F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n).alias("median"),
        F.min_by(day, F.struct(n, day)).alias("least_day"), F.min_by(day, F.struct((-F.col(n)).alias("n"), day)).alias("most_day"),
    )


def fixed_histogram(rows: DataFrame, x: str, width: float, least: float, most: float) -> DataFrame:
    """Counts per bin of ``width`` in [least, most]; the last bin is closed, others are half open."""
    last = int((most - least) / width) - 1
    b = F.least(F.floor((F.col(x) - least) / width), F.lit(last))
    return rows.where(F.col(x).between(least, most)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def range_histogram(rows: DataFrame, x: str, bins: int) -> DataFrame:
    """Equal-width histogram over the data's own range; the last bin is closed."""
    ends = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return rows.where(F.col(x).isNotNull()).join(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def bucket_counts(rows: DataFrame, x: str, edges: list[float], names: list[str]) -> DataFrame:
    """Counts and shares of half-open buckets in order; empty ones are kept."""
    group = F
    for e, name in zip(edges, names, strict=False):
        group = group.when(F.col(x) < e, name)
    group = group.otherwise(names[-1])
    counts = rows.groupBy(group.alias("grp")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "grp string")
    total = F.sum("n").over(Window.partitionBy())
    return every.join(F.broadcast(counts), "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n")).select("grp", "n", (F.col("n") / total).alias("share"))


def quartile(rows: DataFrame, x: str) -> DataFrame:
    """Rows with their quartile 1 to 4: right-closed bins at interpolated cut points."""
    cuts = described(rows, x, [25, 50, 75]).select("_c")
    q = F.when(F.col(x) <= F.col("_c")[0], 1).when(F.col(x) <= F.col("_c")[1], 2).when(F.col(x) <= F.col("_c")[2], 3).otherwise(4)
    return rows.join(F.broadcast(cuts)).withColumn("quartile", F.when(F.col(x).isNotNull(), q)).drop("_c")


def top_k(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent combinations; ties by name."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(k)


def ranked(rows: DataFrame, order: list[Column], x: str) -> DataFrame:
    """Rows with ``_rn`` (from 1 in a total order), ``_n``, the running sum ``_run`` of ``x`` and its whole sum ``_all``.

    Ranges of the order are ranked side by side; only their counts and sums, a row a
    range, pass through one task. The ranges are written once, so both see the same.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = parts.groupBy("_range").agg(F.count("*").alias("c"), F.coalesce(F.sum(x), F.lit(0)).alias("s"))
    offsets = totals.select("_range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"), F.sum("c").over(whole).alias("_n"), F.sum("s").over(whole).alias("_all"))
    local = parts.select("*", F.row_number().over(within).alias("_k"), F.coalesce(F.sum(x).over(within), F.lit(0)).alias("_r"))
    return local.join(F.broadcast(offsets), "_range").select(*rows.columns, (F.col("_k") + F.col("_c")).alias("_rn"), "_n", (F.col("_r") + F.col("_s")).alias("_run"), "_all")


def running_share(totals: DataFrame, x: str, ties: list[str], share: float) -> DataFrame:
    """The largest values whose running sum stays within ``share`` of the total."""
    return ranked(totals, [F.desc(x), *map(F.col, ties)], x).where(F.col("_run") <= F.col("_all") * share).select(*totals.columns)


def tail_share(totals: DataFrame, x: str, ties: list[str], cut: float) -> DataFrame:
    """Share of the sum that lies beyond place int(n * cut) of the ascending order."""
    out = ranked(totals, [F.col(x), *map(F.col, ties)], x)
    return out.agg((F.sum(F.when(F.col("_rn") > F.floor(F.col("_n") * cut), F.col(x))) / F.sum(x)).alias("share"))


def from_rank(totals: DataFrame, x: str, ties: list[str], cut: float) -> DataFrame:
    """Rows whose value is that at place int(n * cut) of the ascending order (from 0) or more."""
    at = ranked(totals, [F.col(x), *map(F.col, ties)], x).where(F.col("_rn") == F.floor(F.col("_n") * cut) + 1).select(F.col(x).alias("_cut"))
    return totals.join(F.broadcast(at)).where(F.col(x) >= F.col("_cut")).select(*totals.columns)


def normalised_difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with ``diff``: ``a`` over its greatest value less ``b`` over its own."""
    most = rows.agg(F.max(a).alias("_a"), F.max(b).alias("_b"))
    return rows.join(F.broadcast(most)).withColumn("diff", F.col(a) / F.col("_a") - F.col(b) / F.col("_b")).drop("_a", "_b")


def od_matrix(rows: DataFrame, origin: str, destination: str, zones: list[str]) -> DataFrame:
    """Origin-destination counts with a column per destination."""
    return rows.groupBy(origin).agg(*[F.count_if(F.col(destination) == z).alias(str(z)) for z in zones])


def zone_flows(rows: DataFrame, starts_in: Column, ends_in: Column) -> DataFrame:
    """Rides that stay, leave, enter, or never touch a zone, and the share that stays."""
    return rows.agg(
        F.count_if(starts_in & ends_in).alias("stay"), F.count_if(starts_in & ~ends_in).alias("leave"), F.count_if(~starts_in & ends_in).alias("enter"),
        F.count_if(~starts_in & ~ends_in).alias("outside"), (F.count_if(starts_in & ends_in) / F.count("*")).alias("stay_share"),
    )


def tag_profile(rows: DataFrame, tags: str) -> DataFrame:
    """Per tag key: rows that have it, their share in percent, distinct values."""
    n = rows.agg(F.count("*").alias("_n"))
    long = rows.select(F.explode(tags).alias("key", "value")).where("value IS NOT NULL")
    return long.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values")).join(F.broadcast(n)).select("key", "n", (F.col("n") / F.col("_n") * 100).alias("percent"), "n_values")


def quality_checks(rows: DataFrame, **checks: Column) -> DataFrame:
    """How many rows break each named check; all checks in one pass."""
    return rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])


def both_histograms(rows: DataFrame, columns: list[str], width: float, below: float) -> DataFrame:
    """column, bin, n: equal bins over several columns at once; nulls and values from ``below`` on are left out."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.column", "r.x")
    return long.where((F.col("x") < below) & (F.col("x") >= 0)).groupBy("column", F.floor(F.col("x") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def described(rows: DataFrame, x: str, at: list[float], by: list[str] = (), **more: Column) -> DataFrame:
    """by, n, mean, least, most, the aggregates ``more``, and ``_c``: interpolated percentiles of ``x``, per group.

    Exact for groups of any size, in two passes. A sketch gives values on both sides of each wanted
    rank; values between them are counted one by one, all others only as so many in a gap, so
    what is sorted in one task is about a thousandth of a group (groups up to ``ACCURACY`` whole). Nulls are left out.
    """
    x_ = F.col(x).cast("double")
    margin = 5 / ACCURACY
    asked = [max(0.0, p / 100 - margin) for p in at] + [min(1.0, p / 100 + margin) for p in at]
    facts = rows.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x_).alias("mean"), F.min(x_).alias("least"), F.max(x_).alias("most"),
        F.percentile_approx(x_, F.array(*map(F.lit, asked)), ACCURACY).alias("_q"), *[c.alias(name) for name, c in more.items()],
    )
    facts = written(facts, "facts")
    q = lambda i: F.get("_q", F.lit(i))
    n = range(len(at))
    gaps = facts.select(*[F.col(c).alias(f"_{c}") for c in by], (F.col("n") <= ACCURACY).alias("_whole"), *[q(i).alias(f"_lo{i}") for i in n], *[q(len(at) + i).alias(f"_hi{i}") for i in n])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    # without groups there is one row of facts
    known = rows.select(*by, x_.alias("_x")).where("_x IS NOT NULL").join(gaps if by else F.broadcast(gaps), same or None)
    near, below = F.col("_whole"), F.lit(None).cast("double")
    for i in sorted(n, key=lambda i: at[i]):
        near = near | F.col("_x").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        below = F.when(F.col("_x") > F.col(f"_hi{i}"), F.col(f"_hi{i}")).otherwise(below)
    counts = known.select(*by, (~near).alias("_rest"), F.when(near, F.col("_x")).otherwise(below).alias("_v")).groupBy(*by, "_v", "_rest").agg(F.count("*").alias("_k"))
    over = Window.partitionBy(*by)
    upto = over.orderBy(F.col("_v").asc_nulls_first(), "_rest").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.select(*by, "_v", "_rest", "_k", F.sum("_k").over(upto).alias("_past"), F.sum("_k").over(over).alias("_all"))
    cuts = []
    for p in at:
        h = (F.col("_all") - 1) * (p / 100)
        held = lambda rank: ~F.col("_rest") & (F.col("_past") - F.col("_k") <= rank) & (rank < F.col("_past"))
        low, part = F.max(F.when(held(F.floor(h)), F.col("_v"))), F.max(h - F.floor(h))
        high = F.max(F.when(held(F.ceil(h)), F.col("_v")))
        # the sketch's promise keeps wanted ranks between its values; if it failed, that is an error and no wrong number
        value = F.coalesce(F.when(part == 0, low).otherwise(low + (high - low) * part), F.raise_error(F.lit("a percentile lies outside its sketch")).cast("double"))
        cuts.append(F.when(F.count("*") > 0, value))
    found = run.groupBy(*by).agg(F.array(*cuts).alias("_c"))
    if not by:
        return facts.drop("_q").join(F.broadcast(found), F.lit(True), "left")
    held = found.select(*[F.col(c).alias(f"_{c}") for c in by], "_c")
    return facts.drop("_q").join(held, same, "left").drop(*[f"_{c}" for c in by])


def summary(rows: DataFrame, x: str, at: list[int], by: list[str] = ()) -> DataFrame:
    """n, mean, median, most, least and percentiles of a column, per group (see ``described``)."""
    found = described(rows, x, [50, *at], by)
    return found.select(*by, "n", "mean", "most", "least", F.get("_c", F.lit(0)).alias("median"), *[F.get("_c", F.lit(i + 1)).alias(f"p{p}") for i, p in enumerate(at)])


def counted_percentiles(counts: DataFrame, x: str, n: str, at: tuple[int, ...]) -> DataFrame:
    """One row with pNN for each of ``at``: interpolated percentiles of values that stand ``n`` times each."""
    run = ranked(counts, [F.col(x)], n).select(F.col(x).alias("x"), (F.col("_run") - F.col(n)).alias("lo"), F.col("_run").alias("hi"), "_all")
    held = lambda rank: (F.col("lo") <= rank) & (rank < F.col("hi"))
    out = []
    for p in at:
        h = (F.col("_all") - 1) * (p / 100)
        part = h - F.floor(h)
        out.append((F.sum(F.when(held(F.floor(h)), F.col("x") * (1 - part))) + F.coalesce(F.sum(F.when(held(F.floor(h) + 1), F.col("x") * part)), F.lit(0.0))).alias(f"p{p}"))
    return run.agg(*out)


def exact_percentiles(rows: DataFrame, by: str, x: str, at: list[int]) -> DataFrame:
    """grp, p, value: interpolated percentiles, one row each (see ``described``)."""
    found = described(rows, x, at, [by]).where("n > 0")
    return found.select(F.col(by).alias("grp"), F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("p"), F.col("_c").alias("value"))).alias("r")).select("grp", "r.p", "r.value")
