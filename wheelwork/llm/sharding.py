"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters whole records uniformly over memory-sized buckets by a seeded hash
of all their columns; a task holds one bucket or a few, each sorted by a second seeded
hash. Pass two shuffles each bucket by Fisher-Yates (Spark's ``shuffle`` of an array is
that algorithm) and writes it. The buckets laid one after the other are a random order
of all records; cutting it into ``n_shards`` runs gives shards whose row counts differ by
one at most (law ``rows``).

The number of buckets and of their partitions follows from the table alone, so the same
table and seed give the same order whatever the session's partition settings.

Cases: null identifiers and null texts are scattered like any others; repeated rows are
all kept: rows that are equal in every column and more than ``MOST_EQUAL`` are counted, and
as many as there are are made of one of them, each scattered by its number, so that they do
not meet in one bucket; an empty table gives empty shards; input columns
named like an output column go on as ``<name>_in``. Map columns have no hash and are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelwork.llm.common import apart, buckets_for, fresh_path

OUTPUT = ["shard", "slot", "bucket"]
#: Rows (16 bytes each) of bucket offsets or of equal rows' hashes up to which they are broadcast; buckets up to which they keep their size.
MANY_BUCKETS = 1 << 20
#: Rows equal in every column that may share a bucket.
MOST_EQUAL = 1_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows (``_r``) of hot keys with the place each is scattered by: the n-th of equal rows by key and n.

    What tells equal rows apart is not their order in the input, so every evaluation gives the same places.
    They are counted first; runs of ``MOST_EQUAL`` numbers are dealt over the tasks and then made rows again.
    """
    counted = rows.groupBy("_key", "_r").agg(F.count("*").alias("_c"))
    runs = counted.select("_r", "_key", "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / MOST_EQUAL))).alias("_run"))
    dealt = runs.repartition(n, "_key", "_run")
    first = F.col("_run") * MOST_EQUAL
    each = dealt.select("_r", "_key", F.explode(F.sequence(first, F.least(first + MOST_EQUAL, F.col("_c")) - 1)).alias("_nth"))
    return each.select("_r", "_key", F.xxhash64("_key", "_nth").alias("_place"))


def shuffled(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_bytes: int = 8 << 20, most_bytes: int = 128 << 20,
             text_column: str = "text") -> DataFrame:
    """All records with ``shard``, ``slot`` (gapless from 0 in a shard) and ``bucket``.

    ``bucket_bytes`` is what one bucket holds in memory; in tables of more than
    ``MANY_BUCKETS`` such buckets it grows up to ``most_bytes``, and then their number does.
    Text over 2 GB in one row is beyond Spark's row limit.
    """
    docs = apart(docs, OUTPUT)
    key = F.xxhash64(F.lit(seed), *docs.columns)
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    n = buckets_for(size, min(most_bytes, max(bucket_bytes, size // MANY_BUCKETS)))
    # mostly none; one row for MOST_EQUAL rows of the table at most
    equal = docs.groupBy(key.alias("_key")).count().where(F.col("count") > MOST_EQUAL).select("_key", F.lit(True).alias("_many"))
    keyed = docs.select(F.struct(*docs.columns).alias("_r"), key.alias("_key"))
    n_equal = equal.count()
    known = keyed.withColumn("_place", F.col("_key"))
    if n_equal:
        marked = keyed.join(F.broadcast(equal) if n_equal <= MANY_BUCKETS else equal, "_key", "left")
        known = marked.where("_many IS NULL").select("_r", "_key", F.col("_key").alias("_place")).unionByName(_dealt(marked.where("_many"), n))
    bucketed = known.select("_r", F.pmod("_place", F.lit(n)).cast("int").alias("bucket"), F.xxhash64(F.lit(seed + 1), "_place").alias("_h"), F.hash("_r").alias("_h2"))
    counts = bucketed.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a row of 16 bytes for each bucket
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"), F.sum("count").over(Window.partitionBy()).alias("_n"))
    # a number of partitions that is asked for stays as it is, and with it each bucket's draw
    scattered = bucketed.repartition(n, "bucket").sortWithinPartitions("bucket", "_h", "_h2")
    mixed = scattered.groupBy("bucket").agg(F.collect_list("_r").alias("_rs")).select("bucket", F.posexplode(F.shuffle("_rs", seed)).alias("_pos", "_r"))
    shard = F.expr(f"(_at * {n_shards}) div _n")
    return (
        mixed.join(F.broadcast(offsets) if n <= MANY_BUCKETS else offsets, "bucket")
        .select("_r.*", "bucket", (F.col("_base") + F.col("_pos")).alias("_at"), "_n")
        .select(*docs.columns, "bucket", shard.cast("int").alias("shard"), "_at", "_n")
        .select(*docs.columns, "bucket", "shard", (F.col("_at") - F.expr(f"(shard * _n + {n_shards - 1}) div {n_shards}")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shuffled records, a folder per shard, and read the files back."""
    plan = shuffled(docs, **options)
    plan.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(plan.schema).parquet(path)


def op3_two_pass_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by law ``rows``, read back from the written files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = write_shards(docs, fresh_path(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket",
    )
