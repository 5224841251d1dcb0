"""Helpers that every training-data operator uses: shared folders, sizes, column names."""

from __future__ import annotations

import ctypes
import functools
import math
import sys

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheelwork.operators.lineage import drop_path, drop_written, fresh_path, shared_dir, written  # noqa: F401

#: ASCII white space that separates words: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch on its way to Python, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_UNITS = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES``, unless they are smaller already.

    The rows of a batch alone do not bound a worker's memory, as texts may be long. The
    setting stays, since the operators return frames that run later.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b") or "0"
    size = int(now[:-1]) << _UNITS[now[-1]] if now[-1] in _UNITS else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: What tasks of one stage leave in their worker process for the next ones, and the stage.
_kept: dict = {}
_stage: list = [None]


def kept_for_stage(name, make):
    """What ``make`` gives, made once in a worker for all its tasks of the running stage."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def tidy(run):
    """``run`` for mapInArrow, minding the memory of its worker process.

    It drops what tasks of an earlier stage have kept there, and gives the memory that it
    has freed back to the system when its task ends.
    """

    @functools.wraps(run)
    def inner(batches):
        if (stage := TaskContext.get().stageId()) != _stage[0]:
            _kept.clear()
            _stage[0] = stage
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows: sizes buckets and windows."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def buckets_for(n_bytes: int, each: int, least: int = 256) -> int:
    """How many buckets of about ``each`` bytes hold ``n_bytes``; grows with the data."""
    return max(least, math.ceil(n_bytes / each))


def spread(total: int, portion: int, range_: int) -> tuple[int, int]:
    """Sizes of portions and ranges so that what a portion sends to a range stays worth a row.

    There are total / portion * total / range such rows; both sizes grow with the root of
    the table once their product is below 300 times it (some 50 hashes a row).
    """
    by = math.sqrt(max(1.0, 300 * total / (portion * range_)))
    return int(portion * by), int(range_ * by)


def apart(df: DataFrame, reserved: list[str]) -> DataFrame:
    """Rename input columns whose names clash with ``reserved`` (case ignored).

    Such a column goes on as ``<name>_in`` (with further ``_in`` until unique).
    """
    taken = {c.lower() for c in df.columns} | {c.lower() for c in reserved}
    names = []
    for c in df.columns:
        new = c
        if c.lower() in {r.lower() for r in reserved}:
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
        names.append(new)
    return df.toDF(*names) if names != df.columns else df


def put_back(out: DataFrame, docs: DataFrame, reserved, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from an operator's result, under their own names; ``changed`` ones anew."""
    kept = apart(docs, list(reserved)).columns
    return out.select(*[changed.get(c, F.col(f"`{new}`")).alias(c) for c, new in zip(docs.columns, kept, strict=True)])


def extended(df: DataFrame, more: dict[str, str], drop: tuple[str, ...] = ()) -> T.StructType:
    """The schema of ``df`` without ``drop``, followed by the columns ``more`` (name to type)."""
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in more.items()))
    return T.StructType([*(f for f in df.schema if f.name not in drop), *added])


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
