"""Shared plumbing of the corpus operators: tables, durable stages, Arrow byte views."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handed to NumPy in slices of about this many text bytes, so temporaries stay small.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, projected to ``columns`` so that only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local-mode session (one machine by definition, as in tests) gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    if there := conf.get("spark.checkpoint.dir", None):
        return there
    if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _own
    if _own is None:
        _own = tempfile.TemporaryDirectory(prefix="tickloom-")
        atexit.register(_own.cleanup)
    return f"file://{_own.name}"


_own: tempfile.TemporaryDirectory | None = None


#: Rows that go to a Python worker at once while a table is staged; the buffers on both sides hold so many texts.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Arrow batches hold BATCH_ROWS rows at most; the session's setting is put back after."""
    before = spark.conf.get(_ROWS)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs the tasks it ran, never a stage that
    was staged before, and later jobs see one fixed copy of what was computed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no returned plan reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A sieve has at most 2**SIEVE_SLOTS rows of 64 bits (some 25 MB as a broadcast), whatever it holds.
SIEVE_SLOTS = 20


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """(slot, bits): a bitmap of the hashes of a key column, of bounded size at any scale.

    ``sieved`` then tells rows whose key is surely not among ``keys``; the others need a join.
    """
    n = keys.count()
    slots = min(SIEVE_SLOTS, max(8, n.bit_length()))
    h = F.xxhash64(F.lit(41), column)
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    out = keys.select(F.shiftrightunsigned(h, 64 - slots).cast("int").alias("__slot"), bits.alias("b")).groupBy("__slot").agg(F.bit_or("b").alias("__bits"))
    out = staged(out, "sieve")
    out._slots = slots
    return out


def sieved(df: DataFrame, column: str, held: DataFrame) -> DataFrame:
    """``df`` with the boolean ``__may``: false where the column's value is surely not held."""
    h = F.xxhash64(F.lit(41), column)
    rows = df.join(F.broadcast(held), F.shiftrightunsigned(h, 64 - held._slots).cast("int") == F.col("__slot"), "left")
    bit = F.call_function("shiftright", F.coalesce("__bits", F.lit(0).cast("long")), F.pmod(h, F.lit(64)).cast("int"))
    return rows.withColumn("__may", bit.bitwiseAND(F.lit(1)) == 1).drop("__slot", "__bits")


def hot_join(df: DataFrame, keyed: DataFrame, on: list[str], how_many: str, total: int, most: int = 1_000) -> DataFrame:
    """``df`` inner-joined with ``keyed`` (one row a key, ``how_many`` rows of df have it).

    Keys that more than total / most rows have are at most ``most``; these are broadcast, so that
    their rows stay where they are. The others are joined by shuffle.
    """
    limit = max(total // most, 1)
    hot = keyed.where(F.col(how_many) > limit)
    rest = keyed.where(F.col(how_many) <= limit)
    return df.join(F.broadcast(hot), on).unionByName(df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


# ---------------------------------------------------------------------------------------
# Memory of Python workers

#: Functions that drop what a worker process keeps from task to task (tokenizers, tables of powers).
KEPT: list = []


def forget() -> None:
    for drop in KEPT:
        drop()


def give_back() -> None:
    """Hand freed memory, which Arrow's pool and malloc keep for later, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freed(run, keep: bool = False):
    """``run``, a function for mapInArrow, such that its worker holds little before and after.

    Workers outlive their tasks: what an earlier stage left in them, and what they freed but keep,
    would count beside the sorts and joins of later stages. With ``keep``, KEPT stays for the next task.
    """

    def wrapped(batches):
        if not keep:
            forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            if not keep:
                forget()
            give_back()

    return wrapped


# ---------------------------------------------------------------------------------------
# Arrow → NumPy


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) row ranges of at most ``most`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
