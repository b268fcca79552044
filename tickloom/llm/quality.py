"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Texts are token streams (runs of letters and digits, runs of other marks). A text's n-grams are
its tokens, its token pairs and its triples of token shapes (case, digits, marks, repetition),
hashed into BUCKETS. The raw model counts the n-grams of every document, the target model those
of good labelled documents; a document's log weight is the sum over its n-grams of
``log p_target - log p_raw``, where the target's counts have KAPPA pseudo-counts spread as in the
raw model, so that n-grams too rare to judge weigh nothing. Documents are then resampled without
replacement with probability in proportion to their weight: adding Gumbel noise to the log
weights and keeping the k largest does that exactly (Gumbel top-k).

k is the number of documents whose log weight reaches the level that all but MISS of held-out
good documents reach, so as many are kept as look like the target. The k-th largest noisy weight
is found by radix selection over four digits of 16 bits: four small aggregates, no global sort.

The label sample is bounded (MAX_LABELS rows by smallest hash, a broadcast of 1 MB or so); both
models' n-gram counts cover all documents, respectively all good documents of the sample.

Defined results: null text is empty, has weight 0 and is judged by that; noise depends on seed
and doc_id only, so reruns agree and rows repeating a doc_id fall together; without good labels
every document is kept; a null doc_id is never labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import drop_staged, freed, raw_bytes, slices, small_batches, staged, table
from .words import Prefix, mix

BUCKETS = 1 << 17
KAPPA = 4.0
MISS = 0.001
MAX_LABELS = 50_000
SEED = 11
HELD_OUT = 5  # one label in so many only sets the level

# byte classes: 0 space, 1 lower or non-ASCII, 2 upper, 3 digit, 4 other marks
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[95] = 1
_KIND = np.array([0, 1, 1, 1, 2], np.uint8)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    kind = _KIND[_CLASS[data]]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    cut[0] = cut[-1] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    return start, end, np.searchsorted(start, offsets)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets (3, tokens), first): by token its own, its pair's and its shape triple's bucket.

    Pairs and triples that would reach over a row's end use a mark for the end instead.
    """
    start, end, first = _tokens(data, offsets)
    n = len(start)
    if not n:
        return np.zeros((3, 0), np.int64), first
    h = Prefix(data, lower=True).span(start, end)
    cls = _CLASS[data]
    upper = np.append(0, np.cumsum(cls == 2))
    digit = np.append(0, np.cumsum(cls == 3))
    up, dig, size = upper[end] - upper[start], digit[end] - digit[start], end - start
    mark = cls[start] == 4
    shape = np.where(up == 0, 0, np.where((up == 1) & (cls[start] == 2), 1, np.where(up == size - dig, 2, 3)))
    shape = shape * 4 + np.where(dig == 0, 0, np.where(dig == size, 1, 2))
    shape = np.where(mark, np.uint64(64) + h % np.uint64(1 << 40), shape.astype(np.uint64)).astype(np.uint64)
    row_start = np.zeros(n, bool)
    row_start[first[:-1][first[:-1] < n]] = True
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & ~row_start[1:]
    shape = shape * np.uint64(2) + same.astype(np.uint64)

    last1 = np.append(row_start[1:], True)
    last2 = last1 | np.append(last1[1:], True)
    end_mark = np.uint64(0xE9D)
    nxt = np.where(last1, end_mark, np.append(h[1:], end_mark))
    s1 = np.where(last1, end_mark, np.append(shape[1:], end_mark))
    s2 = np.where(last2, end_mark, np.append(shape[2:], [end_mark] * min(2, n))[:n])
    one = mix(h ^ np.uint64(0x1F83D9ABFB41BD6B))
    two = mix(h * np.uint64(0xD6E8FEB86659FD93) + nxt)
    three = mix(mix(shape + np.uint64(0x5BE0CD19137E2179)) * np.uint64(3) + mix(s1) * np.uint64(5) + mix(s2) * np.uint64(7))
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.stack([one >> top, two >> top, three >> top]).astype(np.int64), first


def _histogram(batches):
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = raw_bytes(batch.column("text"))
        fit = batch.column("good").fill_null(0).to_numpy(zero_copy_only=False) == 1
        for i, j in slices(offsets):
            b, first = ngram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            raw += np.bincount(b.ravel(), minlength=BUCKETS)
            if fit[i:j].any():
                of = np.repeat(fit[i:j], np.diff(first))
                good += np.bincount(b[:, of].ravel(), minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])


def log_ratio(raw: np.ndarray, good: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    """By bucket log p_target - log p_raw; 0 everywhere if nothing is labelled good."""
    if not good.sum():
        return np.zeros(len(raw), np.float32)
    expected = raw * (good.sum() / max(1, raw.sum()))
    return np.log((good + kappa) / (expected + kappa)).astype(np.float32)


def _noise(ids: np.ndarray, seed: int) -> np.ndarray:
    u = mix(mix(ids.view(np.uint64)) ^ np.uint64(seed)) >> np.uint64(11)
    return -np.log(-np.log((u.astype(np.float64) + 0.5) / (1 << 53)))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _score(model, seed: int, carried: dict[str, str]):
    def run(batches):
        weight = model.value
        for batch in batches:
            data, offsets = raw_bytes(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                b, first = ngram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sums = np.append(0, np.cumsum(weight[b].sum(axis=0, dtype=np.float64)))
                out[i:j] = sums[first[1:]] - sums[first[:-1]]
            out = np.round(out, 6)
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            noisy = out + _noise(ids, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(noisy), pa.array(_ordered(noisy)), batch.column("good"), *(batch.column(c) for c in carried.values())], names=["doc_id", "log_weight", "noisy", "place", "good", *carried])

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, by four aggregates of at most 65,536 rows."""
    known, left, at = 0, k, F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(at, shift).bitwiseAND(F.lit(0xFFFF))
        rows = df if shift == 48 else df.where(F.shiftrightunsigned(at, shift + 16) == known)
        for r in sorted(rows.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r["d"]):
            if r["count"] >= left:
                known = known << 16 | r["d"]
                break
            left -= r["count"]
        else:
            return None
    return known - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, miss: float = MISS, seed: int = SEED, max_labels: int = MAX_LABELS, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, log_weight, noisy, kept.

    ``carry`` names columns of ``docs`` that come along as ``__carry_<name>``, so that a caller needs no join.
    """
    spark = docs.sparkSession
    by = F.xxhash64(F.lit(seed), "doc_id")
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    lab = lab.withColumn("h", by).orderBy("h", "doc_id").limit(max_labels)
    good = (F.col("q") == 1) & (F.col("t") == 0)
    # 1: good, fits the model; 2: good, sets the level; 0: not good
    lab = lab.select(F.col("doc_id").alias("l"), F.when(good, F.when(F.pmod("h", F.lit(HELD_OUT)) == 0, 2).otherwise(1)).otherwise(0).alias("good"))
    lab = staged(lab, "labels")
    two = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(f"__carry_{c}") for c in carry or () if c not in ("doc_id", "text")])
    source = {f"__carry_{c}": c if c in ("doc_id", "text") else f"__carry_{c}" for c in carry or ()}
    extra = list(source)
    two = two.join(F.broadcast(lab), F.col("doc_id") == F.col("l"), "left").drop("l")

    counts = two.select("text", "good").mapInArrow(freed(_histogram), "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, fit = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    with small_batches(spark):
        got = counts.collect()  # BUCKETS rows at most
    for r in got:
        raw[r.bucket], fit[r.bucket] = r.raw, r.good
    model = spark.sparkContext.broadcast(log_ratio(raw, fit))
    kind = StructType(StructType.fromDDL("doc_id long, log_weight double, noisy double, place long, good int").fields + two.select(*[F.col(c).alias(k) for k, c in source.items()]).schema.fields)
    scored = staged(two.mapInArrow(freed(_score(model, seed, source)), kind), "weights")
    drop_staged(lab)
    level = scored.where("good = 2").agg(F.percentile("log_weight", F.lit(miss)).alias("x")).first()["x"]
    if level is None:
        return scored.select("doc_id", "log_weight", "noisy", F.lit(True).alias("kept"), *extra)
    k = scored.where(F.col("log_weight") >= level).count()
    least = kth_largest(scored, "place", k)
    return scored.select("doc_id", "log_weight", "noisy", (F.col("place") >= F.lit(least)).alias("kept"), *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
