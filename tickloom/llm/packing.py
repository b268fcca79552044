"""Packing: shortest-pack-first over the length histogram.

Documents become token ids (plus id 0 at the end) and are cut every ``limit`` ids. The driver
sees only the histogram of piece lengths, at most ``limit`` numbers at any scale. Lengths are
placed longest first: each goes to the packs with the most room that fit it, a whole group of
equal packs at a time, so a pattern is stored once with its count and at most one pattern is
split for a length. Pieces then find their place by rank: the n-th piece of a length takes the
n-th slot that patterns have for that length.

Ranks need no global sort: each task numbers its own pieces by length, and running sums over the
tasks' counts give each task its first rank. The numbered pieces are staged before they are used,
so that a recomputed task can't number them anew.

Defined results: null text is an empty document (one piece with id 0); null or repeated doc_id
rows are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import freed, raw_bytes, slices, staged, table
from .tokens import default_paths, tokenizer

LIMIT = 1024
END = 0
#: Bytes of text that are encoded at once; a worker's arrays grow with it.
SLICE = 1 << 19
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """length → count becomes [(pattern, count)], patterns as lengths in placing order."""
    room: dict[int, list[list]] = defaultdict(list)  # room left → [pattern, count]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, left: int) -> None:
        if left:
            room[left].append([pattern, count])
        else:
            done.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        made = []  # packs extended now take no second piece of this length before older ones
        while todo:
            fits = [r for r in room if r >= length and room[r]]
            if not fits and made:
                for p in made:
                    put(*p)
                made = []
                continue
            if not fits:
                # what no pack fits opens new ones, each with as many of this length as it holds
                each = limit // length
                if full := todo // each:
                    put((length,) * each, full, limit - each * length)
                if last := todo % each:
                    put((length,) * last, 1, limit - last * length)
                break
            left = max(fits)
            pattern, count = room[left].pop()
            take = min(count, todo)
            if count > take:
                room[left].append([pattern, count - take])
            made.append(((*pattern, length), take, left - length))
            todo -= take
        for p in made:
            put(*p)
    for left in sorted(room):
        done += [(p, c) for p, c in room[left]]
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first, offset) for each slot of each pattern."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def _cut(paths: tuple, limit: int, end: int):
    def run(batches):
        tok = tokenizer(*paths)
        part = TaskContext.get().partitionId()
        count = np.zeros(limit + 1, np.int64)
        for batch in batches:
            data, offsets = raw_bytes(batch.column("text"))
            doc = batch.column("doc_id")
            for i, j in slices(offsets, SLICE):
                ids, at = tok.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at) + 1
                pieces = -(-n // limit)
                row = np.repeat(np.arange(j - i), pieces)
                nth_in_row = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth_in_row * limit
                length = np.minimum(limit, n[row] - start)
                last = start + length == n[row]
                little = ids.astype("<u4", copy=False)
                tail = np.array([end], "<u4").tobytes()
                crc = [
                    zlib.crc32(tail, zlib.crc32(little[a : a + m - 1])) if z else zlib.crc32(little[a : a + m])
                    for a, m, z in zip((at[row] + start).tolist(), length.tolist(), last.tolist(), strict=True)
                ]
                order = np.argsort(length, kind="stable")
                run_len = length[order]
                fresh = np.flatnonzero(np.diff(run_len, prepend=-1))
                within = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
                nth = np.empty(len(order), np.int64)
                nth[order] = count[run_len] + within
                count += np.bincount(length, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(i, j - i).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[row])), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )

    return run


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, paths: tuple | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with their sequence_id and offset."""
    spark = docs.sparkSession
    two = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = staged(two.mapInArrow(freed(_cut(paths or default_paths(), limit, end), keep=True), _PIECE), "pieces")
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    places = slots(shortest_pack_first(histogram, limit))

    by_task = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("before"))
    ranked = pieces.join(first, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("before") + F.col("nth"))
    # the slots follow the histogram, not the corpus: a few for each of the `limit` lengths
    slot = spark.createDataFrame(places, "len long, lo long, hi long, sequence long, offset long")
    return ranked.join(F.broadcast(slot), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


