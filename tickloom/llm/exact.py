"""Exact dedup: Grace hash deduplication.

Texts are compared without the characters ``[\\x20\\x09-\\x0D]``. Each map task first folds the
copies it sees into one record per text (so a text that fills a third of the table is shuffled
once per task, not once per row), records are dealt by content hash, and each reduce task runs a
Grace hash: an in-memory open-addressing table (CPython's dict, which compares complete keys)
within a byte budget; over the budget the table and the rest of the bucket are partitioned by the
next bits of the hash to spill files, and each of those is treated the same way. Spill files are
scratch of one task attempt, like Spark's own spills: unlinked at creation, read by no one else.

Defined results: null text equals empty text; of equal texts the row with the most code points
of the original, then the smallest doc_id (null last) stays; rows that share the doc_id that
stays all carry kept = true; two different texts with one SHA-256 would raise an error.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shuffle_parts, staged, table

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of distinct texts that a table holds before it is partitioned.
TABLE_BYTES = 96 << 20
FANOUT = 16

_RECORD = "sha binary, content binary, points long, doc_id long, n long"
_OUT = pa.schema([("sha", pa.binary()), ("content", pa.binary()), ("points", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def _better(a: tuple, b: tuple) -> tuple:
    """(points, doc_id): more code points, then the smaller id, null last."""
    ka = (-a[0], a[1] is None, a[1] or 0)
    kb = (-b[0], b[1] is None, b[1] or 0)
    return a if ka <= kb else b


def _fold(table: dict, content: bytes, sha: bytes, points: int, doc_id, n: int) -> int:
    """Adds a record to the table; the bytes that it grew by."""
    old = table.get(content)
    if old is None:
        table[content] = (sha, points, doc_id, n)
        return len(content) + 200
    best = _better((old[1], old[2]), (points, doc_id))
    table[content] = (sha, best[0], best[1], old[3] + n)
    return 0


def _records(table: dict, step: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    cols, size = [[], [], [], [], []], 0
    for content, (sha, points, doc_id, n) in table.items():
        for c, v in zip(cols, (sha, content, points, doc_id, n), strict=True):
            c.append(v)
        size += len(content) + 60
        if size > step:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
            cols, size = [[], [], [], [], []], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def _normal(batch: pa.RecordBatch) -> Iterator[tuple]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        buf = text.as_buffer() if text.is_valid else None
        raw = buf.to_pybytes() if buf is not None else b""
        yield doc_id, raw, raw.translate(None, SPACES)


def _points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def _precombine(table_bytes: int):
    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for doc_id, raw, content in _normal(batch):
                size += _fold(held, content, hashlib.sha256(content).digest(), _points(raw), doc_id, 1)
                if size > table_bytes:
                    yield from _records(held)
                    held, size = {}, 0
        yield from _records(held)

    return run


def grace(records: Iterator[tuple], table_bytes: int, depth: int = 0) -> Iterator[dict]:
    """Tables (content → sha, points, doc_id, n) that together hold every record, each text in one."""
    held: dict = {}
    size = 0
    for rec in records:
        size += _fold(held, *rec)
        if size > table_bytes and len(held) > 1 and depth < 16:
            break
    else:
        yield held
        return
    files = [tempfile.TemporaryFile() for _ in range(FANOUT)]
    try:
        out = [pickle.Pickler(f, protocol=5) for f in files]

        def spill(rec: tuple) -> None:
            i = (rec[1][8 + depth // 2] >> (4 * (depth % 2))) % FANOUT
            out[i].clear_memo()
            out[i].dump(rec)

        for content, (sha, points, doc_id, n) in held.items():
            spill((content, sha, points, doc_id, n))
        held = {}
        for rec in records:
            spill(rec)

        def back(f) -> Iterator[tuple]:
            f.seek(0)
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return

        for f in files:
            yield from grace(back(f), table_bytes, depth + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _reduce(table_bytes: int):
    kind = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches):
        def rows():
            for b in batches:
                sha, content, points, doc_id, n = (b.column(i) for i in range(5))
                yield from zip(content.to_pylist(), sha.to_pylist(), points.to_pylist(), doc_id.to_pylist(), n.to_pylist(), strict=True)

        for held in grace(rows(), table_bytes):
            shas = [v[0] for v in held.values()]
            if len(set(shas)) != len(shas):
                raise ValueError("two different texts share a SHA-256")
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array([v[2] for v in held.values()], pa.int64()), pa.array([v[3] for v in held.values()], pa.int64())], schema=kind)

    return run


def _digests(batches):
    for b in batches:
        ids, shas = [], []
        for doc_id, _, content in _normal(b):
            ids.append(doc_id)
            shas.append(hashlib.sha256(content).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.binary())], names=["doc_id", "sha"])


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(sha, keep_id, group_size), one row for each different text of ``docs`` (doc_id, text)."""
    two = docs.select(F.col("doc_id").cast("long"), "text")
    folded = two.mapInArrow(_precombine(table_bytes), _RECORD)
    dealt = folded.repartition(shuffle_parts(docs.sparkSession), "sha")
    return dealt.mapInArrow(_reduce(table_bytes), "sha binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = staged(exact_groups(docs, table_bytes), "exact-groups")
    two = docs.select(F.col("doc_id").cast("long"), "text")
    return (
        two.mapInArrow(_digests, "doc_id long, sha binary")
        .join(groups, "sha")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
