"""Line dedup: repeated runs of lines by a suffix array over line IDs, built by prefix doubling.

A document is the sequence of its lines that hold a word; a line's ID is the 128-bit content name
of its bytes (see words.py for the bound). Level 0 ranks positions by line ID, level k + 1 by the
pair of level-k ranks at i and i + 2**k: the different pairs are sorted by range over the cluster
and numbered in that order, so ranks follow the order of the suffixes and positions of one rank
are an interval of the suffix array with a common prefix of 2**k lines. Ranks come from sorting, not
from hashes. Positions alone in their interval leave before the next level (no run that begins there
repeats); only repeated runs go on.

A run counts from ``min_words`` words. For each position the shortest such run that begins or ends
at it has some m lines; the suffixes that share their first m lines are the interval of common
prefix m around it, and two overlapping runs of 2**k lines, that is a pair of ranks, tell it. The
interval's first member by (doc_id, line) is the first copy; every member in another document, or
behind the end of the first in the same one, is a later copy (one that overlaps the first is none, so
that the first stays whole). Later copies laid over each other are the maximal repeated runs, and
their lines are deleted. As each line has a word, at most log2(min_words) + 1 levels are needed.

A line, run or interval that is very common costs no task more than others: counts combine before
the shuffle, and the few common keys' ranks are broadcast (hot_join).

Defined results: null text has no lines; a row without doc_id takes no part and stays as it is;
rows that repeat a doc_id are one document if their texts are equal, otherwise the text with the
smallest content name takes part and the others stay as they are; blank lines go with the deleted
lines around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import drop_staged, freed, hot_join, list_array, raw_bytes, sieve, sieved, slices, staged, table
from .words import bounds, content_name

MIN_WORDS = 50
_DOC = "doc_id long, text_name binary, high array<long>, low array<long>, ahead array<int>, behind array<int>"


def _lines(data: np.ndarray, offsets: np.ndarray):
    """(start, end, first) of the lines by row, the line feed not included."""
    n = len(data)
    feed = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feed, "right") - 1
    start = np.sort(np.concatenate([offsets[:-1], feed + 1]), kind="stable")
    end = np.sort(np.concatenate([feed, offsets[1:]]), kind="stable")
    count = np.bincount(row, minlength=len(offsets) - 1) + 1
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=first[1:])
    # a row's own boundaries sort before those of the next row: both lists have one entry a line
    return start, end, first, n


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line: lines in the shortest run of ``least`` words from it on, and up to it (0: none)."""
    sums = np.append(0, np.cumsum(words))
    i = np.arange(len(words))
    to = np.searchsorted(sums, sums[:-1] + least, "left")
    ahead = np.where(to <= len(words), to - i, 0)
    at = np.searchsorted(sums, sums[1:] - least, "right") - 1
    behind = np.where(sums[1:] >= least, i + 1 - at, 0)
    return ahead, behind


def _rows(text):
    """Yields (row, bytes, starts of lines, their ends, words in them)."""
    data, offsets = raw_bytes(text)
    for i, j in slices(offsets, 2 << 20):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, first, _ = _lines(part, off)
        ws, _, _ = bounds(part, off)
        words = np.searchsorted(ws, end, "left") - np.searchsorted(ws, start, "left")
        raw = part.tobytes()
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            yield i + r, raw[off[r] : off[r + 1]], start[a:b] - off[r], end[a:b] - off[r], words[a:b]


def _scan(least: int):
    def run(batches):
        for batch in batches:
            names, whole, ahead, behind, n = [], [], [], [], []
            for _, raw, start, end, words in _rows(batch.column("text")):
                has = words > 0
                x, y = _windows(words[has], least)
                ahead.append(x)
                behind.append(y)
                n.append(len(x))
                names += [content_name(raw[a:b]) for a, b in zip(start[has].tolist(), end[has].tolist(), strict=True)]
                whole.append(content_name(raw))
            n = np.array(n, np.int64)
            half = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            cat = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
            lists = [list_array(half[:, c], n, pa.int64()) for c in (0, 1)] + [list_array(cat(x), n, pa.int32()) for x in (ahead, behind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.binary()), *lists], names=["doc_id", "text_name", "high", "low", "ahead", "behind"])

    return run


def _ranked(rows: DataFrame, by: list[str], total: int, name: str) -> DataFrame:
    """``rows`` whose key ``by`` another row has too, with that key's rank: a number in the keys' order."""
    many = rows.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1")
    # numbers grow within a partition and from one to the next; staged at once, as a second run may deal other partitions
    keys = staged(many.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "__n", F.monotonically_increasing_id().alias("__rank")), f"{name}-keys")
    out = staged(hot_join(rows, keys, by, "__n", total).drop(*by, "__n").withColumnRenamed("__rank", "rank"), name)
    drop_staged(keys)
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): runs (doc, i, m) are later copies of m lines from i on, which may overlap;
    documents (doc, text_name, n_lines) are those that took part."""
    two = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    scanned = staged(two.mapInArrow(freed(_scan(min_words)), _DOC), "lines")
    one = scanned.groupBy("doc_id").agg(F.min(F.struct("text_name", "high", "low", "ahead", "behind")).alias("d"))
    one = staged(one.select(F.col("doc_id").alias("doc"), "d.*"), "lines")
    drop_staged(scanned)
    total = one.agg(F.sum(F.size("high"))).first()[0] or 0
    pos = one.select("doc", F.posexplode(F.arrays_zip("high", "low", "ahead", "behind")).alias("i", "z")).select("doc", "i", "z.*")
    level = _ranked(pos, ["high", "low"], total, "level0")

    first = level.select("doc", "i", F.col("ahead").alias("m")).where("m > 0")
    last = level.where("behind > 0").select("doc", (F.col("i") - F.col("behind") + 1).alias("i"), F.col("behind").alias("m"))
    windows = first.unionByName(last).distinct().withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int"))

    levels = [level.select("doc", "i", "rank")]
    while 2 ** len(levels) <= min_words:
        h = 2 ** (len(levels) - 1)
        there = Window.partitionBy("doc").orderBy("i").rangeBetween(h, h)
        paired = levels[-1].withColumn("next", F.max("rank").over(there)).where("next is not null")
        paired = staged(paired.select("doc", "i", F.col("rank").alias("one"), F.col("next").alias("two")), "pairs")
        levels.append(_ranked(paired, ["one", "two"], paired.count(), f"level{len(levels)}"))
        drop_staged(paired)

    every = levels[0].withColumn("k", F.lit(0))
    for k, x in enumerate(levels[1:], 1):
        every = every.unionByName(x.withColumn("k", F.lit(k)))
    a = every.select(F.col("doc").alias("d1"), F.col("i").alias("i1"), F.col("k").alias("k1"), F.col("rank").alias("r1"))
    b = every.select(F.col("doc").alias("d2"), F.col("i").alias("i2"), F.col("k").alias("k2"), F.col("rank").alias("r2"))
    back = F.col("i") + F.col("m") - F.expr("shiftleft(1, k)")
    named = windows.withColumn("j", back).join(a, (F.col("doc") == F.col("d1")) & (F.col("i") == F.col("i1")) & (F.col("k") == F.col("k1")))
    named = named.join(b, (F.col("doc") == F.col("d2")) & (F.col("j") == F.col("i2")) & (F.col("k") == F.col("k2")))
    named = staged(named.select("doc", "i", "m", "r1", "r2"), "runs")
    interval = ["m", "r1", "r2"]
    origin = named.groupBy(*interval).agg(F.min(F.struct("doc", "i")).alias("o"), F.count("*").alias("n")).where("n > 1")
    origin = staged(origin, "origins")
    later = (F.col("doc") != F.col("o.doc")) | (F.col("o.i") + F.col("m") <= F.col("i"))
    runs = staged(hot_join(named, origin, interval, "n", named.count()).where(later).select("doc", "i", "m").distinct(), "later")
    drop_staged(level, named, origin, *levels[1:])
    return one.select("doc", "text_name", F.size("high").alias("n_lines")), runs


def _merged(runs: DataFrame) -> DataFrame:
    """(doc, spans): the maximal runs of each document, as disjoint [first, last + 1) line ranges.

    A document's ranges are gathered, which a document bounds by its own lines."""
    by = Window.partitionBy("doc").orderBy("i", "m").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("i") > F.max(F.col("i") + F.col("m")).over(by), F.lit(True)).cast("int")
    marked = runs.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(Window.partitionBy("doc").orderBy("i", "m").rowsBetween(Window.unboundedPreceding, 0)))
    span = marked.groupBy("doc", "g").agg(F.min("i").alias("lo"), F.max(F.col("i") + F.col("m")).alias("hi"))
    return span.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): one row a document; removed lists 'first-last' of its
    lines with words, counted from 0."""
    who, runs = repeated_runs(docs, min_words)
    cut = _merged(runs).withColumnRenamed("doc", "d")
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["lo"], s["hi"] - 1)))
    gone = F.aggregate("spans", F.lit(0), lambda n, s: n + s["hi"] - s["lo"])
    rows = who.join(cut, F.col("doc") == F.col("d"), "left")
    return rows.select(F.col("doc").alias("doc_id"), "n_lines", F.coalesce(gone, F.lit(0)).alias("n_removed"), F.coalesce(text, F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from its texts (n_chars follows, where there is one).

    Documents of which no line is left are copies as a whole and go. Texts that keep all lines are
    not shuffled: a sieve tells nearly all of them.
    """
    who, runs = repeated_runs(docs, min_words)
    # own columns carry a prefix, so that a table's further columns can't clash with them
    cut = _merged(runs).select(F.col("doc").alias("__line_doc"), F.col("spans").alias("__line_spans"))
    cut = cut.join(who.select(F.col("doc").alias("__line_who"), F.col("text_name").alias("__line_name")), F.col("__line_doc") == F.col("__line_who")).drop("__line_who")
    cut = staged(cut, "cuts")
    drop_staged(runs)
    seen = sieved(docs, "doc_id", sieve(cut, "__line_doc"))
    joined = seen.where("__may").join(cut.hint("shuffle_hash"), F.col("doc_id") == F.col("__line_doc"), "left")
    names = list(docs.columns)

    def run(batches):
        for batch in batches:
            spans, want = batch.column("__line_spans").to_pylist(), batch.column("__line_name").to_pylist()
            text, keep_row = batch.column("text").to_pylist(), []
            for r, raw, start, end, words in _rows(batch.column("text")):
                if not spans[r] or want[r] != content_name(raw):
                    spans[r] = None
                    keep_row.append(True)
                    continue
                has = words > 0
                at, keep = np.flatnonzero(has), np.ones(len(start), bool)
                for s in spans[r]:
                    keep[at[s["lo"]] : at[s["hi"] - 1] + 1] = False
                text[r] = b"\n".join(raw[start[x] : end[x]] for x in np.flatnonzero(keep)).decode("utf-8", "replace")
                keep_row.append(bool((keep & has).any()))
            cols = [batch.column(c) for c in names]
            cols[names.index("text")] = pa.array(text, pa.string())
            if "n_chars" in names:
                sizes = [len(t) if s and t is not None else n for t, s, n in zip(text, spans, batch.column("n_chars").to_pylist(), strict=True)]
                cols[names.index("n_chars")] = pa.array(sizes, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep_row, pa.bool_()))

    cleaned = joined.select(*names, "__line_spans", "__line_name").mapInArrow(freed(run), docs.schema)
    return seen.where(~F.col("__may")).select(*names).unionByName(cleaned)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line, len(ls) AS n FROM d
), w AS (
  SELECT *, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
         sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) - len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS before
  FROM l
), pairs AS (
  SELECT a.doc_id, a.i, b.i AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= {MIN_WORDS}
), windows AS (
  SELECT doc_id, i, min(j) AS j FROM pairs GROUP BY 1, 2 UNION SELECT doc_id, max(i), j FROM pairs GROUP BY doc_id, j
), named AS (
  SELECT doc_id, i, j, array_to_string(ls[i + 1 : j + 1], chr(10)) AS run FROM windows JOIN d USING (doc_id)
), origin AS (
  SELECT doc_id, i, j, first_value(doc_id) OVER f AS first_doc, first_value(i) OVER f AS first_i FROM named WINDOW f AS (PARTITION BY run ORDER BY doc_id, i)
), later AS (
  SELECT doc_id, i, j FROM origin WHERE doc_id <> first_doc OR i > first_i + (j - i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later
), isle AS (
  SELECT doc_id, min(i) AS lo, max(i) AS hi, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g
), text AS (
  SELECT doc_id, sum(n) AS n_removed, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed FROM isle GROUP BY 1
)
SELECT doc_id, CAST(len(ls) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN text USING (doc_id)
"""
