"""Mixing sources to target weights: capped water-filling, then seeded repetitions (native).

``mix_sources`` counts words, shares the words of the whole corpus among the sources by weight,
holds each source at ``max_epochs`` times its own size and reshares what that frees by weight
until no source is above its cap. Every document is then taken ``floor(target / size)`` times
whole, and a seeded selection of documents once more, so that a source's words come within half
a document of its target.

Only DataFrame functions are used. A source's documents stand in the order of a seeded MD5 of
(doc_id, size), and those before the cut are taken; the cut is found digit by digit: running sums
over 4,096 buckets, then over 4,096 within the bucket at the cut, and only what shares both digits
is ordered. Rows that repeat a (doc_id, size) are one entry with a count there; if the cut falls
among them, they are numbered by the partition that holds them. So neither a source nor a document
that holds a third of all rows meets in one task. Positions and running sums over the sources are
those of range partitions plus what stands before each, so sources may be as many as documents.

Defined results: null text counts 0 words; null source is a source of its own, last in order;
null or repeated doc_id rows are mixed like any other row; a table whose words are all 0 (or an
empty one) has targets 0 and takes nothing; of the table's columns only those asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import drop_staged, staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240607
#: A per-source table of at most this many rows (some 100 bytes each) is broadcast, a larger one joined.
BROADCAST_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _before(df: DataFrame, by: list[Column], name: str, **sums: Column) -> DataFrame:
    """``df`` in the order ``by``, with the sum of each of ``sums`` over the rows before.

    Range partitions are summed apart; what stands before a partition comes from one row for each.
    """
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("__part", F.shiftright("__at", 33)), name)
    parts = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(F.col("__part").alias("__p")).agg(*[F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()])
    base = base.select("__p", *[F.coalesce(F.sum(f"__sum_{k}").over(parts), F.lit(0)).alias(f"__base_{k}") for k in sums])
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(base), F.col("__part") == F.col("__p"))  # a row for each partition
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"__base_{k}"))
    return out.drop("__at", "__part", "__p", *[f"__base_{k}" for k in sums])


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) → adds weight and target.

    Closed form of the resharing loop: with sources by cap / weight, the first k are capped for
    the smallest k whose level (what is left / the weight left) the next source can take.
    """
    ranked = _before(sources, [F.col("source").asc_nulls_last()], "mix-order", pos=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = _before(ranked, [F.col("ratio"), F.col("pos")], "mix-caps", cap_before=F.col("cap"), w_before=F.col("weight"))
    ranked = staged(ranked, "mix-caps")
    total = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("total_w"))  # one row
    level = (F.col("total") - F.col("cap_before")) / (F.col("total_w") - F.col("w_before"))
    open_ = ranked.join(F.broadcast(total)).withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap"))
    answer = open_.agg(F.min(F.struct("ratio", "pos", "level"))["level"].alias("answer"))  # one row
    target = F.least(F.coalesce(F.col("answer") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return ranked.join(F.broadcast(answer)).select("source", "source_size", "weight", target.alias("target"))


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan


def _cut(rows: DataFrame, plan: DataFrame, digit: str, name: str) -> DataFrame:
    """``plan`` (s, room, …) with the bucket of ``digit`` that each source's room ends in, and the room left in it.

    ``rows`` are those that still compete for the room; a source that has room for all has no cut.
    """
    sums = staged(rows.groupBy("source", digit).agg(F.sum("size").alias("words")), name)  # 4,096 rows a source at most
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = sums.withColumn("upto", upto).join(_small(plan.select("s", "room")), F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("room"))
    first = over.groupBy("s").agg(F.min(F.struct(F.col(digit).alias("cut"), (F.col("room") - F.col("upto") + F.col("words")).alias("left"))).alias("at"))
    first = first.select(F.col("s").alias("s2"), F.col("at.cut").alias(f"cut_{digit}"), F.col("at.left").alias("left"))
    kept = [c for c in plan.columns if c != "room"]
    return staged(plan.join(first, F.col("s").eqNullSafe(F.col("s2")), "left").select(*kept, f"cut_{digit}", F.col("left").alias("room")), name)


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, times, taken), one for each row of ``docs``.

    ``carry`` names columns of ``docs`` that come along as ``__carry_<name>``, so that a caller needs no join.
    """
    extra = [F.col(c).alias(f"__carry_{c}") for c in carry or ()]
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra)
    sized = sized.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary")))
    digit = lambda i: F.conv(F.substring("h", i, 3), 16, 10).cast("int")
    sized = staged(sized.withColumns({"b1": digit(1), "b2": digit(4), "row": F.monotonically_increasing_id()}), "mix-sized")
    extra = [f"__carry_{c}" for c in carry or ()]

    slim = sized.select("doc_id", "source", "size", "h", "b1", "b2", "row")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(sums, weights, max_epochs)
    whole = F.least(F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)), F.lit(max_epochs)).cast("long")
    plan = targets.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"))
    plan = staged(plan.withColumn("room", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    plan = _cut(slim, plan, "b1", "mix-first")
    at = F.col("source").eqNullSafe(F.col("s"))
    inner = slim.join(_small(plan.select("s", "cut_b1")), at).where(F.col("b1") == F.col("cut_b1")).drop("s", "cut_b1")
    plan = _cut(inner, plan, "b2", "mix-second")

    # what shares both digits of its source's cut: entries of equal (doc_id, size), as many of each as fit
    edge = inner.join(_small(plan.select("s", "cut_b2", "room")), at).where(F.col("b2") == F.col("cut_b2"))
    entry = edge.groupBy("source", "h", "doc_id", "size", "room").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    entry = entry.withColumn("free", F.col("room") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    fit = F.coalesce(F.ceil(F.try_divide(F.col("free"), F.col("size").cast("double")) + 0.5) - 1, F.when(F.col("free") > 0, F.col("n")).otherwise(0))
    entry = entry.select(F.col("source").alias("es"), F.col("h").alias("eh"), F.col("doc_id").alias("ed"), F.col("size").alias("ez"), "n", F.greatest(F.lit(0), F.least(fit, F.col("n"))).cast("long").alias("fit"))
    entry = staged(entry, "mix-entries")
    same = F.col("source").eqNullSafe(F.col("es")) & (F.col("h") == F.col("eh")) & F.col("doc_id").eqNullSafe(F.col("ed")) & (F.col("size") == F.col("ez"))
    all_in = edge.join(_small(entry.where("fit = n")), same).select("row")
    # of an entry that fits in part (one a source at most) the first rows by partition and place are taken
    part = edge.join(_small(entry.where("fit > 0 and fit < n")), same).withColumn("part", F.shiftright("row", 33))
    part = staged(part.select("es", "part", "row", "fit"), "mix-part")
    base = part.groupBy(F.col("es").alias("s"), F.col("part").alias("p")).agg(F.count("*").alias("c"))
    base = base.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("es", "part").orderBy("row"))
    some_in = part.withColumn("nth", nth).join(base, F.col("es").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).where(F.col("base") + F.col("nth") <= F.col("fit")).select("row")
    taken_rows = staged(all_in.unionByName(some_in).select(F.col("row").alias("more_row")), "mix-edge")
    drop_staged(part, entry)

    rows = sized.join(_small(plan.drop("room")), at)
    in_edge = F.coalesce((F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")), F.lit(False))
    below = F.coalesce((F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2"))), F.lit(False))
    inside = rows.where(~in_edge).withColumn("more", below.cast("long"))
    at_edge = rows.where(in_edge).join(taken_rows, F.col("row") == F.col("more_row"), "left").withColumn("more", F.col("more_row").isNotNull().cast("long")).drop("more_row")
    times = F.least(F.col("whole") + F.col("more"), F.lit(max_epochs).cast("long"))
    both = inside.unionByName(at_edge)
    return both.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The level of the water by its definition: the lowest breakpoint at which all caps and shares hold the total.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source
), f AS (
  SELECT a.source_size * 3 / a.w AS edge, (SELECT sum(least(b.source_size * 3, a.source_size * 3 / a.w * b.w)) FROM s b) AS holds FROM s a
), lowest AS (
  SELECT min(edge) AS edge FROM f WHERE holds >= (SELECT sum(source_size) FROM s)
), level AS (
  SELECT (CAST((SELECT sum(source_size) FROM s) - coalesce(sum(source_size * 3) FILTER (WHERE source_size * 3 / w < edge), 0) AS DOUBLE) / CAST(sum(w) FILTER (WHERE source_size * 3 / w >= edge) AS DOUBLE)) AS level FROM s, lowest
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(level * w, CAST(source_size * 3 AS DOUBLE)) AS target FROM s, level
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), 3) END AS whole FROM t
), o AS (
  SELECT d.doc_id, d.size, p.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', {SEED}, d.doc_id, d.size)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, least(whole + CASE WHEN 2 * upto - size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END, 3) * size AS taken FROM o
"""
