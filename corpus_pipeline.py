"""The corpus pipeline: documents through five operators of tickloom.llm, each fully applied.

``run(spark, sf_dir)`` writes every stage's rows as Parquet in the shared folder and hands the
next stage what it reads back, so a lost executor never repeats an earlier stage. All stages but
the last return the columns of documents.

No stage shuffles the texts to apply a decision: scores and repetitions are written with the rows
they belong to, and for the two dedup stages a sieve of bounded size lets rows pass that no decision
concerns. Rows without a doc_id, and different rows that repeat one, are judged each by itself (only
the line stage leaves rows without doc_id as they are).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import lines, minhash, mixing, packing, quality
from tickloom.llm.base import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _carried(rows: DataFrame, *more) -> DataFrame:
    return rows.select(*[F.col(f"__carry_{c}").alias(c) for c in COLUMNS], *more)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return _carried(quality.resample(docs, table(spark, sf_dir, "labels"), carry=list(COLUMNS)).where("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; wholly copied documents go."""
    return lines.dedup_lines(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5 words, similarity 0.8)."""
    return minhash.drop_copies(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; copies of a document are equal rows."""
    taken = mixing.mix_sources(docs, carry=list(COLUMNS)).where("times > 0")
    return _carried(taken, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__copy")).drop("__copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 1,024."""
    return packing.pack(docs)


STAGES = [
    ("quality", select_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Gumbel noise, 64-bit hashes and BPE ids have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
