"""Session files: CSV with a header, discovered by name, one row order per file; text side files; sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.price import finite_or_null

#: code_date_session, whatever follows.
NAME = r"([A-Za-z0-9]+)_(\d{8})_(\d+)(?:_[^/]*)?\.(?:csv|txt)$"


def discover(spark: SparkSession, path: str, glob: str = "*.csv", stocks: Sequence[str] = (), dates: tuple[str, str] | None = None, sessions: Sequence[int] = ()) -> DataFrame:
    """(path, size, stock_code, date, session), filtered on names before any file is read, in catalog order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"))
    part = lambda i: F.regexp_extract("path", NAME, i)
    f = f.select("*", part(1).alias("stock_code"), part(2).alias("date"), part(3).try_cast("int").alias("session")).where("stock_code <> ''")
    if stocks:
        f = f.where(F.col("stock_code").isin(*stocks))
    if dates:
        f = f.where(F.col("date").between(*dates))
    if sessions:
        f = f.where(F.col("session").isin(*sessions))
    return f.orderBy("date", "session", "stock_code", "path")


def _numbered(df: DataFrame) -> DataFrame:
    """Adds row_idx: whole files stay in one partition, so monotonic ids order a file's rows as written."""
    w = Window.partitionBy("file").orderBy("order_")
    return df.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long")).drop("order_")


def read_sessions(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str], strings: Sequence[str] = ()) -> DataFrame:
    """(stock_code, date, session, row_idx, columns): doubles, what is no finite number is NULL.

    Column order in the files does not matter; a missing column fails. multiLine keeps a file in
    one partition, which its row order needs.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("recursiveFileLookup", "true").csv(list(paths) if not isinstance(paths, str) else paths)
    if lost := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"columns are missing: {lost}")
    value = lambda c: F.col(c) if c in strings else finite_or_null(F.col(c).try_cast("double"))
    file = F.col("_metadata.file_path")
    df = raw.select(file.alias("file"), F.monotonically_increasing_id().alias("order_"), *[value(c).alias(c) for c in columns])
    part = lambda i: F.regexp_extract("file", NAME, i)
    df = _numbered(df)
    return df.select(part(1).alias("stock_code"), part(2).alias("date"), part(3).try_cast("int").alias("session"), "row_idx", *columns)


def read_text_columns(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(file, row_idx, names) of white-space separated text; blank lines don't count, another number of fields fails."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("row_idx", "line"))
    cells = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    width = F.when(F.size(cells) != len(names), F.raise_error(F.concat(F.lit("fields in "), F.col("file"))).cast("string"))
    return raw.select("file", F.col("row_idx").cast("long"), *[F.coalesce(width, F.element_at(cells, i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])


def factor_columns(columns: Sequence[str], prefixes: Sequence[str], count: int) -> list[str]:
    """The first prefix with all of prefix0..prefix{count-1}, else the one with most of them."""
    have = {p: [f"{p}{i}" for i in range(count) if f"{p}{i}" in columns] for p in prefixes}
    full = [p for p in prefixes if len(have[p]) == count]
    best = full[0] if full else max(prefixes, key=lambda p: len(have[p]))
    return have[best]


def renumbered(df: DataFrame, columns: Sequence[str], prefix: str, start: int = 0, keep: Sequence[str] = (), append: bool = True) -> DataFrame:
    """Output columns named prefix{start}…; with append=False only those and ``keep`` remain."""
    names = [F.col(c).alias(f"{prefix}{start + i}") for i, c in enumerate(columns)]
    rest = [c for c in df.columns if c not in columns] if append else list(keep)
    return df.select(*rest, *names)


def write_sessions(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Partitioned by date and stock; mode 'ignore' skips what is there, committing is atomic."""
    df.write.format(kind).mode(mode).option("header", "true").partitionBy("date", "stock_code").save(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def missing_from(df: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is still to do: rows whose key an earlier output lacks."""
    return df.join(there.select(*keys).distinct(), list(keys), "left_anti")
