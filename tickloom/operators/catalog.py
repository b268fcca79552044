"""Session catalog, coverage, duplicates, bundle checks, positional merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import finite_or_null
from ..sources.quotes import KEY, by_row
from .evaluate import require


def session_catalog(df: DataFrame) -> DataFrame:
    """(KEY, n_rows, first_ms, last_ms, monotonic, bad_quotes): one row a session."""
    step = df.withColumn("d_", F.col("t_ms") - F.lag("t_ms").over(by_row()))
    return step.groupBy(*KEY).agg(
        F.count("*").alias("n_rows"),
        F.min_by("t_ms", "row_idx").alias("first_ms"),
        F.max_by("t_ms", "row_idx").alias("last_ms"),
        F.coalesce(F.min("d_") >= 0, F.lit(True)).alias("monotonic"),
        F.count_if(~F.col("ok")).alias("bad_quotes"),
    )


def dt_sample(df: DataFrame, rows: int = 200) -> DataFrame:
    """(KEY, n, median_ms, p99_ms) of the positive steps among a session's first ``rows`` rows, by index not interpolation."""
    head = df.where(F.col("row_idx") < rows).withColumn("d_", F.col("t_ms") - F.lag("t_ms").over(by_row()))
    one = head.groupBy(*KEY).agg(F.count("t_ms").alias("stamps"), F.sort_array(F.collect_list(F.when(F.col("d_") > 0, F.col("d_")))).alias("d"))
    one = one.where((F.col("stamps") >= 3) & (F.size("d") > 0)).withColumn("n", F.size("d"))
    at = lambda i: F.element_at("d", i.cast("int") + 1)
    return one.select(*KEY, "n", at(F.floor(F.col("n") / 2)).alias("median_ms"), at(F.floor(0.99 * (F.col("n") - 1))).alias("p99_ms"))


def coverage_missing(present: DataFrame, stocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions of the calendar (date, session) that a stock lacks; both lists are small dimensions."""
    want = stocks.select("stock_code").distinct().crossJoin(F.broadcast(sessions.select("date", "session").distinct()))
    return want.join(present.select(*KEY).distinct(), list(KEY), "left_anti").select(*KEY)


def duplicate_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*KEY).agg(F.count("*").alias("times")).where("times > 1")


def calendar_history(sessions: DataFrame, days: int) -> DataFrame:
    """(KEY, past_date): the ``days`` last earlier dates of the same stock and session number."""
    ranked = sessions.select(*KEY).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("stock_code", "session").orderBy("date")))
    ahead = ranked.select("stock_code", "session", F.col("date").alias("past_date"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + days)).alias("rank"))
    return ranked.join(ahead, ["stock_code", "session", "rank"]).select(*KEY, "past_date")


def positional_merge(left: DataFrame, right: DataFrame, file: str = "file") -> DataFrame:
    """Rows of two files joined by position (file, row_idx); unequal lengths fail; a name that is taken gets the first free _txt1, _txt2…"""
    taken, names = set(left.columns), {}
    for c in right.columns:
        if c not in (file, "row_idx"):
            names[c] = next(n for n in (c, *(f"{c}_txt{k}" for k in range(1, len(taken) + 2))) if n not in taken)
            taken.add(names[c])
    renamed = right.withColumnsRenamed(names)
    mark = lambda d, c: d.withColumn(c, F.lit(True))
    both = mark(left, "l_").join(mark(renamed, "r_"), [file, "row_idx"], "full_outer")
    require(both.where("l_ is null or r_ is null").select(file, "row_idx"), "files differ in length")
    return both.drop("l_", "r_")


def check_bundle(predictions: DataFrame, order: str = "end_row") -> DataFrame:
    """(KEY, problem) for sessions whose predictions, as stored (column ``order`` tells how), are not one run of
    strictly increasing rows with finite predictions and known times that never fall."""
    w = Window.partitionBy(*KEY).orderBy(order)
    p = predictions.withColumns({"pr_": F.lag("end_row").over(w), "pt_": F.lag("t_ms").over(w)})
    faults = {
        "end_row": F.col("end_row").isNull() | (F.col("end_row") < 0),
        "order": F.col("pr_") >= F.col("end_row"),
        "pred": finite_or_null(F.col("pred").cast("double")).isNull(),
        "time": F.col("t_ms").isNull() | (F.col("pt_") > F.col("t_ms")),
    }
    every = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults.items()]))
    return p.select(*KEY, F.explode(every).alias("problem")).distinct()


def run_block_mismatch(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(KEY, run_start) of runs whose blocks (KEY, run_start, block_start, block_len) don't cover them once, and of blocks without their run."""
    w = Window.partitionBy(*KEY, "run_start").orderBy("block_start")
    b = blocks.withColumn("over_", F.lag(F.col("block_start") + F.col("block_len")).over(w) != F.col("block_start"))
    got = b.groupBy(*KEY, "run_start").agg(F.min("block_start").alias("from_"), F.max(F.col("block_start") + F.col("block_len")).alias("to_"), F.coalesce(F.max("over_"), F.lit(False)).alias("over_"), F.min("block_len").alias("least_"))
    both = runs.select(*KEY, "run_start", "run_len").join(got, [*KEY, "run_start"], "full_outer")
    fine = ~F.col("over_") & (F.col("least_") > 0) & (F.col("from_") == F.col("run_start")) & (F.col("to_") == F.col("run_start") + F.col("run_len"))
    return both.where(~F.coalesce(fine, F.lit(False))).select(*KEY, "run_start")
