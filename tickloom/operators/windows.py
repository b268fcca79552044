"""Order-sensitive window operators on sessions (KEY, row_idx, t_ms)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import finite_or_null
from ..sources.quotes import KEY, by_row, by_time

INVALID_NOW, SHORT_HORIZON, TOO_FEW, NOT_FINITE = 1, 2, 4, 8


def upto(ms: int):
    """Frame of all rows of the session up to ``ms`` after the current time."""
    return by_time().rangeBetween(Window.unboundedPreceding, ms)


def future_label(df: DataFrame, low_ms: int, high_ms: int, min_future: int = 1, full_horizon: bool = True) -> DataFrame:
    """Mean valid price in [t + low, t + high] over the current price, minus 1, with reasons.

    Sums over the sliding interval are differences of two running frames, which share one sort;
    a sliding frame would aggregate anew for every row. Adds lo, hi (first and last row of the
    interval), future_count, future_sum, invalid_reason, is_valid, r_raw.
    """
    has = F.col("mid2").isNotNull().cast("long")
    a, b = upto(low_ms - 1), upto(high_ms)
    df = df.withColumns(
        {
            "lo": F.count("*").over(a),
            "hi": F.count("*").over(b) - 1,
            "future_count": F.sum(has).over(b) - F.coalesce(F.sum(has).over(a), F.lit(0)),
            "future_sum": F.coalesce(F.sum("mid2").over(b), F.lit(0)) - F.coalesce(F.sum("mid2").over(a), F.lit(0)),
            "t_last": F.max("t_ms").over(Window.partitionBy(*KEY)),
        }
    )
    need = high_ms if full_horizon else low_ms
    bit = lambda bad, flag: F.when(bad, flag).otherwise(0)
    reason = (
        bit(F.col("mid2").isNull(), INVALID_NOW)
        + bit(F.col("t_ms") + need > F.col("t_last"), SHORT_HORIZON)
        + bit(F.col("future_count") < min_future, TOO_FEW)
    )
    raw = F.try_divide(F.col("future_sum").cast("double"), (F.col("future_count") * F.col("mid2")).cast("double")) - 1
    df = df.withColumn("r0", raw)
    reason = reason + bit((reason == 0) & (F.col("r0").isNull() | F.isnan("r0")), NOT_FINITE)
    df = df.withColumn("invalid_reason", reason.cast("int")).withColumn("is_valid", F.col("invalid_reason") == 0)
    return df.withColumn("r_raw", F.when(F.col("is_valid"), F.col("r0"))).drop("r0", "t_last")


def lead_label(df: DataFrame, offset: int, multiplier: int, max_span_ms: int | None = None) -> DataFrame:
    """(price ``offset`` rows ahead - price) * multiplier, NULL unless both prices are valid and near in time."""
    w = by_row()
    ahead, then = F.lead("mid2", offset).over(w), F.lead("t_ms", offset).over(w)
    ok = F.col("mid2").isNotNull() & ahead.isNotNull()
    if max_span_ms is not None:
        ok = ok & (then - F.col("t_ms") <= max_span_ms)
    return df.withColumn("lead_label", F.when(ok, (ahead - F.col("mid2")) * multiplier))


def legacy_window_label(df: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """Older rule: an empty future counts as no move (0); valid once the interval begins before the end."""
    df = future_label(df, low_ms, high_ms, 1, full_horizon=False)
    move = F.try_divide(F.col("future_sum").cast("double"), (F.col("future_count") * F.col("mid2")).cast("double")) - 1
    ok = F.col("mid2").isNotNull() & (F.col("invalid_reason").bitwiseAND(SHORT_HORIZON) == 0)
    return df.withColumn("legacy_label", F.when(ok, F.coalesce(move, F.lit(0.0))))


def forward_fill(df: DataFrame, columns: Sequence[str], value=0) -> DataFrame:
    """Last value so far in the session, else ``value`` (None leaves NULL); one window for all columns."""
    w = by_row().rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in columns}
    return df.withColumns({c: v if value is None else F.coalesce(v, F.lit(value)) for c, v in filled.items()})


def rolling(column: Column, rows: int, least: int, what=F.sum) -> Column:
    """Trailing aggregate over ``rows`` rows, NULL below ``least`` values."""
    w = by_row().rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(w) >= least, what(column).over(w))


def ewm(df: DataFrame, column: str, span: int, out: str) -> DataFrame:
    """Exponential mean (adjust=False, missing values decay the weight) by session.

    The one recurrence that no window expresses: a grouped Arrow function that sees only the key,
    the order and the value. Sessions are bounded by a trading day.
    """
    fields = [f for f in df.schema.fields if f.name in KEY]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", row_idx long, {out} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", kind="stable")
        pdf[out] = pdf[column].astype("float64").ewm(span=span, adjust=False, ignore_na=False).mean()
        return pdf[[f.name for f in fields] + ["row_idx", out]]

    slim = df.select(*KEY, "row_idx", F.col(column).cast("double").alias(column))
    return df.join(slim.groupBy(*KEY).applyInPandas(run, schema), [*KEY, "row_idx"])


def window_eligible(df: DataFrame, rows: int, max_span_ms: int = 0, max_gap_ms: int = 0, weight: Column | None = None) -> DataFrame:
    """Adds end_ok: may a trailing window of ``rows`` rows end here? 0 switches a limit off; a weight must be finite and above 0.

    Also adds span_bad and gap_bad, the exclusions among rows with enough history and weight.
    """
    w = by_row()
    df = df.withColumn("gap_", F.col("t_ms") - F.lag("t_ms").over(w))
    inside = w.rowsBetween(2 - rows, 0)
    enough = (F.col("row_idx") >= rows - 1) & (F.lit(True) if weight is None else F.coalesce(finite_or_null(weight) > 0, F.lit(False)))
    span = F.col("t_ms") - F.lag("t_ms", rows - 1).over(w)
    gap_bad = F.coalesce(F.min("gap_").over(inside) < 0, F.lit(False)) if rows > 1 else F.lit(False)
    if max_gap_ms and rows > 1:
        gap_bad = gap_bad | F.coalesce(F.max("gap_").over(inside) > max_gap_ms, F.lit(False))
    span_bad = F.coalesce(span > max_span_ms, F.lit(False)) if max_span_ms else F.lit(False)
    known = F.count("t_ms").over(w.rowsBetween(1 - rows, 0)) == rows
    df = df.withColumns({"enough_": enough & known, "span_bad": enough & span_bad, "gap_bad": enough & gap_bad})
    return df.withColumn("end_ok", F.col("enough_") & ~F.col("span_bad") & ~F.col("gap_bad")).drop("gap_", "enough_")


def islands(df: DataFrame, flag: Column | str) -> DataFrame:
    """(KEY, run_start, run_len) of maximal runs of adjacent rows for which ``flag`` holds.

    Runs are over row_idx, so rows missing from ``df`` break a run too.
    """
    on = df.where(flag if isinstance(flag, Column) else F.col(flag))
    on = on.withColumn("island_", F.col("row_idx") - F.row_number().over(by_row()))
    return on.groupBy(*KEY, "island_").agg(F.min("row_idx").alias("run_start"), F.count("*").alias("run_len")).drop("island_")


def blocks(runs: DataFrame, most: int) -> DataFrame:
    """Runs cut into blocks of at most ``most`` rows: (KEY, run_start, block_start, block_len)."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(run_len - 1) div {most}"))).alias("n_")
    cut = runs.select(*KEY, "run_start", "run_len", n)
    start = F.col("run_start") + F.col("n_") * most
    return cut.select(*KEY, "run_start", start.alias("block_start"), F.least(F.lit(most), F.col("run_len") - F.col("n_") * most).cast("long").alias("block_len"))


def window_arrays(df: DataFrame, columns: Sequence[str], rows: int, end_ok: Column | str = "end_ok") -> DataFrame:
    """At each eligible end row: ``history`` (array of structs) and ``rel_ms``, times from the window's first row.

    Arrays exist only here, at the consumer; windows are never stored.
    """
    w = by_row().rowsBetween(1 - rows, 0)
    got = df.withColumn("history", F.collect_list(F.struct("t_ms", *columns)).over(w)).where(end_ok if isinstance(end_ok, Column) else F.col(end_ok))
    return got.withColumn("rel_ms", F.transform("history", lambda z: z["t_ms"] - F.col("history")[0]["t_ms"]))


def strided_sample(df: DataFrame, valid: Column | str, most: int) -> DataFrame:
    """Every stride-th valid row of a session, stride = max(1, n div most), ``most`` at most."""
    on = df.where(valid if isinstance(valid, Column) else F.col(valid))
    on = on.withColumn("n_", F.count("*").over(Window.partitionBy(*KEY))).withColumn("rn_", F.row_number().over(by_row()) - 1)
    on = on.withColumn("stride_", F.greatest(F.lit(1), F.expr(f"n_ div {most}")))
    return on.where((F.col("rn_") % F.col("stride_") == 0) & (F.expr("rn_ div stride_") < most)).drop("n_", "rn_", "stride_")


def batches(df: DataFrame, size: int, keep_tail: bool = True) -> DataFrame:
    """Adds batch_id: ``size`` consecutive rows of a session; a short last batch may go."""
    out = df.withColumn("batch_id", F.expr(f"(row_number() OVER (PARTITION BY {', '.join(KEY)} ORDER BY row_idx) - 1) div {size}"))
    if keep_tail:
        return out
    return out.withColumn("n_", F.count("*").over(Window.partitionBy(*KEY, "batch_id"))).where(F.col("n_") == size).drop("n_")


def average_rank(column: str, partition: Sequence[str] = ()) -> Column:
    """Rank from 1, ties share their average."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*partition, column)) - 1) / F.lit(2.0)
