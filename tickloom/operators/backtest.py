"""Persistent-signal positions, trade segments, their profit, and daily results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.quotes import KEY, by_row
from .evaluate import require


@dataclass(frozen=True)
class Costs:
    """Rates of turnover: both legs pay ``commission``, the selling leg also ``stamp``."""

    commission: float = 0.0002
    stamp: float = 0.0005

    def of(self, direction: Column, entry: Column, exit_: Column) -> Column:
        """Cost as a share of the entry price."""
        opening = self.commission + F.when(direction < 0, self.stamp).otherwise(0.0)
        closing = self.commission + F.when(direction > 0, self.stamp).otherwise(0.0)
        return opening + closing * exit_ / entry


def require_order(calibration: tuple[str, str], trading: list[tuple[str, str]]) -> None:
    """Thresholds must come from dates before every traded split."""
    for first, _ in trading:
        if calibration[1] >= first:
            raise ValueError(f"calibration ends {calibration[1]}, trading starts {first}")


def positions(df: DataFrame, long_above: Column, short_below: Column) -> DataFrame:
    """position: the last signal so far on executable rows with a prediction (strict thresholds), 0 before any."""
    pred = F.when(F.col("ok") & F.col("pred").isNotNull(), F.col("pred"))
    signal = F.when(pred > long_above, 1).when(pred < short_below, -1)
    held = F.last(signal, ignorenulls=True).over(by_row().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("position", F.coalesce(held, F.lit(0)).cast("int"))


def segments(df: DataFrame) -> DataFrame:
    """Trades (KEY, direction, entry_row, exit_row, prices): entered where the position changes, left at the
    next change or on the session's last row, which opens none. terminal_ok: can that row be traded?
    """
    w, every = by_row(), Window.partitionBy(*KEY)
    df = df.withColumns({"last_row": F.max("row_idx").over(every), "change_": F.col("position") != F.coalesce(F.lag("position").over(w), F.lit(0))})
    end = F.max_by(F.struct("ok", "bid_tk", "ask_tk"), "row_idx").over(every)
    df = df.withColumn("end_", end)
    on = df.where("change_ and row_idx < last_row")
    nxt = lambda c: F.lead(c).over(w)
    on = on.withColumns({"exit_row": F.coalesce(nxt("row_idx"), F.col("last_row")), "exit_bid": F.coalesce(nxt("bid_tk"), F.col("end_.bid_tk")), "exit_ask": F.coalesce(nxt("ask_tk"), F.col("end_.ask_tk"))})
    on = on.withColumn("terminal_ok", (F.col("exit_row") != F.col("last_row")) | F.col("end_.ok")).where("position <> 0")
    long = F.col("position") > 0
    return on.select(
        *KEY,
        F.col("position").alias("direction"),
        F.col("row_idx").alias("entry_row"),
        "exit_row",
        F.when(long, F.col("ask_tk")).otherwise(F.col("bid_tk")).alias("entry_tk"),
        F.when(long, F.col("exit_bid")).otherwise(F.col("exit_ask")).alias("exit_tk"),
        "terminal_ok",
    )


def segment_problems(df: DataFrame) -> DataFrame:
    """(KEY, row_idx, problem): an open position at a last quote that can't be traded, or a change on such a row.

    A session with one has no result: leaving the trade out would hide what it lost.
    """
    w = by_row()
    df = df.withColumns({"last_row": F.max("row_idx").over(Window.partitionBy(*KEY)), "before_": F.coalesce(F.lag("position").over(w), F.lit(0))})
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    end = F.col("row_idx") == F.col("last_row")
    fault = F.when(end & (F.col("before_") != 0) & bad, "open at the end").when(~end & (F.col("before_") != F.col("position")) & bad, "change")
    return df.select(*KEY, "row_idx", fault.alias("problem")).where("problem is not null")


def tradable(df: DataFrame, skip: bool = False) -> DataFrame:
    """``df`` if every position can be opened and closed; otherwise fails, or with ``skip`` leaves those sessions out
    (report ``segment_problems`` with the result then)."""
    if skip:
        return df.join(segment_problems(df).select(*KEY).distinct(), list(KEY), "left_anti")
    require(segment_problems(df), "a position can't be traded")
    return df


def profit(trades: DataFrame, costs: Costs | None = None) -> DataFrame:
    """gross, cost and net return of each trade."""
    d, a, b = F.col("direction"), F.col("entry_tk").cast("double"), F.col("exit_tk").cast("double")
    return trades.withColumn("gross", d * (b - a) / a).withColumn("cost", (costs or Costs()).of(d, a, b)).withColumn("net", F.col("gross") - F.col("cost"))


def daily(trades: DataFrame) -> DataFrame:
    """By date: summed returns, trades, and the running sum of net returns (one row a date, so one small window)."""
    day = trades.groupBy("date").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.count("*").alias("trades"))
    return day.withColumn("cumulative_net", F.sum("net").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def summary(days: DataFrame, periods: int = 242) -> DataFrame:
    """One row: days, trades, total, mean, win rate, annualised mean / deviation, deepest fall of the running sum."""
    peak = F.greatest(F.max("cumulative_net").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    d = days.withColumn("fall", peak - F.col("cumulative_net"))
    sd = F.stddev_samp("net")
    ratio = F.when((F.count("*") < 2) | (sd == 0), 0.0).otherwise(F.try_divide(F.avg("net"), sd) * periods**0.5)
    return d.agg(
        F.count("*").alias("days"), F.sum("trades").alias("trades"), F.sum("net").alias("total_net"), F.avg("net").alias("mean_net"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), ratio.alias("annual_ratio"), F.max("fall").alias("max_drawdown"),
    )
