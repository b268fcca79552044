"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import finite_or_null

#: Parts of a power of two in the first step, and of an interval in each later one.
FIRST, PARTS = 64, 65_536


def _narrow(counts: DataFrame, wanted: DataFrame, digit: Column) -> DataFrame:
    """Each wanted rank's part of its interval; ``digit`` must never fall as x grows."""
    inside = counts.join(F.broadcast(wanted), F.col("x").between(F.col("lo"), F.col("hi")))
    parts = inside.groupBy("id", "k", "share", digit.alias("digit")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # one rank's parts: some 10^5 rows at most, whatever the number of values
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("digit"))
    parts = parts.withColumn("before", upto - F.col("n"))
    return parts.where("before <= k and k < before + n").select("id", (F.col("k") - F.col("before")).alias("k"), "share", "lo", "hi")


def quantiles(df: DataFrame, value: Column, shares: Mapping[str, float]) -> DataFrame:
    """One row: n, least, most of the finite values, and a linear quantile for each name of ``shares``.

    Values become counts first (combined before their shuffle). The two ranks beside each quantile are then
    found by histograms of their interval: one step by the power of two, in 64 parts each, and three into
    65,536 equal parts, which tell any two doubles apart. Without values, n is 0 and the rest NULL.
    """
    counts = df.select(finite_or_null(value.cast("double")).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    rank = lambda i, q, up: F.struct(
        F.lit(i).alias("id"),
        (F.ceil if up else F.floor)((F.col("n") - 1) * F.lit(float(q))).alias("k"),
        ((F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))).alias("share"),
    )
    ranks = [rank(2 * i + up, q, up) for i, q in enumerate(shares.values()) for up in (0, 1)]
    wanted = total.where("n > 0").select(F.inline(F.array(*ranks)), F.col("least").alias("lo"), F.col("most").alias("hi"))
    x, width = F.col("x"), F.col("hi") - F.col("lo")
    power = F.signum(x) * (F.floor(F.log2(F.abs(x)) * FIRST) + 1100 * FIRST)
    wanted = _narrow(counts, wanted, F.coalesce(power, F.lit(0.0)))
    for _ in range(3):
        wanted = _narrow(counts, wanted, F.coalesce(F.floor(F.try_divide(x - F.col("lo"), width) * PARTS), F.lit(0)))
    at = lambda i, c: F.max(F.when(F.col("id") == i, F.col(c)))
    found = [(at(2 * i, "lo") + (at(2 * i + 1, "lo") - at(2 * i, "lo")) * at(2 * i, "share")).alias(name) for i, name in enumerate(shares)]
    return total.join(F.broadcast(wanted.agg(*found)))
