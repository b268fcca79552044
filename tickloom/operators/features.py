"""Labels' train statistics, weights and session-local normalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import reference_mid2
from ..sources.quotes import by_row
from .quantiles import quantiles
from .windows import ewm


def label_quantiles(df: DataFrame, label: str = "r_raw", eps: float = 1e-12, least: int = 1000) -> DataFrame:
    """One row: n, q90, q99, q100 of |label| with floors q90 >= eps, q99 >= q90, q100 >= q99; enough = n >= least."""
    p = quantiles(df, F.abs(label), {"q90": 0.9, "q99": 0.99}).withColumnRenamed("most", "q100")
    q90 = F.greatest("q90", F.lit(eps))
    q99 = F.greatest("q99", q90)
    return p.select("n", q90.alias("q90"), q99.alias("q99"), F.greatest("q100", q99).alias("q100"), (F.col("n") >= least).alias("enough"))


def scale_clip(label: Column, scale: float, limit: float | Column) -> tuple[Column, Column]:
    """(r_scaled, was_clipped): scaled in double precision, stored as float, the limit compared as a float."""
    y = (label.cast("double") * F.lit(scale)).cast("float")
    bound = (limit if isinstance(limit, Column) else F.lit(limit)).cast("float")
    return F.when(y.isNotNull(), F.least(F.greatest(y, -bound), bound)), F.coalesce(F.abs(y) > bound, F.lit(False))


def clip_limit(q99: Column, scale: float, most: float = 0.0, eps: float = 1e-12) -> Column:
    """The scaled label's limit: the train q99 times the scale, ``most`` at most where that is positive, and eps times the scale at least."""
    limit = q99 * F.lit(scale)
    if most > 0:
        limit = F.least(limit, F.lit(most))
    return F.greatest(limit, F.lit(eps * scale))


def sample_weight(label: Column, q90: Column, alpha: float = 1.0, most: float = 3.0, low: float = 0.5, high: float = 4.0) -> Column:
    """clip(1 + alpha * clip(|r| / q90, 0, most), low, high); 0 where there is no label."""
    pull = F.least(F.greatest(F.abs(label) / q90, F.lit(0.0)), F.lit(most))
    return F.when(label.isNotNull(), F.least(F.greatest(1 + alpha * pull, F.lit(low)), F.lit(high))).otherwise(F.lit(0.0))


def with_volume_mean(df: DataFrame, span: int, floor: float = 1.0, out: str = "volume_mean") -> DataFrame:
    """Adds the exponential mean of positive changes of acc_volume, ``floor`` at least."""
    step = F.col("acc_volume") - F.lag("acc_volume").over(by_row())
    df = ewm(df.withColumn("dv_", F.greatest(F.coalesce(step, F.lit(0)), F.lit(0))), "dv_", span, "ema_")
    return df.withColumn(out, F.greatest(F.col("ema_"), F.lit(floor))).drop("dv_", "ema_")


def volume_normalise(df: DataFrame, column: str, span: int, floor: float = 1.0, out: str = "volume_norm") -> DataFrame:
    """column over the exponential mean of positive changes of acc_volume."""
    df = with_volume_mean(df, span, floor, "mean_")
    return df.withColumn(out, F.col(column) / F.col("mean_")).drop("mean_")


def market_value(shares: Column, price2: Column, floor: float = 1.0, strict: bool = True) -> Column:
    """price * shares in price units (ticks are 1e-4; price2 is twice the price), ``floor`` at least.

    Fails where the float shares or the price is not positive; without ``strict`` such a row has none.
    """
    value = F.when((price2 > 0) & (shares > 0), F.greatest(price2 / F.lit(20_000.0) * shares, F.lit(floor)))
    return F.coalesce(value, F.raise_error(F.lit("no market value without positive float shares and price")).cast("double")) if strict else value


def mcap_normalise(df: DataFrame, column: str, shares: str, floor: float = 1.0, out: str = "mcap_norm", strict: bool = True) -> DataFrame:
    """column over the market value at the reference price."""
    price2 = reference_mid2(None, F.col("bid_tk"), F.col("ask_tk"), F.col("last_tk"))
    return df.withColumn(out, F.col(column) / market_value(F.col(shares), price2, floor, strict))


def input_stats(df: DataFrame, columns: list[str], where: Column) -> DataFrame:
    """(factor, n, mean, std) over the rows for which ``where`` holds; the std has a variance floor of 1e-12."""
    long = df.where(where).select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("factor", "x"))
    return long.groupBy("factor").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.greatest(F.stddev_samp("x"), F.lit(1e-6)).alias("std"))
