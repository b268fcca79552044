"""Model-ready rows: session join, fills and normalisations, weights, eligible ends, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.quotes import KEY
from .contract import FeatureContract
from .evaluate import require
from .features import market_value, sample_weight, with_volume_mean
from .quantiles import quantiles
from .windows import forward_fill, window_eligible

#: What normalisations read, filled like the factors.
MARKET = ("acc_volume", "bid_tk", "ask_tk", "last_tk")


def join_sessions(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """One row a session of ``catalog`` with its row of ``index``; fails if a session is repeated on either side or has no row there."""
    for name, rows in (("catalog", catalog), ("index", index)):
        require(rows.groupBy(*KEY).agg(F.count("*").alias("times")).where("times > 1"), f"sessions repeat in the {name}")
    require(catalog.join(index, list(KEY), "left_anti").select(*KEY), "sessions without labels")
    return catalog.join(index, list(KEY))


def preprocess(df: DataFrame, spec: FeatureContract) -> DataFrame:
    """Factors filled along the session, then divided as ``spec`` says; building and using a model must share this."""
    rest = [c for c in MARKET if c in df.columns and c not in spec.factors]
    every = [*spec.factors, *rest]
    if spec.forward_fill:
        df = forward_fill(df, every, None)
    if spec.fill is not None:
        df = df.withColumns({c: F.coalesce(c, F.lit(spec.fill)) for c in every})
    if spec.volume_norm:
        df = with_volume_mean(df, spec.ema_span, spec.volume_floor, "mean_")
        df = df.withColumns({c: F.col(c) / F.col("mean_") for c in spec.volume_norm}).drop("mean_")
    if spec.mcap_norm:
        known = F.create_map(*[F.lit(x) for pair in spec.shares.items() for x in pair]) if spec.shares else F.lit(None).cast("map<string,double>")
        two = F.when((F.col("bid_tk") > 0) & (F.col("ask_tk") >= F.col("bid_tk")), F.col("bid_tk") + F.col("ask_tk")).when(F.col("last_tk") > 0, 2 * F.col("last_tk"))
        df = df.withColumn("value_", market_value(F.element_at(known, F.col("stock_code")), two, spec.mcap_floor))
        df = df.withColumns({c: F.col(c) / F.col("value_") for c in spec.mcap_norm}).drop("value_")
    return df


def pack(labelled: DataFrame, spec: FeatureContract, q90: DataFrame, rows: int, max_span_ms: int = 0, max_gap_ms: int = 0) -> DataFrame:
    """Every labelled row with its factors ready, weight, and end_ok: may a window with a label end here? ``q90``: one row."""
    df = preprocess(labelled, spec).join(F.broadcast(q90.select(F.col("q90").alias("q90_"))))
    df = df.withColumn("weight", sample_weight(F.col("r_raw"), F.col("q90_"))).drop("q90_")
    return window_eligible(df, rows, max_span_ms, max_gap_ms, F.col("weight"))


def split_counts(packed: DataFrame, split: Column) -> DataFrame:
    """(split, n_sessions, n_rows, n_valid, n_ends, weight_sum)."""
    one = packed.groupBy(split.alias("split"), *KEY).agg(F.count("*").alias("r"), F.count("r_raw").alias("v"), F.count_if("end_ok").alias("e"), F.sum("weight").alias("w"))
    return one.groupBy("split").agg(F.count("*").alias("n_sessions"), F.sum("r").alias("n_rows"), F.sum("v").alias("n_valid"), F.sum("e").alias("n_ends"), F.sum("w").alias("weight_sum"))


def summary(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, mean, std (population), least, most and the quantiles named in ``shares``."""
    moments = df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return quantiles(df, F.col(column), shares).join(F.broadcast(moments))


def first_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, which stays as a column: sort by it to have the kept rows in their old order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def every_nth(df: DataFrame, step: int, most: int = 0) -> DataFrame:
    """Rows 0, step, 2 step… of each session, the first ``most`` of them where that is positive."""
    w = Window.partitionBy(*KEY).orderBy("row_idx")
    on = df.withColumn("rn_", F.row_number().over(w) - 1).where(F.col("rn_") % step == 0)
    return (on.where(F.expr(f"rn_ div {step}") < most) if most else on).drop("rn_")


def trade_chart(df: DataFrame, trades: DataFrame) -> DataFrame:
    """(KEY, row_idx, t_ms, mid2, mark, price_tk): a point for every row that has a price, and one for each trade's entry and exit."""
    d = F.col("direction") > 0
    end = lambda row, way, price: F.struct(F.col(row).alias("row_idx"), F.concat(F.when(d, "long ").otherwise("short "), F.lit(way)).alias("mark"), F.col(price).alias("price_tk"))
    ends = trades.select(*KEY, F.inline(F.array(end("entry_row", "entry", "entry_tk"), end("exit_row", "exit", "exit_tk"))))
    line = df.select(*KEY, "row_idx", "t_ms", "mid2")
    points = ends.join(line, [*KEY, "row_idx"]).select(*KEY, "row_idx", "t_ms", "mid2", "mark", "price_tk")
    return line.where("mid2 is not null").select("*", F.lit("mid").alias("mark"), F.lit(None).cast("long").alias("price_tk")).unionByName(points)
