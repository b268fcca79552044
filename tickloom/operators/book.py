"""Order-book features on sessions with levels bid{i}/ask{i} (prices) and bz{i}/az{i} (depths).

``*_L4`` names sum all levels, level 0 included where there is one. Division guards follow the
source rule a / (b + 1e-12). The mid is that of the best quotes where both are there, else the last
price. Changes and rolling values that have no history yet, or no finite value, are 0.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import enrich_mid2, safe_div, sweep_price
from ..sources.quotes import KEY, LEVELS, by_row
from .windows import ewm, rolling


def c(name: str) -> Column:
    return F.col(name)


def total(prefix: str, levels: int = LEVELS) -> Column:
    return reduce(add, [c(f"{prefix}{i}") for i in range(levels)])


def weighted(prefix: str, levels: int = LEVELS) -> Column:
    return reduce(add, [c(f"{prefix}{i}") * F.lit(1.0 / (i + 1)) for i in range(levels)])


def mid() -> Column:
    return enrich_mid2(c("bid0"), c("ask0"), c("last_tk")) / 2


def zero(x: Column) -> Column:
    """What is missing or not finite counts as no change."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(F.coalesce(d, F.lit(0.0)))


def time_step(df: DataFrame) -> DataFrame:
    """dt_ms: time since the row before; steps not above 0 (and the first) take the session's median positive step."""
    step = c("t_ms") - F.lag("t_ms").over(by_row())
    df = df.withColumn("step_", F.when(step > 0, step))
    return df.withColumn("dt_ms", F.coalesce(c("step_").cast("double"), F.percentile("step_", F.lit(0.5)).over(Window.partitionBy(*KEY)))).drop("step_")


def spread_micro(df: DataFrame) -> DataFrame:
    m = mid()
    micro = safe_div(c("ask0") * c("bz0") + c("bid0") * c("az0"), c("bz0") + c("az0"))
    return df.withColumns({"mid": m, "spread": c("ask0") - c("bid0"), "rel_spread": safe_div(c("ask0") - c("bid0"), m), "microprice": micro, "microprice_dev": safe_div(micro - m, m)})


def depth_imbalance(df: DataFrame) -> DataFrame:
    b, a, wb, wa = total("bz"), total("az"), weighted("bz"), weighted("az")
    return df.withColumns(
        {
            "depth_bid_L1": c("bz0"),
            "depth_ask_L1": c("az0"),
            "depth_bid_L4": b,
            "depth_ask_L4": a,
            "depth_total_L4": b + a,
            "log_depth_total_L4": F.log1p((b + a).cast("double")),
            "log_depth_bid_L1": F.when(c("bz0").isNotNull(), F.log1p(F.greatest(c("bz0"), F.lit(0)).cast("double"))),
            "log_depth_ask_L1": F.when(c("az0").isNotNull(), F.log1p(F.greatest(c("az0"), F.lit(0)).cast("double"))),
            "obi_L1": safe_div(c("bz0") - c("az0"), c("bz0") + c("az0")),
            "obi_L4": safe_div(b - a, b + a),
            "wobi_L4": safe_div(wb - wa, wb + wa),
        }
    )


def slope_curvature(df: DataFrame, deepest: int = LEVELS - 1) -> DataFrame:
    """Distance of the deepest level from mid by total depth, and the best level's against it."""
    m = mid()
    sb, sa = safe_div(m - c(f"bid{deepest}"), total("bz")), safe_div(c(f"ask{deepest}") - m, total("az"))
    b1, a1 = safe_div(m - c("bid0"), c("bz0")), safe_div(c("ask0") - m, c("az0"))
    return df.withColumns({"slope_bid_L4": sb, "slope_ask_L4": sa, "slope_asym": sa - sb, "curv_bid_L1_over_L4": safe_div(b1, sb), "curv_ask_L1_over_L4": safe_div(a1, sa)})


def churn(df: DataFrame) -> DataFrame:
    w = by_row()

    def side(p: str) -> Column:
        moved = reduce(add, [F.abs(c(f"{p}{i}") - F.lag(f"{p}{i}").over(w)) for i in range(LEVELS)])
        return safe_div(moved, F.lag(total(p)).over(w))

    df = df.withColumns({"b_": side("bz"), "a_": side("az")})
    return df.withColumns({"churn_bid_L4": zero(c("b_")), "churn_ask_L4": zero(c("a_")), "churn_asym": zero(c("b_") - c("a_"))}).drop("b_", "a_")


def imbalance() -> Column:
    return safe_div(total("bz") - total("az"), total("bz") + total("az"))


def imbalance_sign() -> Column:
    """-1, 0 or 1 of all levels' imbalance; 0 where it is missing."""
    return F.coalesce(F.signum((total("bz") - total("az")).cast("double")), F.lit(0.0)).cast("int")


def obi_runs(df: DataFrame, persistent_from: int = 5) -> DataFrame:
    """obi_runlen: rows so far with the same sign of all levels' imbalance (0 for none); obi_persistent:
    the imbalance once that run is long enough, else 0."""
    w = by_row()
    df = df.withColumn("sign_", imbalance_sign())
    df = df.withColumn("new_", F.when(F.coalesce(F.lag("sign_").over(w), F.lit(9)) != c("sign_"), 1).otherwise(0))
    df = df.withColumn("grp_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rn = F.row_number().over(Window.partitionBy(*KEY, "grp_").orderBy("row_idx"))
    df = df.withColumn("obi_runlen", F.when(c("sign_") == 0, 0).otherwise(rn))
    return df.withColumn("obi_persistent", F.when((c("obi_runlen") >= persistent_from) & (c("sign_") != 0), imbalance()).otherwise(0.0)).drop("sign_", "new_", "grp_")


def obi_flicker(df: DataFrame, rows: int = 50) -> DataFrame:
    """Flips between bid-heavy and ask-heavy in the last ``rows`` rows; a session's first row counts as one if it is either."""
    df = df.withColumn("sign_", imbalance_sign())
    before = F.lag("sign_").over(by_row())
    flip = (c("sign_") != 0) & (before.isNull() | ((before != 0) & (before != c("sign_"))))
    df = df.withColumn("flip_", F.when(flip, 1).otherwise(0))
    n = F.coalesce(rolling(c("flip_"), rows, max(3, rows // 5)), F.lit(0))
    return df.withColumns({"obi_flicker_cnt": n, "obi_flicker_rate": safe_div(n, F.lit(float(rows)))}).drop("sign_", "flip_")


def _flow(df: DataFrame) -> DataFrame:
    """raw_0.. and raw_: order flow by level and its inverse-level weighted sum, NULL on a session's first row.

    A price that is missing, or follows a missing one, counts as worse than before.
    """
    w = by_row()

    def side(p: str, q: str, better: str) -> Column:
        price, size, p0, q0 = c(p), c(q), F.lag(p).over(w), F.lag(q).over(w)
        up = price > p0 if better == "high" else price < p0
        return F.when(up, size).when(price == p0, size - q0).otherwise(-q0)

    df = df.withColumns({f"raw_{i}": (side(f"bid{i}", f"bz{i}", "high") - side(f"ask{i}", f"az{i}", "low")).cast("long") for i in range(LEVELS)})
    return df.withColumn("raw_", weighted("raw_"))


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("raw_", *[f"raw_{i}" for i in range(LEVELS)])


def ofi(df: DataFrame) -> DataFrame:
    """Order-flow imbalance of each level (ofi0..) and their inverse-level weighted sum iofi."""
    df = _flow(df)
    df = df.withColumns({f"ofi{i}": F.coalesce(c(f"raw_{i}"), F.lit(0)) for i in range(LEVELS)})
    return _plain(df.withColumn("iofi", zero(c("raw_"))))


def _surprise(df: DataFrame, span: int) -> DataFrame:
    df = ewm(df, "raw_", span, "ema_")
    return df.withColumn("past_", F.lag("ema_").over(by_row())).drop("ema_")


def ofi_surprise(df: DataFrame, span: int = 50) -> DataFrame:
    """iofi against its exponential mean up to the row before (NULL where there is none yet)."""
    df = _surprise(_flow(df), span)
    return _plain(df.withColumns({"iofi": zero(c("raw_")), "iofi_ema_past": c("past_"), "iofi_surprise": zero(c("raw_") - c("past_"))}).drop("past_"))


def _deviation(rows: int) -> Column:
    return rolling(c("raw_"), rows, max(5, rows // 5), F.stddev_samp)


def ofi_volatility(df: DataFrame, rows: int = 50) -> DataFrame:
    return _plain(_flow(df).withColumn("iofi_vol", zero(_deviation(rows))))


def ofi_normalised(df: DataFrame, span: int = 200, floor: float = 1.0, ema_span: int = 50, vol_rows: int = 50) -> DataFrame:
    """Order flow of the first four levels, iofi, its surprise and its deviation over the exponential mean of traded volume."""
    step = c("acc_volume") - F.lag("acc_volume").over(by_row())
    df = ewm(_surprise(_flow(df), ema_span).withColumn("dv_", F.when(step > 0, step).otherwise(0)), "dv_", span, "vol_ema_")
    by = F.greatest(c("vol_ema_"), F.lit(floor))
    out = {f"ofi_norm_L{i + 1}": zero(safe_div(c(f"raw_{i}"), by)) for i in range(min(4, LEVELS))}
    out |= {"iofi_norm": zero(safe_div(c("raw_"), by)), "iofi_surprise_norm": zero(safe_div(c("raw_") - c("past_"), by)), "iofi_vol_norm": zero(safe_div(_deviation(vol_rows), by))}
    return _plain(df.withColumns(out).drop("dv_", "vol_ema_", "past_"))


def trade_rates(df: DataFrame) -> DataFrame:
    """Rates by second, trade flag, volume-weighted tick price and its distance from mid."""
    df = time_step(df)
    m, amount = mid(), c("turnover")
    vwap = safe_div(amount, F.nullif(c("volume"), F.lit(0)))
    return df.withColumns(
        {
            "vol_rate": safe_div(c("volume") * 1000.0, c("dt_ms")),
            "amt_rate": safe_div(amount * 1000.0, c("dt_ms")),
            "trade_flag": F.coalesce((c("volume") > 0).cast("int"), F.lit(0)),
            "vwap_tick": vwap,
            "vwap_dev": F.when(c("volume") > 0, zero(safe_div(vwap - m, m))).otherwise(0.0),
        }
    )


def illiquidity(df: DataFrame) -> DataFrame:
    """r_mid over the last known mid (gaps padded, 0 where there is none), and |r_mid| per traded amount."""
    w = by_row()
    df = df.withColumn("pad_", F.last(mid(), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("r_mid", zero(F.try_divide(c("pad_"), F.lag("pad_").over(w)) - 1))
    amount = c("turnover").cast("double")
    return df.withColumn("illiq", F.when(amount > 0, safe_div(F.abs(c("r_mid")), amount)).otherwise(0.0)).drop("pad_")


def turnover_ratios(df: DataFrame, shares: Column) -> DataFrame:
    """Volume and amount of a tick against the float; fails where ``shares`` is not positive."""
    known = F.when(shares > 0, shares).otherwise(F.raise_error(F.concat(F.lit("no positive float shares for "), c("stock_code"))).cast("long"))
    return df.withColumns({"vol_ratio_tick": safe_div(c("volume"), known), "amt_ratio_tick": safe_div(c("turnover"), F.nullif(mid() * known, F.lit(0.0)))})


def impact(df: DataFrame, percent: int = 50) -> DataFrame:
    """Price of sweeping ``percent`` of the other side's depth, against mid."""
    m = mid()

    def side(price: str, size: str) -> Column:
        cum = [reduce(add, [c(f"{size}{j}") for j in range(i + 1)]) * 100 for i in range(LEVELS)]
        return sweep_price(total(size) * percent, [c(f"{price}{i}") for i in range(LEVELS)], cum)

    buy, sell = safe_div(side("ask", "az") - m, m), safe_div(m - side("bid", "bz"), m)
    return df.withColumns({f"impact_buy_f{percent}": buy, f"impact_sell_f{percent}": sell, f"impact_asym_f{percent}": buy - sell})


def enrich(df: DataFrame) -> DataFrame:
    """All features that need no external attribute."""
    for step in (trade_rates, spread_micro, depth_imbalance, slope_curvature, churn, obi_runs, obi_flicker, ofi, ofi_normalised, ofi_volatility, illiquidity, impact):
        df = step(df)
    return df
