"""The price rules, which differ on purpose, and scalar helpers.

Prices may be doubles or integer ticks; a rule that averages returns twice the price when the
inputs are ticks, so that sums stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def finite_or_null(x: Column) -> Column:
    """NaN and infinities are missing values; NULL is the only missing value further on."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), x)


def fill(x: Column, value) -> Column:
    return F.coalesce(finite_or_null(x), F.lit(value))


def safe_div(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.try_divide(a.cast("double"), b + F.lit(eps))


def clip(x: Column, low, high) -> Column:
    """NULL stays NULL (least and greatest alone would turn it into a bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def executable(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid > 0) & (ask > 0) & (ask >= bid), F.lit(False))


def label_mid2(bid: Column, ask: Column, last: Column, prefer_quotes: bool = True) -> Column:
    """Twice the label's price: a valid quote's mid, else the last price, which must be positive."""
    fallback = F.when(last > 0, 2 * last)
    return F.when(executable(bid, ask), bid + ask).otherwise(fallback) if prefer_quotes else fallback


def reference_mid2(mid: Column | None, bid: Column, ask: Column, last: Column) -> Column:
    """Twice the price for market values: explicit mid, else a valid quote's, else the last price."""
    first = F.when(mid > 0, 2 * mid) if mid is not None else F.lit(None).cast("long")
    return F.coalesce(first, F.when(executable(bid, ask), bid + ask), F.when(last > 0, 2 * last))


def audit_mid2(bid: Column | None, ask: Column | None, last: Column) -> Column:
    """Twice the scale audit's price: which columns exist decides, values are not checked."""
    return bid + ask if bid is not None and ask is not None else 2 * last


def enrich_mid2(bid: Column, ask: Column, last: Column) -> Column:
    """Twice the order-book features' mid: quotes where both are there, crossed or not."""
    return F.coalesce(bid + ask, 2 * last)


def legacy_mid(bid: Column, ask: Column, last: Column) -> Column:
    """The older labels' mid in price units, both quotes positive, rounded half to even at 3 decimals."""
    mid = F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(last)
    return F.rint(mid * 1000) / 1000


def sweep_price(depth: Column, prices: list[Column], cumulative: list[Column]) -> Column:
    """The price of the first level whose cumulative depth covers ``depth``; NULL if none does."""
    out = F.when(depth <= cumulative[0], prices[0])
    for p, c in zip(prices[1:], cumulative[1:], strict=True):
        out = out.when(depth <= c, p)
    return out
