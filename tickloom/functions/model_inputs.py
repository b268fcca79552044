"""Transforms around a model: fixed standardisation, elapsed-time encoding, learning-rate schedule."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardise(x: Column, mean: float, std: float, eps: float = 1e-6) -> Column:
    """(x - mean) / max(std, eps) with constants."""
    if not (math.isfinite(mean) and math.isfinite(std) and std > 0 and eps > 0):
        raise ValueError("means must be finite, deviations and eps positive")
    return (x - F.lit(mean)) / F.lit(max(std, eps))


def time_encoding(seconds: Column, width: int, max_timescale: float = 10_000.0, time_scale: float = 1.0) -> Column:
    """Array of ``width`` numbers: sines, then cosines of elapsed time at geometric frequencies (1 the highest); a 0 for odd widths."""
    if width < 2 or max_timescale <= 0 or time_scale <= 0:
        raise ValueError("invalid width or scales")
    half = width // 2
    angles = [seconds * F.lit(time_scale * math.exp(-math.log(max_timescale) / half * k)) for k in range(half)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles], *([F.lit(0.0)] * (width % 2)))


def warmup_cosine(step: Column, base: float, total: int, warmup: int, least: float = 0.0) -> Column:
    """Linear warm-up to ``base``, then half a cosine down to ``least`` times ``base``."""
    if not (base > 0 and total >= 1 and 0 <= warmup < total and 0 <= least <= 1):
        raise ValueError("invalid schedule bounds")
    s, low = step.cast("double"), base * least
    done = F.least(F.greatest((s - warmup) / max(1, total - warmup), F.lit(0.0)), F.lit(1.0))
    return F.when(s < warmup, base * F.least(F.lit(1.0), s / max(1, warmup))).otherwise(low + (base - low) * 0.5 * (1 + F.cos(math.pi * done)))


def score_windows(df: DataFrame, model: Callable[[pd.Series], pd.Series], column: str = "history", out: str = "pred") -> DataFrame:
    """Adds a float per window array from any vectorised model, in Arrow batches."""

    @F.pandas_udf("float")
    def run(x: pd.Series) -> pd.Series:
        return model(x)

    return df.withColumn(out, run(column))
