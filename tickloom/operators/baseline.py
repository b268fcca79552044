"""Time-of-day baselines from earlier sessions, z-scores, and the cross-stock scale audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import bucket_of_day
from ..sources.quotes import KEY


def bucket_stats(df: DataFrame, metric: str, days: int, seconds: int) -> DataFrame:
    """(KEY, bucket, n, mu, sigma) over the ``days`` last earlier dates of the same stock and session number.

    Each date's buckets become count, mean and sum of squared distances from it first, so history joins
    small rows; these combine without taking a large mean's square from a sum of squares.
    """
    x = F.col(metric).cast("double")
    b = df.withColumn("bucket", bucket_of_day(F.col("t_ms"), seconds))
    part = b.groupBy(*KEY, "bucket").agg(F.count(metric).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(metric)).alias("far")).where("n > 0")
    dates = df.select(*KEY).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("stock_code", "session").orderBy("date")))
    past = part.join(dates, list(KEY)).select("stock_code", "session", "bucket", "n", "mean", "far", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + days)).alias("rank"))
    # `days` entries a group at most
    stats = past.join(dates, ["stock_code", "session", "rank"]).groupBy(*KEY, "bucket").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"), F.collect_list(F.struct("n", "mean", "far")).alias("parts"))
    far = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["far"] + p["n"] * (p["mean"] - F.col("mu")) * (p["mean"] - F.col("mu")))
    return stats.select(*KEY, "bucket", "n", "mu", F.when(F.col("n") >= 2, F.sqrt(far / F.col("n"))).alias("sigma"))


def z_scores(df: DataFrame, stats: DataFrame, metric: str, seconds: int, least: int = 2, eps: float = 1e-12, clip: float | None = None) -> DataFrame:
    """Adds z: (x - mu) / (sigma + eps) of the row's bucket; 0 where history is thin or a value is missing."""
    b = df.withColumn("bucket", bucket_of_day(F.col("t_ms"), seconds))
    j = b.join(stats, [*KEY, "bucket"], "left")
    z = F.try_divide(F.col(metric) - F.col("mu"), F.col("sigma") + eps)
    if clip is not None:
        z = F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))
    return j.withColumn("z", F.when(F.col("n") >= least, F.coalesce(z, F.lit(0.0))).otherwise(0.0))


def factor_quantiles(df: DataFrame, columns: Sequence[str], q: float) -> DataFrame:
    """(stock_code, factor, q): quantile of |factor| by stock, over every row."""
    long = df.select("stock_code", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.abs(F.col(c)).cast("double"))])).alias("factor", "x"))
    return long.where("x is not null").groupBy("stock_code", "factor").agg(F.percentile("x", F.lit(q)).alias("q"))


#: Scales below this count as this.
TINY = 1e-12


def scale_ratio(quantiles: DataFrame) -> DataFrame:
    """(factor, stocks, ratio, dispersion): largest over smallest quantile across stocks, and its |log|."""
    q = F.greatest("q", F.lit(TINY))
    r = F.max(q) / F.min(q)
    return quantiles.where("q is not null").groupBy("factor").agg(F.count("*").alias("stocks"), r.alias("ratio"), F.abs(F.ln(r)).alias("dispersion"))


def best_method(raw: DataFrame, volume: DataFrame, mcap: DataFrame | None = None, tolerance: float = 3.0) -> DataFrame:
    """(factor, method): 'raw' within tolerance, else the normalisation within tolerance that disperses
    least (volume_norm of equal ones), else 'none'."""
    j = raw.select("factor", F.col("ratio").alias("raw_"))
    names = {"volume_norm": volume} | ({"mcap_norm": mcap} if mcap is not None else {})
    for name, d in names.items():
        j = j.join(d.select("factor", F.when(F.col("ratio") <= tolerance, F.col("dispersion")).alias(name)), "factor", "left")
    least = F.least(*names) if len(names) > 1 else F.col("volume_norm")
    pick = F.when(F.col("raw_") <= tolerance, "raw")
    for name in names:
        pick = pick.when(F.col(name) == least, name)
    return j.select("factor", pick.otherwise("none").alias("method"))


def norm_map(methods: DataFrame, meta: dict) -> dict:
    """The audit's answer as consumers freeze it: factors by method (one row a factor, so a small list)."""
    groups = {m: [] for m in ("raw", "volume_norm", "mcap_norm", "none")}
    for r in methods.orderBy("factor").collect():
        groups[r["method"]].append(r["factor"])
    return {"meta": dict(meta), "groups": groups}
