"""Prediction alignment, information coefficients and weighted metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.quotes import KEY, by_row
from .quantiles import quantiles
from .windows import average_rank


def require(bad: DataFrame, message: str) -> None:
    """Fails if a check's counterexamples are not empty."""
    if rows := bad.limit(1).collect():
        raise ValueError(f"{message}: {rows[0].asDict()}")


def alignment_problems(predictions: DataFrame, labels: DataFrame, tolerance_ms: int = 0) -> DataFrame:
    """(KEY, end_row, problem): predictions (KEY, end_row, t_ms, pred) that repeat a row, have none in ``labels``
    (KEY, row_idx, t_ms, …), or another time there."""
    l = labels.select(*KEY, F.col("row_idx").alias("end_row"), F.col("t_ms").alias("label_t"))  # noqa: E741
    p = predictions.withColumn("times_", F.count("*").over(Window.partitionBy(*KEY, "end_row")))
    j = p.join(l, [*KEY, "end_row"], "left")
    fault = F.when(F.col("times_") > 1, "repeated").when(F.col("label_t").isNull(), "row").when(~F.coalesce(F.abs(F.col("t_ms") - F.col("label_t")) <= tolerance_ms, F.lit(False)), "time")
    return j.select(*KEY, "end_row", fault.alias("problem")).where("problem is not null").distinct()


def align(predictions: DataFrame, labels: DataFrame, tolerance_ms: int = 0) -> DataFrame:
    """Predictions with their labels (r_raw, is_valid); fails if any has no row of its own with the same time."""
    require(alignment_problems(predictions, labels, tolerance_ms), "predictions don't fit the labels")
    return predictions.join(labels.select(*KEY, F.col("row_idx").alias("end_row"), "r_raw", "is_valid"), [*KEY, "end_row"])


def on_timeline(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every row of ``rows`` with its prediction, NULL where there is none; fails like ``align``."""
    require(alignment_problems(predictions, rows), "predictions don't fit the rows")
    return rows.join(predictions.select(*KEY, F.col("end_row").alias("row_idx"), "pred"), [*KEY, "row_idx"], "left")


def pearson(x: str, y: str) -> Column:
    """Correlation, 0 for fewer than two rows or no spread."""
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    scale = F.sqrt((F.sum(F.col(x) * F.col(x)) - sx * sx / n) * (F.sum(F.col(y) * F.col(y)) - sy * sy / n))
    return F.when((n < 2) | flat, 0.0).otherwise(F.coalesce(F.try_divide(cov, scale), F.lit(0.0)))


def session_ic(df: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """(by, n, ic) of pred and r_raw over rows that have both."""
    on = df.where("pred is not null and r_raw is not null").select(*by, F.col("pred").cast("double").alias("x"), F.col("r_raw").cast("double").alias("y"))
    return on.groupBy(*by).agg(F.count("*").alias("n"), pearson("x", "y").alias("ic"))


def session_rank_ic(df: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    on = df.where("pred is not null and r_raw is not null")
    on = on.select(*by, average_rank("pred", by).alias("x"), average_rank("r_raw", by).alias("y"))
    return on.groupBy(*by).agg(F.count("*").alias("n"), pearson("x", "y").alias("rank_ic"))


def ic_summary(ics: DataFrame, column: str = "ic") -> DataFrame:
    """Mean and mean / sample deviation (0 for one session or no spread)."""
    sd = F.stddev_samp(column)
    ratio = F.when((F.count(column) <= 1) | (sd == 0), 0.0).otherwise(F.try_divide(F.avg(column), sd))
    return ics.agg(F.count(column).alias("sessions"), F.avg(column).alias("ic_mean"), ratio.alias("icir"))


def thresholds(df: DataFrame, top_long: float, top_short: float, column: str = "pred") -> DataFrame:
    """One row (thr_long, thr_short): exact linear quantiles."""
    return quantiles(df, F.col(column), {"thr_long": 1 - top_long, "thr_short": top_short}).select("thr_long", "thr_short")


def top_events(df: DataFrame, top: float, cost: float = 0.0) -> DataFrame:
    """(side, events, mean_rows, mean_return, net_return): runs of adjacent rows beyond a threshold (strictly),
    long, short and both combined. The mean is of the runs' own means; a short run's return changes its sign.
    """
    df = df.join(F.broadcast(thresholds(df, top, top)))
    every = None
    for side, on, sign in (("long", F.col("pred") > F.col("thr_long"), 1), ("short", F.col("pred") < F.col("thr_short"), -1)):
        rows = df.where(on).withColumn("island_", F.col("row_idx") - F.row_number().over(by_row()))
        event = rows.groupBy(*KEY, "island_").agg((F.avg("r_raw") * sign).alias("m"), F.count("*").alias("n")).select(F.lit(side).alias("side"), "m", "n")
        every = event if every is None else every.unionByName(event)
    both = every.select(F.explode(F.array("side", F.lit("combined"))).alias("side"), "m", "n")
    return both.groupBy("side").agg(F.count("*").alias("events"), F.avg("n").alias("mean_rows"), F.avg("m").alias("mean_return"), (F.avg("m") - cost).alias("net_return"))


def regression_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mse, rmse, mae, sign_accuracy (0 counts as positive), pearson of columns x (prediction) and y."""
    e = F.col("x") - F.col("y")
    return df.where("x is not null and y is not null").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(((F.col("x") >= 0) == (F.col("y") >= 0)).cast("double")).alias("sign_accuracy"),
        pearson("x", "y").alias("pearson"),
    )


def top_abs(df: DataFrame, fraction: float) -> DataFrame:
    """Rows whose |x| reaches its 1 - fraction quantile (inclusive)."""
    t = quantiles(df, F.abs("x"), {"t_": 1 - fraction}).select("t_")
    return df.join(F.broadcast(t)).where(F.abs(F.col("x")) >= F.col("t_")).drop("t_")


def weighted_metrics(df: DataFrame) -> DataFrame:
    """One row from columns x (prediction), y, w: weighted R², direction accuracy and concordance."""
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    m = df.agg(
        F.sum(w).alias("m"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
        F.sum(w * x * y).alias("sxy"), F.sum(w * (x - y) * (x - y)).alias("sse"), F.sum(w * (F.signum(x) == F.signum(y)).cast("double")).alias("hit"),
    )
    mx, my = F.try_divide("sx", "m"), F.try_divide("sy", "m")
    vx, vy, cov = F.try_divide("sxx", "m") - mx * mx, F.try_divide("syy", "m") - my * my, F.try_divide("sxy", "m") - mx * my
    sst = F.col("syy") - my * F.col("sy")
    none = F.coalesce(F.col("m"), F.lit(0.0)) <= 0
    r2 = F.when(none, 0.0).when(sst <= 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.col("sse"), sst))
    ccc = F.when(none, 0.0).otherwise(2 * cov / (vx + vy + (mx - my) * (mx - my) + 1e-8))
    return m.select(r2.alias("weighted_r2"), F.when(none, 0.0).otherwise(F.try_divide("hit", "m")).alias("direction_accuracy"), ccc.alias("ccc"), (1 - ccc).alias("ccc_loss"))


def effective_sample(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, (sum w)² / sum w² / n, and the weighted absolute error of predicting 0."""
    w = F.col("w")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w) * F.count("*")), F.lit(0.0)).alias("ess_ratio"),
        F.coalesce(F.try_divide(F.sum(w * F.abs("y")), F.sum(w)), F.lit(0.0)).alias("zero_mae"),
        F.stddev_pop("w").alias("w_std"),
    )
