"""Registered queries of the event-time operators, with the SQL they are checked against.

Doubles are rounded on both sides where engines may sum in another order; prices are whole ticks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, model_inputs, price
from ..operators import backtest, baseline, book, catalog, compare, contract, evaluate, features, pack
from ..operators import windows as win
from ..sources.quotes import KEY, QUOTES_SQL, quotes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOW, HIGH, LEAST = 1_800_000, 7_200_000, 2
SPLITS = {"train": ("2024-01-01", "2024-01-20"), "val": ("2024-01-21", "2024-01-25"), "test": ("2024-01-26", "2024-01-30")}
ROWS, SPAN, GAP = 5, 10_800_000, 3_600_000
SAMPLE = 5_000  # rows of a session that statistics take at most
ID = ("stock_code", "date", "session", "row_idx")
KEYS = "stock_code, date, session"
OVER_ROW = "(PARTITION BY stock_code, date, session ORDER BY row_idx)"


def query(name: str, sql: str | None = None):
    """Registers a function of the quotes view; ``sql`` follows the view's WITH list."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(quotes(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {QUOTES_SQL}{sql}"
        return f

    return put


def r(c, digits: int = 9):
    """Rounded double; adding 0 makes a negative zero positive."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, keep=ID, digits: int = 9) -> DataFrame:
    return df.select(*keep, *[r(c, digits).alias(c) for c in columns])


def sql_rounded(*parts: tuple[str, str], digits: int = 9) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS {n}" for n, e in parts)


IDS = "stock_code, date, session, row_idx"
SPLIT_SQL = "CASE " + " ".join(f"WHEN date BETWEEN '{a}' AND '{b}' THEN '{n}'" for n, (a, b) in SPLITS.items()) + " ELSE 'out_of_split' END"

# ---------------------------------------------------------------------------------------
# Scalars


@query(
    "clock_parse",
    """, c AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 960000000 WHEN event_id % 19 = 0 THEN 93060000 WHEN event_id % 23 = 0 THEN -5
       ELSE (t_ms // 3600000) * 10000000 + (t_ms // 60000) % 60 * 100000 + (t_ms // 1000) % 60 * 1000 + t_ms % 1000 END AS clock FROM q),
     p AS (SELECT *, clock // 10000000 AS h, (clock // 100000) % 100 AS m, (clock // 1000) % 100 AS s, lpad(right(CAST(clock AS VARCHAR), 9), 9, '0') AS t FROM c)
    SELECT event_id, clock, CASE WHEN clock >= 0 AND h < 24 AND m < 60 AND s < 60 THEN ((h * 60 + m) * 60 + s) * 1000 + clock % 1000 END AS strict_ms,
           ((TRY_CAST(substr(t, 1, 2) AS BIGINT) * 60 + TRY_CAST(substr(t, 3, 2) AS BIGINT)) * 60 + TRY_CAST(substr(t, 5, 2) AS BIGINT)) * 1000 + TRY_CAST(substr(t, 7, 3) AS BIGINT) AS text_ms,
           CASE WHEN clock > 0 THEN ((h * 60 + m) * 60 + s) * 1000 + clock % 1000 END AS positive_ms FROM p""",
)
def _(q):
    t, i = F.col("t_ms"), F.col("event_id")
    made = F.expr("t_ms div 3600000") * 10_000_000 + F.expr("t_ms div 60000") % 60 * 100_000 + F.expr("t_ms div 1000") % 60 * 1000 + t % 1000
    c = q.select(i, F.when(i % 17 == 0, 960_000_000).when(i % 19 == 0, 93_060_000).when(i % 23 == 0, -5).otherwise(made).cast("long").alias("clock"))
    k = F.col("clock")
    return c.select("event_id", "clock", clock.clock_to_ms(k).alias("strict_ms"), clock.clock_text_to_ms(k).alias("text_ms"), clock.clock_positive_to_ms(k).alias("positive_ms"))


@query("split_assign", f" SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates FROM (SELECT date, {SPLIT_SQL} AS split FROM q) GROUP BY 1")
def _(q):
    return q.groupBy(clock.split_of(F.col("date"), SPLITS).alias("split")).agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"))


@query("quote_validity", " SELECT event_id, ok, mid2 FROM q")
def _(q):
    return q.select("event_id", "ok", "mid2")


@query(
    "mid_rules",
    """ SELECT event_id, mid2 AS label_mid2, CASE WHEN last_tk > 0 THEN 2 * last_tk END AS last_only_mid2,
       coalesce(CASE WHEN bid_tk > 0 AND ask_tk > 0 AND ask_tk >= bid_tk THEN bid_tk + ask_tk END, CASE WHEN last_tk > 0 THEN 2 * last_tk END) AS ref_mid2,
       bid_tk + ask_tk AS audit_mid2, coalesce(bid_tk + ask_tk, 2 * last_tk) AS enrich_mid2,
       round_even((CASE WHEN bid_tk > 0 AND ask_tk > 0 THEN (CAST(bid_tk AS DOUBLE) / 10000 + CAST(ask_tk AS DOUBLE) / 10000) / 2 ELSE CAST(last_tk AS DOUBLE) / 10000 END) * 1000, 0) / 1000 AS legacy_mid FROM q""",
)
def _(q):
    b, a, x = F.col("bid_tk"), F.col("ask_tk"), F.col("last_tk")
    legacy = price.legacy_mid(*[c.cast("double") / 10_000 for c in (b, a, x)])
    return q.select(
        "event_id", price.label_mid2(b, a, x).alias("label_mid2"), price.label_mid2(b, a, x, False).alias("last_only_mid2"), price.reference_mid2(None, b, a, x).alias("ref_mid2"),
        price.audit_mid2(b, a, x).alias("audit_mid2"), price.enrich_mid2(b, a, x).alias("enrich_mid2"), legacy.alias("legacy_mid"),
    )


@query(
    "scalar_rules",
    f""" SELECT {IDS}, {sql_rounded(("safe", "CASE WHEN f2 > 0 THEN f0 / (f2 + 1e-12) END"), ("filled", "coalesce(f0, -1)"), ("logged", "ln(1 + abs(pred_m))"), ("signed", "sign(pred_m)"), ("rooted", "sqrt(abs(pred_m))"))},
       CASE WHEN f0 IS NOT NULL THEN least(greatest(f0, 1000), 20000) END AS clipped, CAST(least(greatest(t_ms // 600000, 0), 143) AS INT) AS bucket FROM q""",
)
def _(q):
    p = F.abs("pred_m").cast("double")
    q = q.withColumns({"safe": F.when(F.col("f2") > 0, price.safe_div(F.col("f0"), F.col("f2"))), "filled": price.fill(F.col("f0"), -1), "logged": F.log1p(p), "signed": F.signum(F.col("pred_m").cast("double")), "rooted": F.sqrt(p)})
    return q.select(*ID, *[r(c).alias(c) for c in ("safe", "filled", "logged", "signed", "rooted")], price.clip(F.col("f0"), 1000, 20000).cast("long").alias("clipped"), clock.bucket_of_day(F.col("t_ms"), 600).alias("bucket"))


# ---------------------------------------------------------------------------------------
# Labels


def label_sql(low: int = LOW, high: int = HIGH, least: int = LEAST, full: bool = True, name: str = "lab") -> str:
    need = high if full else low
    return f""", {name}0 AS (
  SELECT *, count(*) OVER a AS lo, count(*) OVER b - 1 AS hi,
         coalesce(count(mid2) OVER b, 0) - coalesce(count(mid2) OVER a, 0) AS future_count,
         CAST(coalesce(sum(mid2) OVER b, 0) - coalesce(sum(mid2) OVER a, 0) AS BIGINT) AS future_sum,
         max(t_ms) OVER (PARTITION BY {KEYS}) AS t_last
  FROM q WINDOW a AS (PARTITION BY {KEYS} ORDER BY t_ms RANGE BETWEEN UNBOUNDED PRECEDING AND {low - 1} FOLLOWING),
                b AS (PARTITION BY {KEYS} ORDER BY t_ms RANGE BETWEEN UNBOUNDED PRECEDING AND {high} FOLLOWING)
), {name} AS (
  SELECT *, CAST((CASE WHEN mid2 IS NULL THEN 1 ELSE 0 END) + (CASE WHEN t_ms + {need} > t_last THEN 2 ELSE 0 END)
         + (CASE WHEN future_count < {least} THEN 4 ELSE 0 END) AS INT) AS invalid_reason,
         CASE WHEN mid2 IS NOT NULL AND t_ms + {need} <= t_last AND future_count >= {least}
              THEN CAST(future_sum AS DOUBLE) / CAST(future_count * mid2 AS DOUBLE) - 1 END AS r_raw
  FROM {name}0
)"""


def labelled(q: DataFrame) -> DataFrame:
    return win.future_label(q, LOW, HIGH, LEAST)


@query("future_label", label_sql() + f" SELECT {IDS}, invalid_reason = 0 AS is_valid, invalid_reason, future_count, r_raw FROM lab")
def _(q):
    return labelled(q).select(*ID, "is_valid", "invalid_reason", "future_count", "r_raw")


@query("label_reason_counts", label_sql() + " SELECT stock_code, invalid_reason, count(*) AS n_rows, round(avg(r_raw), 9) + 0.0 AS mean_r FROM lab GROUP BY 1, 2")
def _(q):
    return labelled(q).groupBy("stock_code", "invalid_reason").agg(F.count("*").alias("n_rows"), r(F.avg("r_raw")).alias("mean_r"))


@query(
    "label_flag_counts",
    label_sql()
    + f""" SELECT {SPLIT_SQL} AS split, count(*) AS n_rows, count(DISTINCT stock_code || date) AS n_sessions, count(*) FILTER (invalid_reason = 0) AS n_valid,
      count(*) FILTER (invalid_reason & 1 > 0) AS n_now, count(*) FILTER (invalid_reason & 2 > 0) AS n_horizon, count(*) FILTER (invalid_reason & 4 > 0) AS n_few FROM lab GROUP BY 1""",
)
def _(q):
    bit = lambda b: F.count_if(F.col("invalid_reason").bitwiseAND(b) > 0)
    return labelled(q).groupBy(clock.split_of(F.col("date"), SPLITS).alias("split")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("stock_code", "date").alias("n_sessions"), F.count_if("is_valid").alias("n_valid"), bit(1).alias("n_now"), bit(2).alias("n_horizon"), bit(4).alias("n_few")
    )


@query("label_bounds_lohi", label_sql() + f" SELECT {IDS}, lo, hi FROM lab")
def _(q):
    return labelled(q).select(*ID, "lo", "hi")


@query("label_partial_horizon", label_sql(full=False, least=1) + f" SELECT {IDS}, invalid_reason, r_raw FROM lab")
def _(q):
    return win.future_label(q, LOW, HIGH, 1, full_horizon=False).select(*ID, "invalid_reason", "r_raw")


@query(
    "lead_label",
    f" SELECT {IDS}, CASE WHEN mid2 IS NOT NULL AND lead(mid2, 10) OVER w IS NOT NULL AND lead(t_ms, 10) OVER w - t_ms <= 36000000 THEN (lead(mid2, 10) OVER w - mid2) * 200 END AS lead_label FROM q WINDOW w AS {OVER_ROW}",
)
def _(q):
    return win.lead_label(q, 10, 200, 36_000_000).select(*ID, "lead_label")


@query(
    "legacy_window_label",
    label_sql(full=False, least=1)
    + f" SELECT {IDS}, CASE WHEN mid2 IS NOT NULL AND invalid_reason & 2 = 0 THEN CASE WHEN future_count = 0 THEN 0.0 ELSE CAST(future_sum AS DOUBLE) / CAST(future_count * mid2 AS DOUBLE) - 1 END END AS legacy_label FROM lab",
)
def _(q):
    return win.legacy_window_label(q, LOW, HIGH).select(*ID, "legacy_label")


TRAIN_SQL = label_sql() + f""", tr AS (SELECT * FROM lab WHERE {SPLIT_SQL} = 'train' AND r_raw IS NOT NULL),
 sm0 AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS n_, row_number() OVER {OVER_ROW} - 1 AS rn_ FROM tr),
 sm AS (SELECT * FROM sm0 WHERE rn_ % greatest(1, n_ // {SAMPLE}) = 0 AND rn_ // greatest(1, n_ // {SAMPLE}) < {SAMPLE}),
 st AS (SELECT count(*) AS n, greatest(quantile_cont(abs(r_raw), 0.9), 1e-12) AS q90, quantile_cont(abs(r_raw), 0.99) AS q99, max(abs(r_raw)) AS q100 FROM sm)"""


def train_stats(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    lab = labelled(q)
    train = lab.where(clock.split_of(F.col("date"), SPLITS) == "train")
    return lab, features.label_quantiles(win.strided_sample(train, "is_valid", SAMPLE))


@query("label_quantiles_train", TRAIN_SQL + " SELECT n, round(q90, 9) AS q90, round(q99, 9) AS q99, round(q100, 9) AS q100, n >= 1000 AS enough FROM st")
def _(q):
    return train_stats(q)[1].select("n", r("q90").alias("q90"), r("q99").alias("q99"), r("q100").alias("q100"), "enough")


@query("stride_sample", TRAIN_SQL + f" SELECT {IDS} FROM sm")
def _(q):
    return win.strided_sample(labelled(q).where(clock.split_of(F.col("date"), SPLITS) == "train"), "is_valid", SAMPLE).select(*ID)


@query(
    "label_scale_clip",
    TRAIN_SQL
    + f""", sc AS (SELECT lab.*, CAST(r_raw * 37.0 AS FLOAT) AS y, CAST(greatest(round(q99, 6) * CAST(37 AS DOUBLE), 1e-12 * 37) AS FLOAT) AS lim FROM lab, st)
    SELECT {IDS}, round(CAST(CASE WHEN y IS NOT NULL THEN least(greatest(y, -lim), lim) END AS DOUBLE), 5) + 0.0 AS r_scaled, coalesce(abs(y) > lim, false) AS was_clipped FROM sc""",
)
def _(q):
    lab, st = train_stats(q)
    y, clipped = features.scale_clip(F.col("r_raw"), 37.0, features.clip_limit(F.round("q99", 6), 37.0))
    return lab.join(F.broadcast(st.select("q99"))).select(*ID, r(y, 5).alias("r_scaled"), clipped.alias("was_clipped"))


@query("sample_weight", TRAIN_SQL + f" SELECT {IDS}, round(CASE WHEN r_raw IS NULL THEN 0.0 ELSE least(greatest(1 + least(greatest(abs(r_raw) / q90, 0.0), 3.0), 0.5), 4.0) END, 7) AS weight FROM lab, st")
def _(q):
    lab, st = train_stats(q)
    return lab.join(F.broadcast(st.select("q90"))).select(*ID, r(features.sample_weight(F.col("r_raw"), F.col("q90")), 7).alias("weight"))


# ---------------------------------------------------------------------------------------
# Features

SHARES_SQL = ", sh AS (SELECT stock_code, 100000000 + 1000000 * row_number() OVER (ORDER BY stock_code) AS shares FROM (SELECT DISTINCT stock_code FROM q))"


def with_shares(q: DataFrame) -> DataFrame:
    """Float shares by stock, a dimension of one row a stock."""
    s = q.select("stock_code").distinct()
    s = s.withColumn("shares", 100_000_000 + 1_000_000 * F.expr("row_number() OVER (ORDER BY stock_code)"))
    return q.join(s, "stock_code")


@query("ffill_fill", f" SELECT {IDS}, coalesce(last_value(f0 IGNORE NULLS) OVER w, 0) AS f0, coalesce(last_value(f1 IGNORE NULLS) OVER w, 0) AS f1 FROM q WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(q):
    return win.forward_fill(q, ["f0", "f1"]).select(*ID, "f0", "f1")


def ewm_sql(column: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce(list(CAST({column} AS DOUBLE)) FILTER ({column} IS NOT NULL) OVER (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda e, x: e * {1 - a!r} + x * {a!r})"


DV_SQL = f", dv AS (SELECT *, greatest(coalesce(acc_volume - lag(acc_volume) OVER {OVER_ROW}, 0), 0) AS dv FROM q)"


@query("volume_norm_ewm", DV_SQL + f", em AS (SELECT *, {ewm_sql('dv', 20)} AS e FROM dv) SELECT {IDS}, round(f0 / greatest(e, 1.0), 8) + 0.0 AS volume_norm FROM em")
def _(q):
    return rounded(features.volume_normalise(q, "f0", 20), "volume_norm", digits=8)


@query(
    "mcap_norm",
    SHARES_SQL + f" SELECT {IDS}, round(f0 / greatest(CASE WHEN ok THEN bid_tk + ask_tk WHEN last_tk > 0 THEN 2 * last_tk END / 20000.0 * shares, CASE WHEN ok OR last_tk > 0 THEN 1.0 END) * 1000000, 6) + 0.0 AS mcap_norm FROM q JOIN sh USING (stock_code)",
)
def _(q):
    m = features.mcap_normalise(with_shares(q), "f0", "shares", strict=False)
    return m.select(*ID, r(F.col("mcap_norm") * 1_000_000, 6).alias("mcap_norm"))


@query(
    "input_stats_train",
    label_sql()
    + f""", t AS (SELECT * FROM lab WHERE {SPLIT_SQL} = 'train' AND invalid_reason = 0), u AS (SELECT 'f0' AS factor, f0 AS x FROM t UNION ALL SELECT 'f1', f1 FROM t UNION ALL SELECT 'f2', f2 FROM t)
    SELECT factor, count(x) AS n, round(avg(x), 6) AS mean, round(greatest(stddev_samp(x), 1e-6), 6) AS std FROM u GROUP BY 1""",
)
def _(q):
    on = F.col("is_valid") & (clock.split_of(F.col("date"), SPLITS) == "train")
    return features.input_stats(labelled(q), ["f0", "f1", "f2"], on).select("factor", "n", r("mean", 6).alias("mean"), r("std", 6).alias("std"))


ELIGIBLE_SQL = f""", g AS (SELECT *, t_ms - lag(t_ms) OVER {OVER_ROW} AS gap, t_ms - lag(t_ms, {ROWS - 1}) OVER {OVER_ROW} AS span FROM q),
 el AS (SELECT *, row_idx >= {ROWS - 1} AS enough, row_idx >= {ROWS - 1} AND span > {SPAN} AS span_bad,
        row_idx >= {ROWS - 1} AND (max(gap) OVER w > {GAP} OR min(gap) OVER w < 0) AS gap_bad FROM g
        WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN {ROWS - 2} PRECEDING AND CURRENT ROW)),
 ok_ AS (SELECT *, enough AND NOT span_bad AND NOT gap_bad AS end_ok FROM el)"""


def eligible(q: DataFrame) -> DataFrame:
    return win.window_eligible(q, ROWS, SPAN, GAP)


@query("window_eligible", ELIGIBLE_SQL + f" SELECT {IDS}, end_ok, coalesce(span_bad, false) AS span_bad, coalesce(gap_bad, false) AS gap_bad FROM ok_")
def _(q):
    return eligible(q).select(*ID, "end_ok", "span_bad", "gap_bad")


WEIGHT_SQL = "CASE WHEN event_id % 19 = 0 THEN 0 WHEN event_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 29 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 1 END"


@query("window_eligible_weighted", ELIGIBLE_SQL + f", wt AS (SELECT *, {WEIGHT_SQL} AS w FROM ok_) SELECT {IDS}, end_ok AND w > 0 AND isfinite(w) AS end_ok FROM wt")
def _(q):
    i = F.col("event_id")
    w = F.when(i % 19 == 0, 0.0).when(i % 23 == 0, float("nan")).when(i % 29 == 0, float("inf")).otherwise(1.0)
    return win.window_eligible(q, ROWS, SPAN, GAP, weight=w).select(*ID, "end_ok")


RUNS_SQL = ELIGIBLE_SQL + f", isl AS (SELECT *, row_idx - row_number() OVER {OVER_ROW} AS g_ FROM ok_ WHERE end_ok), runs AS (SELECT {KEYS}, min(row_idx) AS run_start, count(*) AS run_len FROM isl GROUP BY {KEYS}, g_)"


@query("end_runs", RUNS_SQL + f" SELECT {KEYS}, run_start, run_len FROM runs")
def _(q):
    return win.islands(eligible(q), "end_ok").select(*KEY, "run_start", "run_len")


BLOCKS_SQL = RUNS_SQL + f", blk AS (SELECT {KEYS}, run_start, run_start + n * 4 AS block_start, least(4, run_len - n * 4) AS block_len FROM (SELECT *, unnest(range(0, (run_len - 1) // 4 + 1)) AS n FROM runs))"


@query("end_blocks", BLOCKS_SQL + f" SELECT {KEYS}, block_start, block_len FROM blk")
def _(q):
    return win.blocks(win.islands(eligible(q), "end_ok"), 4).select(*KEY, "block_start", "block_len")


@query(
    "run_block_mismatch",
    BLOCKS_SQL
    + f""", broken AS (SELECT {KEYS}, run_start, CASE WHEN block_start % 11 = 0 THEN block_start - 1 ELSE block_start END AS block_start, block_len FROM blk WHERE block_start % 7 <> 0),
     rows_ AS (SELECT {KEYS}, run_start, unnest(range(block_start, block_start + block_len)) AS x FROM broken),
     seen AS (SELECT {KEYS}, run_start, x, count(*) AS times FROM rows_ GROUP BY ALL),
     want AS (SELECT {KEYS}, run_start, unnest(range(run_start, run_start + run_len)) AS x FROM runs)
    SELECT DISTINCT {KEYS}, run_start FROM want FULL JOIN seen USING (stock_code, date, session, run_start, x) WHERE times IS NULL OR times > 1 OR NOT EXISTS
      (SELECT 1 FROM want w WHERE w.stock_code = seen.stock_code AND w.date = seen.date AND w.session = seen.session AND w.run_start = seen.run_start AND w.x = seen.x)""",
)
def _(q):
    runs = win.islands(eligible(q), "end_ok").select(*KEY, "run_start", "run_len")
    blocks = win.blocks(runs, 4).where("block_start % 7 <> 0")
    blocks = blocks.withColumn("block_start", F.when(F.col("block_start") % 11 == 0, F.col("block_start") - 1).otherwise(F.col("block_start")))
    return catalog.run_block_mismatch(runs, blocks)


@query(
    "window_arrays_reltime",
    ELIGIBLE_SQL
    + f""", ar AS (SELECT *, list(t_ms) OVER w AS ts, list(coalesce(f0, -1)) OVER w AS xs FROM ok_ WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))
    SELECT {IDS}, array_to_string(list_transform(ts, lambda t: CAST(t - ts[1] AS VARCHAR)), ',') AS rel_ms, array_to_string(list_transform(xs, lambda x: CAST(x AS VARCHAR)), ',') AS history FROM ar WHERE end_ok""",
)
def _(q):
    a = win.window_arrays(eligible(q), ["f0"], ROWS)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return a.select(*ID, text("rel_ms").alias("rel_ms"), text(F.transform("history", lambda z: F.coalesce(z["f0"], F.lit(-1)))).alias("history"))


@query(
    "window_linear_score",
    ELIGIBLE_SQL
    + f""", ar AS (SELECT *, list(coalesce(f0, 0)) OVER w AS xs FROM ok_ WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))
    SELECT {IDS}, CAST(xs[1] + 2 * xs[2] + 3 * xs[3] + 4 * xs[4] + 5 * xs[5] AS BIGINT) AS pred FROM ar WHERE end_ok""",
)
def _(q):
    a = win.window_arrays(eligible(q), ["f0"], ROWS)
    score = sum(((i + 1) * F.coalesce(F.col("history")[i]["f0"], F.lit(0)) for i in range(ROWS)), F.lit(0))
    return a.select(*ID, score.cast("long").alias("pred"))


@query("row_batches", f" SELECT {KEYS}, (row_number() OVER {OVER_ROW} - 1) // 16 AS batch_id, event_id FROM q")
def _(q):
    return win.batches(q, 16).select(*KEY, "batch_id", "event_id")


# ---------------------------------------------------------------------------------------
# Order book

E = "1e-12"
BZ, AZ = " + ".join(f"bz{i}" for i in range(5)), " + ".join(f"az{i}" for i in range(5))
WB, WA = (" + ".join(f"{p}{i} * {1.0 / (i + 1)!r}" for i in range(5)) for p in ("bz", "az"))
MID = "(coalesce(bid0 + ask0, 2 * last_tk) / 2)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / ({b} + {E}))"


MICRO = div("ask0 * bz0 + bid0 * az0", "bz0 + az0")


@query("book_spread_micro", f" SELECT {IDS}, {sql_rounded(('spread', 'ask0 - bid0'), ('rel_spread', div('ask0 - bid0', MID)), ('microprice', MICRO), ('microprice_dev', div(f'{MICRO} - {MID}', MID)))} FROM q")
def _(q):
    return rounded(book.spread_micro(q), "spread", "rel_spread", "microprice", "microprice_dev")


@query(
    "book_depth_imbalance",
    f""" SELECT {IDS}, {sql_rounded(("depth_bid_L4", BZ), ("depth_ask_L4", AZ), ("log_depth_total_L4", f"ln(1 + {BZ} + {AZ})"), ("obi_L1", div("bz0 - az0", "bz0 + az0")),
       ("depth_ask_L1", "az0"), ("log_depth_bid_L1", "ln(1 + greatest(bz0, 0))"), ("log_depth_ask_L1", "ln(1 + greatest(az0, 0))"),
       ("obi_L4", div(f"({BZ}) - ({AZ})", f"{BZ} + {AZ}")), ("wobi_L4", div(f"({WB}) - ({WA})", f"({WB}) + ({WA})")))} FROM q""",
)
def _(q):
    return rounded(book.depth_imbalance(q), "depth_bid_L4", "depth_ask_L4", "log_depth_total_L4", "depth_ask_L1", "log_depth_bid_L1", "log_depth_ask_L1", "obi_L1", "obi_L4", "wobi_L4")


SB, SA = div(f"({MID} - bid4)", f"({BZ})"), div(f"(ask4 - {MID})", f"({AZ})")


# with an empty book these are a price over 1e-12: six significant digits of that are compared
def scaled(name: str) -> str:
    return f"CASE WHEN abs({name}) > 1e6 THEN round({name} / 1e10, 3) ELSE round({name}, 9) END + 0.0 AS {name}"


@query(
    "book_slope_curvature",
    f""", sl AS (SELECT *, {SB} AS slope_bid_L4, {SA} AS slope_ask_L4, {SA} - {SB} AS slope_asym, {div(div(f"({MID} - bid0)", "bz0"), SB)} AS curv_bid_L1_over_L4, {div(div(f"(ask0 - {MID})", "az0"), SA)} AS curv_ask_L1_over_L4 FROM q)
    SELECT {IDS}, {", ".join(scaled(n) for n in ("slope_bid_L4", "slope_ask_L4", "slope_asym", "curv_bid_L1_over_L4", "curv_ask_L1_over_L4"))} FROM sl""",
)
def _(q):
    big = lambda n: (F.when(F.abs(F.col(n)) > 1e6, F.round(F.col(n) / 1e10, 3)).otherwise(F.round(F.col(n), 9)) + F.lit(0.0)).alias(n)
    return book.slope_curvature(q).select(*ID, *[big(n) for n in ("slope_bid_L4", "slope_ask_L4", "slope_asym", "curv_bid_L1_over_L4", "curv_ask_L1_over_L4")])


def churn_sql(p: str) -> str:
    moved = " + ".join(f"abs({p}{i} - lag({p}{i}) OVER w)" for i in range(5))
    return div(moved, f"lag({BZ if p == 'bz' else AZ}) OVER w")


CHURN = [(f"churn_{n}", f"CASE WHEN abs({e}) > 1e6 THEN round(({e}) / 1e12, 3) ELSE round({e}, 9) END") for n, e in (("bid_L4", churn_sql("bz")), ("ask_L4", churn_sql("az")), ("asym", f"({churn_sql('bz')} - {churn_sql('az')})"))]


@query("book_churn", f" SELECT {IDS}, {', '.join(f'coalesce({e}, 0) + 0.0 AS {n}' for n, e in CHURN)} FROM q WINDOW w AS {OVER_ROW}")
def _(q):
    big = lambda n: (F.when(F.abs(F.col(n)) > 1e6, F.round(F.col(n) / 1e12, 3)).otherwise(F.round(F.col(n), 9)) + F.lit(0.0)).alias(n)
    return book.churn(q).select(*ID, *[big(n) for n in ("churn_bid_L4", "churn_ask_L4", "churn_asym")])


#: The rule in words: the sign of all levels' imbalance, 0 where it is missing; a run breaks where the sign changes or is 0.
RUN_SQL = f""", s0 AS (SELECT *, coalesce(sign(({BZ}) - ({AZ})), 0) AS sg FROM q), s1 AS (SELECT *, CASE WHEN coalesce(lag(sg) OVER {OVER_ROW}, 9) <> sg THEN 1 ELSE 0 END AS nw FROM s0),
 s2 AS (SELECT *, sum(nw) OVER {OVER_ROW} AS grp FROM s1)"""


@query(
    "obi_runlength",
    RUN_SQL
    + f""", s3 AS (SELECT *, CAST(CASE WHEN sg = 0 THEN 0 ELSE row_number() OVER (PARTITION BY {KEYS}, grp ORDER BY row_idx) END AS INT) AS obi_runlen FROM s2)
    SELECT {IDS}, obi_runlen, round(CASE WHEN obi_runlen >= 5 AND sg <> 0 THEN {div(f"({BZ}) - ({AZ})", f"({BZ}) + ({AZ})")} ELSE 0.0 END, 9) + 0.0 AS obi_persistent FROM s3""",
)
def _(q):
    return book.obi_runs(q).select(*ID, F.col("obi_runlen").cast("int").alias("obi_runlen"), r("obi_persistent").alias("obi_persistent"))


@query(
    "obi_flicker",
    RUN_SQL
    + f""", f0_ AS (SELECT *, lag(sg) OVER {OVER_ROW} AS pv FROM s0), f1_ AS (SELECT *, CASE WHEN sg = 0 THEN 0 WHEN pv IS NULL THEN 1 WHEN pv <> 0 AND pv <> sg THEN 1 ELSE 0 END AS fl FROM f0_)
    SELECT {IDS}, CAST(coalesce(CASE WHEN count(*) OVER w >= 3 THEN sum(fl) OVER w END, 0) AS BIGINT) AS obi_flicker_cnt, round(coalesce(CASE WHEN count(*) OVER w >= 3 THEN sum(fl) OVER w END, 0) / 10.0, 9) AS obi_flicker_rate FROM f1_ WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _(q):
    return book.obi_flicker(q, 10).select(*ID, F.col("obi_flicker_cnt").cast("long").alias("obi_flicker_cnt"), r("obi_flicker_rate").alias("obi_flicker_rate"))


def ofi_sql() -> str:
    def side(p: str, z: str, op: str) -> str:
        return f"CASE WHEN {p} {op} lag({p}) OVER w THEN {z} WHEN {p} = lag({p}) OVER w THEN {z} - lag({z}) OVER w ELSE -lag({z}) OVER w END"

    cols = ", ".join(f"({side(f'bid{i}', f'bz{i}', '>')}) - ({side(f'ask{i}', f'az{i}', '<')}) AS raw{i}" for i in range(5))
    cols += ", " + ", ".join(f"coalesce(raw{i}, 0) AS ofi{i}" for i in range(5))
    return f", o0 AS (SELECT *, {cols} FROM q WINDOW w AS {OVER_ROW}), o1 AS (SELECT *, CAST({' + '.join(f'raw{i} * CAST({1.0 / (i + 1)!r} AS DOUBLE)' for i in range(5))} AS DOUBLE) AS iofi FROM o0)"


@query("book_ofi", ofi_sql() + f" SELECT {IDS}, ofi0, ofi1, ofi2, ofi3, ofi4, coalesce(round(iofi, 6), 0) + 0.0 AS iofi FROM o1")
def _(q):
    return book.ofi(q).select(*ID, *[f"ofi{i}" for i in range(5)], r("iofi", 6).alias("iofi"))


@query("ofi_rolling_vol", ofi_sql() + f" SELECT {IDS}, round(coalesce(CASE WHEN count(iofi) OVER w >= 5 THEN stddev_samp(iofi) OVER w END, 0), 6) AS iofi_vol FROM o1 WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def _(q):
    return rounded(book.ofi_volatility(q, 10), "iofi_vol", digits=6)


@query("ofi_ema_surprise", ofi_sql() + f", em AS (SELECT *, {ewm_sql('iofi', 50)} AS e FROM o1) SELECT {IDS}, round(lag(e) OVER w, 6) + 0.0 AS iofi_ema_past, coalesce(round(iofi - lag(e) OVER w, 6), 0) + 0.0 AS iofi_surprise FROM em WINDOW w AS {OVER_ROW}")
def _(q):
    return rounded(book.ofi_surprise(q, 50), "iofi_ema_past", "iofi_surprise", digits=6)


@query(
    "ofi_norm_ewm",
    ofi_sql()
    + f""", d0 AS (SELECT *, greatest(coalesce(acc_volume - lag(acc_volume) OVER {OVER_ROW}, 0), 0) AS dv FROM o1),
     em AS (SELECT *, greatest({ewm_sql("dv", 200)}, 1.0) + 1e-12 AS by_, {ewm_sql("iofi", 50)} AS e,
            CASE WHEN count(iofi) OVER v >= 5 THEN stddev_samp(iofi) OVER v END AS sd FROM d0 WINDOW v AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
     pa AS (SELECT *, iofi - lag(e) OVER {OVER_ROW} AS su FROM em)
    SELECT {IDS}, {", ".join(f"coalesce(round(raw{i} / by_, 8), 0) + 0.0 AS ofi_norm_L{i + 1}" for i in range(4))},
           coalesce(round(iofi / by_, 8), 0) + 0.0 AS iofi_norm, coalesce(round(su / by_, 6), 0) + 0.0 AS iofi_surprise_norm, coalesce(round(sd / by_, 6), 0) + 0.0 AS iofi_vol_norm FROM pa""",
)
def _(q):
    n = book.ofi_normalised(q, 200, vol_rows=10)
    names = [*(f"ofi_norm_L{i + 1}" for i in range(4)), "iofi_norm"]
    return n.select(*ID, *[r(c, 8).alias(c) for c in names], *[r(c, 6).alias(c) for c in ("iofi_surprise_norm", "iofi_vol_norm")])


def impact_sql(p: str, z: str) -> str:
    cum = lambda i: " + ".join(f"{z}{j}" for j in range(i + 1))
    whole = BZ if z == "bz" else AZ
    return "CASE " + " ".join(f"WHEN ({whole}) * 50 <= ({cum(i)}) * 100 THEN {p}{i}" for i in range(5)) + " END"


@query("impact_sweep", f" SELECT {IDS}, {sql_rounded(('impact_buy_f50', div(f'{impact_sql('ask', 'az')} - {MID}', MID)), ('impact_sell_f50', div(f'{MID} - {impact_sql('bid', 'bz')}', MID)), ('impact_asym_f50', f"{div(f'{impact_sql('ask', 'az')} - {MID}', MID)} - {div(f'{MID} - {impact_sql('bid', 'bz')}', MID)}"))} FROM q")
def _(q):
    return rounded(book.impact(q), "impact_buy_f50", "impact_sell_f50", "impact_asym_f50")


DT_SQL = f", d0 AS (SELECT *, t_ms - lag(t_ms) OVER {OVER_ROW} AS st FROM q), d1 AS (SELECT *, coalesce(CAST(CASE WHEN st > 0 THEN st END AS DOUBLE), median(CASE WHEN st > 0 THEN st END) OVER (PARTITION BY {KEYS})) AS dt_ms FROM d0)"


@query("time_step", DT_SQL + f" SELECT {IDS}, round(dt_ms, 3) AS dt_ms FROM d1")
def _(q):
    return rounded(book.time_step(q), "dt_ms", digits=3)


VWAP = "(CAST(turnover AS DOUBLE) / nullif(volume, 0))"


@query(
    "trade_rates_vwap",
    DT_SQL
    + f""" SELECT {IDS}, {sql_rounded(("vol_rate", "volume * 1000.0 / (dt_ms + 1e-12)"), ("amt_rate", "turnover * 1000.0 / (dt_ms + 1e-12)"), ("vwap_tick", VWAP), digits=6)},
       CAST(volume > 0 AS INT) AS trade_flag, round(CASE WHEN volume > 0 THEN {div(f"{VWAP} - {MID}", MID)} ELSE 0.0 END, 9) + 0.0 AS vwap_dev FROM d1""",
)
def _(q):
    t = book.trade_rates(q)
    return t.select(*ID, *[r(c, 6).alias(c) for c in ("vol_rate", "amt_rate", "vwap_tick")], "trade_flag", r("vwap_dev").alias("vwap_dev"))


@query(
    "illiquidity",
    f""", pd AS (SELECT *, last_value({MID} IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM q),
     rm AS (SELECT *, coalesce(pad / nullif(lag(pad) OVER {OVER_ROW}, 0) - 1, 0) AS r_mid FROM pd)
    SELECT {IDS}, round(r_mid, 9) + 0.0 AS r_mid, round(CASE WHEN turnover > 0 THEN abs(r_mid) / turnover ELSE 0 END * 1e9, 6) AS illiq_e9 FROM rm""",
)
def _(q):
    return book.illiquidity(q).select(*ID, r("r_mid").alias("r_mid"), r(F.col("illiq") * 1e9, 6).alias("illiq_e9"))


@query("turnover_ratios", SHARES_SQL + f" SELECT {IDS}, round(volume / CAST(shares AS DOUBLE), 12) AS vol_ratio_tick, round(turnover / nullif({MID} * shares, 0), 12) AS amt_ratio_tick FROM q JOIN sh USING (stock_code)")
def _(q):
    return rounded(book.turnover_ratios(with_shares(q), F.col("shares")), "vol_ratio_tick", "amt_ratio_tick", digits=12)


# ---------------------------------------------------------------------------------------
# Baselines and audit

BASE_SQL = f""", dd AS (SELECT stock_code, session, date, row_number() OVER (PARTITION BY stock_code, session ORDER BY date) AS rk FROM (SELECT DISTINCT {KEYS} FROM q)),
 qb AS (SELECT q.*, CAST(least(greatest(t_ms // 7200000, 0), 11) AS INT) AS bucket, rk FROM q JOIN dd USING (stock_code, session, date)),
 bs AS (SELECT d.stock_code, d.date, d.session, h.bucket, count(h.f0) AS n, avg(h.f0) AS mu, CASE WHEN count(h.f0) >= 2 THEN stddev_pop(h.f0) END AS sigma
        FROM dd d JOIN qb h ON d.stock_code = h.stock_code AND d.session = h.session AND h.rk BETWEEN d.rk - 5 AND d.rk - 1 GROUP BY 1, 2, 3, 4)"""


@query("bucket_baseline_stats", BASE_SQL + f" SELECT {KEYS}, bucket, n, round(mu, 8) AS mu, round(sigma, 7) AS sigma FROM bs WHERE n > 0")
def _(q):
    s = baseline.bucket_stats(q, "f0", 5, 7200)
    return s.select(*KEY, "bucket", "n", r("mu", 8).alias("mu"), r("sigma", 7).alias("sigma"))


@query("bucket_baseline_zscore", BASE_SQL + f" SELECT {', '.join('qb.' + x for x in ID)}, round(CASE WHEN n >= 5 THEN coalesce((f0 - mu) / (sigma + 1e-12), 0) ELSE 0 END, 4) + 0.0 AS z FROM qb LEFT JOIN bs USING (stock_code, date, session, bucket)")
def _(q):
    return rounded(baseline.z_scores(q, baseline.bucket_stats(q, "f0", 5, 7200), "f0", 7200, 5), "z", digits=4)


AUDIT_SQL = f""", t AS (SELECT * FROM q WHERE {SPLIT_SQL} = 'train'), u AS (SELECT stock_code, 'f0' AS factor, abs(f0) AS x FROM t UNION ALL SELECT stock_code, 'f1', abs(f1) FROM t UNION ALL SELECT stock_code, 'f2', abs(f2) FROM t),
 qu AS (SELECT stock_code, factor, quantile_cont(CAST(x AS DOUBLE), 0.9) AS q FROM u WHERE x IS NOT NULL GROUP BY 1, 2),
 ra AS (SELECT factor, count(*) AS stocks, max(q) / min(q) AS ratio, abs(ln(max(q) / min(q))) AS dispersion FROM (SELECT stock_code, factor, greatest(q, 1e-12) AS q FROM qu) GROUP BY 1)"""


def train_rows(q: DataFrame) -> DataFrame:
    return q.where(clock.split_of(F.col("date"), SPLITS) == "train")


@query("scale_audit_ratio", AUDIT_SQL + " SELECT factor, stocks, round(ratio, 9) AS ratio, round(dispersion, 9) AS dispersion FROM ra")
def _(q):
    a = baseline.scale_ratio(baseline.factor_quantiles(train_rows(q), ["f0", "f1", "f2"], 0.9))
    return a.select("factor", "stocks", r("ratio").alias("ratio"), r("dispersion").alias("dispersion"))


#: The audit by its definition: ratios of raw and of both normalised factors; the closest normalisation within tolerance, else none.
METHOD_SQL = (
    DV_SQL
    + SHARES_SQL
    + f""", em AS (SELECT dv.*, shares, greatest({ewm_sql("dv", 200)}, 1.0) AS by_volume, greatest(coalesce(bid_tk + ask_tk, 2 * last_tk) / 20000.0 * shares, 1.0) AS by_value FROM dv JOIN sh USING (stock_code)),
 lg AS (SELECT stock_code, n AS method, f AS factor, abs(CASE f WHEN 'f0' THEN f0 WHEN 'f1' THEN f1 ELSE f2 END) / CASE n WHEN 'raw' THEN 1.0 WHEN 'volume_norm' THEN by_volume ELSE by_value END AS x
        FROM em, (VALUES ('f0'), ('f1'), ('f2')) a(f), (VALUES ('raw'), ('volume_norm'), ('mcap_norm')) b(n) WHERE {SPLIT_SQL} = 'train'),
 qs AS (SELECT stock_code, method, factor, greatest(quantile_cont(CAST(x AS DOUBLE), 0.9), 1e-12) AS q FROM lg WHERE x IS NOT NULL GROUP BY 1, 2, 3),
 rt AS (SELECT method, factor, max(q) / min(q) AS ratio FROM qs GROUP BY 1, 2)"""
)


def audited(q: DataFrame) -> dict[str, DataFrame]:
    names = ["f0", "f1", "f2"]
    both = features.with_volume_mean(with_shares(q), 200).withColumn("value_", features.market_value(F.col("shares"), price.audit_mid2(F.col("bid_tk"), F.col("ask_tk"), F.col("last_tk")), strict=False))
    both = train_rows(both.withColumn("value_", F.coalesce("value_", F.lit(1.0))))
    by = {"raw": F.lit(1.0), "volume_norm": F.col("volume_mean"), "mcap_norm": F.col("value_")}
    return {m: baseline.scale_ratio(baseline.factor_quantiles(both.select("stock_code", *[(F.col(c) / d).alias(c) for c in names]), names, 0.9)) for m, d in by.items()}


@query("scale_audit_report", METHOD_SQL + " SELECT method, factor, round(ratio, 6) AS ratio FROM rt")
def _(q):
    out = None
    for m, a in audited(q).items():
        a = a.select(F.lit(m).alias("method"), "factor", r("ratio", 6).alias("ratio"))
        out = a if out is None else out.unionByName(a)
    return out


def method_sql(tolerance: float) -> str:
    return f""", ok_ AS (SELECT factor, method, ratio, row_number() OVER (PARTITION BY factor ORDER BY method <> 'raw', ratio, method <> 'volume_norm') AS place FROM rt WHERE ratio <= {tolerance})
    SELECT factor, coalesce(method, 'none') AS method, {tolerance} AS tolerance FROM (SELECT DISTINCT factor FROM rt) LEFT JOIN (SELECT * FROM ok_ WHERE place = 1) USING (factor)"""


@query("scale_audit_method", METHOD_SQL + method_sql(1.02))
def _(q):
    a = audited(q)
    return baseline.best_method(a["raw"], a["volume_norm"], a["mcap_norm"], 1.02).withColumn("tolerance", F.lit("1.02").cast("decimal(3,2)"))


# ---------------------------------------------------------------------------------------
# Evaluation

PRED_SQL = label_sql() + ", pr AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN pred_m END AS pred FROM lab), ev AS (SELECT * FROM pr WHERE pred IS NOT NULL AND r_raw IS NOT NULL)"


def predicted(q: DataFrame) -> DataFrame:
    return labelled(q).withColumn("pred", F.when(F.col("event_id") % 13 != 0, F.col("pred_m")))


def bundle(q: DataFrame) -> DataFrame:
    return predicted(q).where("pred is not null").select(*KEY, F.col("row_idx").alias("end_row"), "t_ms", "pred")


@query("align_predictions", PRED_SQL + f" SELECT {KEYS}, row_idx AS end_row, pred, r_raw, invalid_reason = 0 AS is_valid FROM pr WHERE pred IS NOT NULL")
def _(q):
    return evaluate.align(bundle(q), labelled(q)).select(*KEY, "end_row", "pred", "r_raw", "is_valid")


@query(
    "alignment_problems",
    f""", p AS (SELECT {KEYS}, CASE WHEN event_id % 53 = 0 THEN row_idx + 1000000 ELSE row_idx END AS end_row, CASE WHEN event_id % 50 = 0 THEN t_ms + 1 WHEN event_id % 59 <> 0 THEN t_ms END AS t, event_id FROM q WHERE event_id % 13 <> 0),
     d AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE event_id % 61 = 0)
    SELECT DISTINCT {KEYS}, end_row, CASE WHEN event_id % 61 = 0 THEN 'repeated' WHEN event_id % 53 = 0 THEN 'row' ELSE 'time' END AS problem FROM d WHERE event_id % 61 = 0 OR event_id % 53 = 0 OR event_id % 50 = 0 OR event_id % 59 = 0""",
)
def _(q):
    i = F.col("event_id")
    p = q.where(i % 13 != 0).select(*KEY, F.when(i % 53 == 0, F.col("row_idx") + 1_000_000).otherwise(F.col("row_idx")).alias("end_row"), F.when(i % 50 == 0, F.col("t_ms") + 1).when(i % 59 != 0, F.col("t_ms")).alias("t_ms"), "event_id")
    return evaluate.alignment_problems(p.unionByName(p.where(i % 61 == 0)), q)


@query("timeline_predictions", f" SELECT {IDS}, CASE WHEN event_id % 13 <> 0 THEN pred_m END AS pred FROM q")
def _(q):
    return evaluate.on_timeline(q, bundle(q)).select(*ID, "pred")


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN count(*) < 2 OR stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN 0.0 ELSE corr({x}, {y}) END"


IC_SQL = PRED_SQL + f", ic AS (SELECT {KEYS}, count(*) AS n, {corr_sql('pred', 'r_raw')} AS ic FROM ev GROUP BY {KEYS})"


@query("session_ic", IC_SQL + f" SELECT {KEYS}, n, round(ic, 6) + 0.0 AS ic FROM ic")
def _(q):
    return evaluate.session_ic(predicted(q)).select(*KEY, "n", r("ic", 6).alias("ic"))


@query(
    "session_rank_ic",
    PRED_SQL
    + f""", rk AS (SELECT {KEYS}, rank() OVER (PARTITION BY {KEYS} ORDER BY pred) + (count(*) OVER (PARTITION BY {KEYS}, pred) - 1) / 2.0 AS x,
       rank() OVER (PARTITION BY {KEYS} ORDER BY r_raw) + (count(*) OVER (PARTITION BY {KEYS}, r_raw) - 1) / 2.0 AS y FROM ev)
    SELECT {KEYS}, count(*) AS n, round({corr_sql("x", "y")}, 6) + 0.0 AS rank_ic FROM rk GROUP BY {KEYS}""",
)
def _(q):
    return evaluate.session_rank_ic(predicted(q)).select(*KEY, "n", r("rank_ic", 6).alias("rank_ic"))


@query("ic_summary", IC_SQL + " SELECT count(ic) AS sessions, round(avg(ic), 6) + 0.0 AS ic_mean, round(CASE WHEN count(ic) <= 1 OR stddev_samp(ic) = 0 THEN 0.0 ELSE avg(ic) / stddev_samp(ic) END, 6) + 0.0 AS icir FROM ic")
def _(q):
    return evaluate.ic_summary(evaluate.session_ic(predicted(q))).select("sessions", r("ic_mean", 6).alias("ic_mean"), r("icir", 6).alias("icir"))


@query("pooled_ic", PRED_SQL + f", sp AS (SELECT {SPLIT_SQL} AS split, * FROM ev) SELECT split, count(*) AS n, round({corr_sql('pred', 'r_raw')}, 6) + 0.0 AS ic FROM sp GROUP BY split")
def _(q):
    p = predicted(q).withColumn("split", clock.split_of(F.col("date"), SPLITS))
    return evaluate.session_ic(p, ("split",)).select("split", "n", r("ic", 6).alias("ic"))


def events_sql(side: str, cond: str, sign: int) -> str:
    return f"SELECT '{side}' AS side, avg(r_raw) * {sign} AS m, count(*) AS n FROM (SELECT *, row_idx - row_number() OVER {OVER_ROW} AS g FROM ev, th WHERE {cond}) GROUP BY {KEYS}, g"


TH_SQL = ", th AS (SELECT quantile_cont(pred, 0.8) AS hi_t, quantile_cont(pred, 0.2) AS lo_t FROM ev)"
TOP_SQL = f", es AS ({events_sql('long', 'pred > hi_t', 1)} UNION ALL {events_sql('short', 'pred < lo_t', -1)}), ec AS (SELECT * FROM es UNION ALL SELECT 'combined', m, n FROM es)"


@query("topk_events", PRED_SQL + TH_SQL + TOP_SQL + " SELECT side, count(*) AS events, round(avg(n), 6) AS mean_rows, round(avg(m), 9) + 0.0 AS mean_return, round(avg(m) - 0.001, 9) + 0.0 AS net_return FROM ec GROUP BY side")
def _(q):
    ev = predicted(q).where("pred is not null and r_raw is not null")
    return evaluate.top_events(ev, 0.2, 0.001).select("side", "events", r("mean_rows", 6).alias("mean_rows"), r("mean_return").alias("mean_return"), r("net_return").alias("net_return"))


XY_SQL = PRED_SQL + ", xy AS (SELECT pred / 100000.0 AS x, r_raw AS y, 1 + event_id % 3 AS w FROM ev)"
METRICS = "count(*) AS n, round(avg((x - y) * (x - y)) * 1e6, 6) AS mse_e6, round(avg(abs(x - y)), 9) AS mae, round(avg(CAST((x >= 0) = (y >= 0) AS DOUBLE)), 9) AS sign_accuracy, round(corr(x, y), 6) + 0.0 AS pearson"


def xy(q: DataFrame) -> DataFrame:
    ev = predicted(q).where("pred is not null and r_raw is not null")
    return ev.select((F.col("pred") / 100_000.0).alias("x"), F.col("r_raw").alias("y"), (1 + F.col("event_id") % 3).alias("w"))


def shown(m: DataFrame) -> DataFrame:
    return m.select("n", r(F.col("mse") * 1e6, 6).alias("mse_e6"), r("mae").alias("mae"), r("sign_accuracy").alias("sign_accuracy"), r("pearson", 6).alias("pearson"))


@query("regression_metrics", XY_SQL + f" SELECT {METRICS} FROM xy")
def _(q):
    return shown(evaluate.regression_metrics(xy(q)))


@query("top_abs_metrics", XY_SQL + f", t AS (SELECT quantile_cont(abs(x), 0.9) AS t FROM xy) SELECT {METRICS} FROM xy, t WHERE abs(x) >= t")
def _(q):
    return shown(evaluate.regression_metrics(evaluate.top_abs(xy(q), 0.1)))


M_SQL = XY_SQL + """, m AS (SELECT sum(w) AS m, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy_,
   sum(w * (x - y) * (x - y)) AS sse, sum(w * CAST(sign(x) = sign(y) AS INT)) AS hit FROM xy)"""


@query("weighted_r2_diracc", M_SQL + " SELECT round(1 - sse / (m * (yy - my * my)), 6) AS weighted_r2, round(hit / m, 9) AS direction_accuracy FROM m")
def _(q):
    return evaluate.weighted_metrics(xy(q)).select(r("weighted_r2", 6).alias("weighted_r2"), r("direction_accuracy").alias("direction_accuracy"))


@query("weighted_ccc", M_SQL + " SELECT round(2 * (xy_ - mx * my) / ((xx - mx * mx) + (yy - my * my) + (mx - my) * (mx - my) + 1e-8), 6) + 0.0 AS ccc FROM m")
def _(q):
    return evaluate.weighted_metrics(xy(q)).select(r("ccc", 6).alias("ccc"))


@query("effective_sample_size", XY_SQL + " SELECT count(*) AS n, round(sum(w) * sum(w) / CAST(sum(w * w) * count(*) AS DOUBLE), 9) AS ess_ratio, round(sum(w * abs(y)) / sum(w), 9) AS zero_mae, round(stddev_pop(w), 9) AS w_std FROM xy")
def _(q):
    return evaluate.effective_sample(xy(q)).select("n", r("ess_ratio").alias("ess_ratio"), r("zero_mae").alias("zero_mae"), r("w_std").alias("w_std"))


# ---------------------------------------------------------------------------------------
# Backtest

CAL_SQL = f", cal AS (SELECT quantile_cont(pred_m, 0.95) AS thr_long, quantile_cont(pred_m, 0.05) AS thr_short FROM q WHERE ok AND {SPLIT_SQL} = 'val')"


def calibrated(q: DataFrame) -> DataFrame:
    backtest.require_order(SPLITS["val"], [SPLITS["test"]])
    return evaluate.thresholds(q.where(F.col("ok") & (clock.split_of(F.col("date"), SPLITS) == "val")), 0.05, 0.05, "pred_m")


@query("calibrate_thresholds", CAL_SQL + " SELECT round(thr_long, 6) AS thr_long, round(thr_short, 6) AS thr_short FROM cal")
def _(q):
    return calibrated(q).select(r("thr_long", 6).alias("thr_long"), r("thr_short", 6).alias("thr_short"))


POS_SQL = f""", sg AS (SELECT *, CASE WHEN ok AND event_id % 13 <> 0 THEN CASE WHEN pred_m > 450 THEN 1 WHEN pred_m < -450 THEN -1 END END AS sgn FROM q),
 ps AS (SELECT *, coalesce(last_value(sgn IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM sg)"""


def held(q: DataFrame) -> DataFrame:
    return backtest.positions(q.withColumn("pred", F.when(F.col("event_id") % 13 != 0, F.col("pred_m"))), F.lit(450), F.lit(-450))


@query("flip_positions", POS_SQL + f" SELECT {IDS}, CAST(position AS INT) AS position FROM ps")
def _(q):
    return held(q).select(*ID, "position")


SEG_SQL = POS_SQL + f""", lr AS (SELECT *, max(row_idx) OVER (PARTITION BY {KEYS}) AS last_row, coalesce(lag(position) OVER {OVER_ROW}, 0) AS before FROM ps),
 en AS (SELECT {KEYS}, ok AS end_ok, bid_tk AS end_bid, ask_tk AS end_ask FROM lr WHERE row_idx = last_row),
 ch AS (SELECT lr.*, end_ok, coalesce(lead(row_idx) OVER {OVER_ROW}, last_row) AS exit_row, coalesce(lead(bid_tk) OVER {OVER_ROW}, end_bid) AS exit_bid, coalesce(lead(ask_tk) OVER {OVER_ROW}, end_ask) AS exit_ask
        FROM lr JOIN en USING (stock_code, date, session) WHERE position <> before AND row_idx < last_row),
 seg AS (SELECT {KEYS}, CAST(position AS INT) AS direction, row_idx AS entry_row, exit_row, CASE WHEN position > 0 THEN ask_tk ELSE bid_tk END AS entry_tk,
        CASE WHEN position > 0 THEN exit_bid ELSE exit_ask END AS exit_tk, exit_row <> last_row OR end_ok AS terminal_ok FROM ch WHERE position <> 0)"""


@query("trade_segments", SEG_SQL + f" SELECT {KEYS}, direction, entry_row, exit_row, entry_tk, exit_tk, terminal_ok FROM seg")
def _(q):
    return backtest.segments(held(q))


BAD_SQL = f""", bad AS (SELECT {KEYS}, row_idx, 'open at the end' AS problem FROM lr WHERE row_idx = last_row AND before <> 0 AND NOT ok)"""


@query("segment_problems", SEG_SQL + BAD_SQL + f" SELECT {IDS}, problem FROM bad")
def _(q):
    return backtest.segment_problems(held(q)).select(*ID, "problem")


PNL_SQL = SEG_SQL + BAD_SQL + """, pl AS (SELECT *, direction * (exit_tk - entry_tk) / CAST(entry_tk AS DOUBLE) AS gross,
   0.0002 + CASE WHEN direction < 0 THEN 0.0005 ELSE 0 END + (0.0002 + CASE WHEN direction > 0 THEN 0.0005 ELSE 0 END) * exit_tk / CAST(entry_tk AS DOUBLE) AS cost FROM seg s WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.stock_code = s.stock_code AND b.date = s.date AND b.session = s.session)),
 dy AS (SELECT date, sum(gross - cost) AS net, sum(gross) AS gross, sum(cost) AS cost, count(*) AS trades FROM pl GROUP BY date),
 cu AS (SELECT *, sum(net) OVER (ORDER BY date) AS cumulative_net FROM dy)"""


def traded(q: DataFrame) -> DataFrame:
    """Trades of the sessions that can be closed; the others are what segment_problems reports."""
    return backtest.profit(backtest.segments(backtest.tradable(held(q), skip=True)))


@query("trade_pnl", PNL_SQL + f" SELECT {KEYS}, entry_row, {sql_rounded(('gross', 'gross'), ('cost', 'cost'), ('net', 'gross - cost'))} FROM pl")
def _(q):
    return rounded(traded(q), "gross", "cost", "net", keep=(*KEY, "entry_row"))


@query("daily_pnl_curve", PNL_SQL + f" SELECT date, trades, {sql_rounded(('net', 'net'), ('gross', 'gross'), ('cost', 'cost'), ('cumulative_net', 'cumulative_net'))} FROM cu")
def _(q):
    return rounded(backtest.daily(traded(q)), "net", "gross", "cost", "cumulative_net", keep=("date", "trades"))


@query(
    "backtest_metrics",
    PNL_SQL
    + """, pk AS (SELECT *, greatest(max(cumulative_net) OVER (ORDER BY date), 0) - cumulative_net AS fall FROM cu)
    SELECT count(*) AS days, CAST(sum(trades) AS BIGINT) AS trades, round(sum(net), 9) AS total_net, round(avg(net), 9) AS mean_net, round(avg(CAST(net > 0 AS DOUBLE)), 9) AS win_rate,
           round(avg(net) / stddev_samp(net) * sqrt(242), 6) AS annual_ratio, round(max(fall), 9) AS max_drawdown FROM pk""",
)
def _(q):
    s = backtest.summary(backtest.daily(traded(q)))
    return s.select("days", "trades", *[r(c).alias(c) for c in ("total_net", "mean_net", "win_rate")], r("annual_ratio", 6).alias("annual_ratio"), r("max_drawdown").alias("max_drawdown"))


# ---------------------------------------------------------------------------------------
# Catalog


@query(
    "session_catalog",
    f""", st AS (SELECT *, t_ms - lag(t_ms) OVER {OVER_ROW} AS d FROM q)
    SELECT {KEYS}, count(*) AS n_rows, arg_min(t_ms, row_idx) AS first_ms, arg_max(t_ms, row_idx) AS last_ms, coalesce(min(d) >= 0, true) AS monotonic, count(*) FILTER (NOT ok) AS bad_quotes FROM st GROUP BY {KEYS}""",
)
def _(q):
    return catalog.session_catalog(q)


@query(
    "dt_sample_stats",
    f""", st AS (SELECT *, t_ms - lag(t_ms) OVER {OVER_ROW} AS d FROM q WHERE row_idx < {SAMPLE}),
     ag AS (SELECT {KEYS}, count(*) AS stamps, list_sort(list(d) FILTER (d > 0)) AS ds FROM st GROUP BY {KEYS})
    SELECT {KEYS}, CAST(len(ds) AS INT) AS n, ds[len(ds) // 2 + 1] AS median_ms, ds[CAST(floor(0.99 * (len(ds) - 1)) AS INT) + 1] AS p99_ms FROM ag WHERE stamps >= 3 AND len(ds) > 0""",
)
def _(q):
    return catalog.dt_sample(q, SAMPLE)


PRESENT_SQL = f", have AS (SELECT DISTINCT {KEYS} FROM q WHERE NOT (stock_code = (SELECT min(stock_code) FROM q) AND date LIKE '%7'))"


def present(q: DataFrame) -> DataFrame:
    first = q.agg(F.min("stock_code").alias("m_"))
    s = q.select(*KEY).distinct().join(F.broadcast(first))
    return s.where(~((F.col("stock_code") == F.col("m_")) & F.col("date").like("%7"))).drop("m_")


@query("coverage_missing", PRESENT_SQL + f" SELECT s.stock_code, c.date, c.session FROM (SELECT DISTINCT stock_code FROM q) s, (SELECT DISTINCT date, session FROM q) c WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.stock_code = s.stock_code AND h.date = c.date AND h.session = c.session)")
def _(q):
    return catalog.coverage_missing(present(q), q, q)


@query("duplicate_sessions", f", tw AS (SELECT {KEYS} FROM (SELECT DISTINCT {KEYS} FROM q) UNION ALL SELECT {KEYS} FROM (SELECT DISTINCT {KEYS} FROM q) WHERE date LIKE '%3') SELECT {KEYS}, count(*) AS times FROM tw GROUP BY {KEYS} HAVING count(*) > 1")
def _(q):
    s = q.select(*KEY).distinct()
    return catalog.duplicate_sessions(s.unionByName(s.where(F.col("date").like("%3"))))


@query("calendar_history", f", dd AS (SELECT {KEYS}, row_number() OVER (PARTITION BY stock_code, session ORDER BY date) AS rk FROM (SELECT DISTINCT {KEYS} FROM q)) SELECT a.stock_code, a.date, a.session, b.date AS past_date FROM dd a JOIN dd b ON a.stock_code = b.stock_code AND a.session = b.session AND b.rk BETWEEN a.rk - 5 AND a.rk - 1")
def _(q):
    return catalog.calendar_history(q, 5)


@query("positional_merge", " SELECT stock_code || '/' || date AS file, row_idx, b, event_id, t_ms AS b_txt1 FROM q")
def _(q):
    f = q.withColumn("file", F.concat_ws("/", "stock_code", "date"))
    return catalog.positional_merge(f.select("file", "row_idx", "b"), f.select("file", "row_idx", F.col("t_ms").alias("b"), "event_id")).select("file", "row_idx", "b", "event_id", "b_txt1")


@query(
    "bundle_problems",
    f""", p0 AS (SELECT {KEYS}, row_idx AS place, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 89 = 0 THEN row_idx - 1 ELSE row_idx END AS end_row,
        CASE WHEN event_id % 103 <> 0 THEN t_ms END AS t, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 107 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE pred_m END AS pred FROM q),
     p AS (SELECT *, lag(end_row) OVER w AS pr, lag(t) OVER w AS pt FROM p0 WINDOW w AS (PARTITION BY {KEYS} ORDER BY place))
    SELECT DISTINCT {KEYS}, 'end_row' AS problem FROM p WHERE end_row IS NULL OR end_row < 0 UNION SELECT {KEYS}, 'order' FROM p WHERE pr >= end_row
    UNION SELECT {KEYS}, 'pred' FROM p WHERE pred IS NULL OR NOT isfinite(pred) UNION SELECT {KEYS}, 'time' FROM p WHERE t IS NULL OR pt > t""",
)
def _(q):
    i = F.col("event_id")
    p = q.select(
        *KEY, F.col("row_idx").alias("place"), F.when(i % 101 == 0, None).when(i % 89 == 0, F.col("row_idx") - 1).otherwise(F.col("row_idx")).alias("end_row"),
        F.when(i % 103 != 0, F.col("t_ms")).alias("t_ms"), F.when(i % 97 == 0, None).when(i % 107 == 0, float("inf")).otherwise(F.col("pred_m").cast("double")).alias("pred"),
    )
    return catalog.check_bundle(p, "place")


# ---------------------------------------------------------------------------------------
# Around a model


@query("fixed_standardize", f" SELECT {IDS}, round((f2 - 150.5) / 120.25, 9) + 0.0 AS f2_std FROM q")
def _(q):
    return q.select(*ID, r(model_inputs.standardise(F.col("f2"), 150.5, 120.25)).alias("f2_std"))


@query(
    "time_encoding",
    f""", el_ AS (SELECT *, (t_ms - min(t_ms) OVER (PARTITION BY {KEYS})) / 1000.0 AS s FROM q)
    SELECT {IDS}, round(sin(CAST(s AS DOUBLE) * 0.01), 6) + 0.0 AS sin0, round(sin(CAST(s AS DOUBLE) * 0.01 * exp(-ln(10000.0) / 2)), 6) + 0.0 AS sin1, round(cos(CAST(s AS DOUBLE) * 0.01), 6) + 0.0 AS cos0,
           round(cos(CAST(s AS DOUBLE) * 0.01 * exp(-ln(10000.0) / 2)), 6) + 0.0 AS cos1 FROM el_""",
)
def _(q):
    first = F.min("t_ms").over(Window.partitionBy(*KEY))
    a = q.withColumn("a", model_inputs.time_encoding((F.col("t_ms") - first) / 1000.0, 4, time_scale=0.01))
    return a.select(*ID, *[r(F.col("a")[i], 6).alias(n) for i, n in enumerate(("sin0", "sin1", "cos0", "cos1"))])


@query(
    "warmup_cosine",
    """, st_ AS (SELECT DISTINCT CAST(event_id % 120 AS BIGINT) AS step FROM q)
    SELECT step, round(CASE WHEN step < 10 THEN 0.01 * step / 10.0 ELSE 0.001 + 0.009 * 0.5 * (1 + cos(pi() * least(greatest((step - 10) / 90.0, 0.0), 1.0))) END, 9) AS rate FROM st_""",
)
def _(q):
    s = q.select((F.col("event_id") % 120).alias("step")).distinct()
    return s.select("step", r(model_inputs.warmup_cosine(F.col("step"), 0.01, 100, 10, 0.1)).alias("rate"))


AB_SQL = label_sql() + f""", ab AS (SELECT *, {SPLIT_SQL} = 'train' AS tr FROM lab WHERE r_raw IS NOT NULL),
 fa AS (SELECT 'a' AS factor_set, regr_slope(r_raw, f0) AS s, regr_intercept(r_raw, f0) AS c FROM ab WHERE tr AND f0 IS NOT NULL),
 fb AS (SELECT 'b' AS factor_set, regr_slope(r_raw, f2) AS s, regr_intercept(r_raw, f2) AS c FROM ab WHERE tr),
 xs AS (SELECT factor_set, s * f0 + c AS x, r_raw AS y FROM ab, fa WHERE NOT tr AND f0 IS NOT NULL UNION ALL SELECT factor_set, s * f2 + c, r_raw FROM ab, fb WHERE NOT tr)"""


@query("factor_set_comparison", AB_SQL + " SELECT factor_set, count(*) AS n, round(avg((x - y) * (x - y)) * 1e6, 4) AS mse_e6, round(avg(abs(x - y)), 7) AS mae, round(corr(x, y), 4) + 0.0 AS pearson FROM xs GROUP BY 1")
def _(q):
    lab = labelled(q).where("r_raw is not null")
    m = compare.compare_sets(lab, {"a": ["f0"], "b": ["f2"]}, "r_raw", clock.split_of(F.col("date"), SPLITS) == "train")
    return m.select("factor_set", "n", r(F.col("mse") * 1e6, 4).alias("mse_e6"), r("mae", 7).alias("mae"), r("pearson", 4).alias("pearson"))

# ---------------------------------------------------------------------------------------
# Packing and reports

PACK_SQL = (
    TRAIN_SQL
    + DV_SQL
    + f""", em AS (SELECT *, {ewm_sql('dv', 20)} AS e, coalesce(last_value(f0 IGNORE NULLS) OVER w, 0) AS p0, coalesce(last_value(f1 IGNORE NULLS) OVER w, 0) AS p1
      FROM dv WINDOW w AS (PARTITION BY {KEYS} ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    + ELIGIBLE_SQL
    + f""", pk AS (SELECT ok_.stock_code, ok_.date, ok_.session, ok_.row_idx, p0 / greatest(e, 1.0) AS f0, p1 AS f1, r_raw,
      CASE WHEN r_raw IS NULL THEN 0.0 ELSE least(greatest(1 + least(greatest(abs(r_raw) / q90, 0.0), 3.0), 0.5), 4.0) END AS weight, end_ok AND r_raw IS NOT NULL AS end_ok
      FROM ok_ JOIN em USING ({IDS}) JOIN lab USING ({IDS}), st)"""
)


def packed(q: DataFrame) -> DataFrame:
    lab, st = train_stats(q)
    spec = contract.FeatureContract(("f0", "f1"), volume_norm=("f0",), ema_span=20)
    return pack.pack(lab, spec, st, ROWS, SPAN, GAP)


@query("packed_rows", PACK_SQL + f" SELECT {IDS}, round(f0, 8) + 0.0 AS f0, round(CAST(f1 AS DOUBLE), 8) + 0.0 AS f1, round(weight, 7) AS weight, end_ok FROM pk")
def _(q):
    return packed(q).select(*ID, r("f0", 8).alias("f0"), r("f1", 8).alias("f1"), r("weight", 7).alias("weight"), "end_ok")


@query(
    "pack_split_counts",
    PACK_SQL
    + f""" SELECT {SPLIT_SQL} AS split, count(DISTINCT stock_code || '/' || date || '/' || session) AS n_sessions, count(*) AS n_rows, count(r_raw) AS n_valid,
      count(*) FILTER (end_ok) AS n_ends, round(sum(weight), 4) AS weight_sum FROM pk GROUP BY 1""",
)
def _(q):
    c = pack.split_counts(packed(q), clock.split_of(F.col("date"), SPLITS))
    return c.select("split", "n_sessions", "n_rows", "n_valid", "n_ends", r("weight_sum", 4).alias("weight_sum"))


@query("value_summary", label_sql() + " SELECT count(r_raw) AS n, round(avg(r_raw), 9) + 0.0 AS mean, round(stddev_pop(r_raw), 9) AS std, round(min(r_raw), 9) + 0.0 AS least, round(max(r_raw), 9) + 0.0 AS most, round(quantile_cont(r_raw, 0.01), 9) + 0.0 AS q01, round(quantile_cont(r_raw, 0.5), 9) + 0.0 AS q50, round(quantile_cont(r_raw, 0.99), 9) + 0.0 AS q99 FROM lab")
def _(q):
    s = pack.summary(labelled(q), "r_raw", {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return s.select("n", *[r(x).alias(x) for x in ("mean", "std", "least", "most", "q01", "q50", "q99")])


@query("session_join", label_sql() + f" SELECT {KEYS}, count(*) AS n_rows, count(*) FILTER (invalid_reason = 0) AS n_valid FROM lab GROUP BY ALL")
def _(q):
    index = labelled(q).groupBy(*KEY).agg(F.count_if("is_valid").alias("n_valid"))
    return pack.join_sessions(catalog.session_catalog(q).select(*KEY, "n_rows"), index).select(*KEY, "n_rows", "n_valid")


@query("first_seen", " SELECT stock_code, f2, min(event_id) AS event_id FROM q GROUP BY 1, 2")
def _(q):
    return pack.first_seen(q.select("stock_code", "f2", "event_id"), ["stock_code", "f2"], "event_id")


@query("every_nth", f" SELECT {IDS} FROM q WHERE row_idx % 3 = 0 AND row_idx // 3 < 100")
def _(q):
    return pack.every_nth(q, 3, 100).select(*ID)


@query(
    "trade_chart",
    SEG_SQL
    + f""", mk AS (SELECT {KEYS}, entry_row AS row_idx, CASE WHEN direction > 0 THEN 'long entry' ELSE 'short entry' END AS mark, entry_tk AS price_tk FROM seg
      UNION ALL SELECT {KEYS}, exit_row, CASE WHEN direction > 0 THEN 'long exit' ELSE 'short exit' END, exit_tk FROM seg)
    SELECT {IDS}, t_ms, mid2, 'mid' AS mark, NULL AS price_tk FROM q WHERE mid2 IS NOT NULL UNION ALL SELECT {IDS}, t_ms, mid2, mark, price_tk FROM mk JOIN q USING ({IDS})""",
)
def _(q):
    return pack.trade_chart(q, backtest.segments(held(q)))
