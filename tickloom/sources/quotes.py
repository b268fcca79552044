"""Quote sessions seen in the driver's ``events`` table: integer ticks of 1e-4, five book levels.

A session is (stock_code, date, session); its rows keep their own order in ``row_idx``. All
prices are whole ticks, so sums are exact on any engine and in any order. Some rows lack the best bid
or ask, and some have an empty book; ``turnover`` is the traded amount in ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS
from ..functions.price import executable, label_mid2

KEY = ("stock_code", "date", "session")
LEVELS = 5


def by_row(*extra: str):
    return Window.partitionBy(*KEY).orderBy("row_idx", *extra)


def by_time():
    return Window.partitionBy(*KEY).orderBy("t_ms")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, tick = F.col("event_id"), 1_000_000 + F.round(F.col("value") * 100).cast("long")
    q = e.select(
        i,
        F.col("event_type").alias("stock_code"),
        F.col("ts").cast("date").cast("string").alias("date"),
        F.lit(1).alias("session"),
        (F.unix_millis(F.col("ts").cast("timestamp")) % DAY_MS).cast("long").alias("t_ms"),
        tick.alias("b"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )
    hole, crossed = i % 31 == 0, i % 29 == 0
    q = q.withColumns(
        {
            "bid_tk": F.when(hole, 0).when(crossed, F.col("b") + 110).otherwise(F.col("b")),
            "ask_tk": F.when(hole, 0).when(crossed, F.col("b")).otherwise(F.col("b") + 110),
            "last_tk": F.when(i % 62 == 0, 0).otherwise(F.col("b") + 55),
            "pred_m": (i * 37) % 1001 - 500,
            "volume": (F.col("k") % 5) * 100,
            **{f"bid{n}": F.when(i % 37 != 0 if n == 0 else F.lit(True), F.col("b") - 100 * n) for n in range(LEVELS)},
            **{f"ask{n}": F.when(i % 41 != 0 if n == 0 else F.lit(True), F.col("b") + 110 + 100 * n) for n in range(LEVELS)},
            **{f"bz{n}": F.when(i % 43 == 0, 0).otherwise(100 + (i * 7 + n * 13) % 50) for n in range(LEVELS)},
            **{f"az{n}": F.when(i % 43 == 0, 0).otherwise(100 + (i * 11 + n * 17) % 50) for n in range(LEVELS)},
        }
    )
    q = q.withColumn("turnover", F.col("volume") * (F.col("b") + 40 + i % 31))
    order = Window.partitionBy(*KEY).orderBy("t_ms", "event_id")
    q = q.withColumn("row_idx", (F.row_number().over(order) - 1).cast("long"))
    q = q.withColumn("acc_volume", F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return q.withColumns(
        {
            "mid2": label_mid2(F.col("bid_tk"), F.col("ask_tk"), F.col("last_tk")),
            "ok": executable(F.col("bid_tk"), F.col("ask_tk")),
            "f0": F.when(i % 17 != 0, F.round(F.col("value") * 100).cast("long")),
            "f1": F.when(i % 23 != 0, F.col("k").cast("long")),
            "f2": F.col("volume").cast("long"),
        }
    )


#: The same view as SQL text, for oracle queries: WITH q AS (...).
QUOTES_SQL = """
e0 AS (
  SELECT event_id, event_type AS stock_code, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 1 AS session,
         CAST((epoch_us(ts) // 1000) % 86400000 AS BIGINT) AS t_ms, 1000000 + CAST(round(value * 100) AS BIGINT) AS b,
         CAST(json_extract_string(props, '$.k') AS INT) AS k, value
  FROM events
), e1 AS (
  SELECT *, CASE WHEN event_id % 31 = 0 THEN 0 WHEN event_id % 29 = 0 THEN b + 110 ELSE b END AS bid_tk,
         CASE WHEN event_id % 31 = 0 THEN 0 WHEN event_id % 29 = 0 THEN b ELSE b + 110 END AS ask_tk,
         CASE WHEN event_id % 62 = 0 THEN 0 ELSE b + 55 END AS last_tk,
         (event_id * 37) % 1001 - 500 AS pred_m, (k % 5) * 100 AS volume, (k % 5) * 100 * (b + 40 + event_id % 31) AS turnover,
""" + ",\n".join(
    f"         CASE WHEN {'event_id % 37 <> 0' if n == 0 else 'true'} THEN b - {100 * n} END AS bid{n}, CASE WHEN {'event_id % 41 <> 0' if n == 0 else 'true'} THEN b + {110 + 100 * n} END AS ask{n}, "
    f"CASE WHEN event_id % 43 = 0 THEN 0 ELSE 100 + (event_id * 7 + {13 * n}) % 50 END AS bz{n}, CASE WHEN event_id % 43 = 0 THEN 0 ELSE 100 + (event_id * 11 + {17 * n}) % 50 END AS az{n}"
    for n in range(LEVELS)
) + """
  FROM e0
), q AS (
  SELECT *, row_number() OVER o - 1 AS row_idx, sum(volume) OVER o AS acc_volume,
         CASE WHEN bid_tk > 0 AND ask_tk > 0 AND ask_tk >= bid_tk THEN bid_tk + ask_tk WHEN last_tk > 0 THEN 2 * last_tk END AS mid2,
         (bid_tk > 0 AND ask_tk > 0 AND ask_tk >= bid_tk) AS ok,
         CASE WHEN event_id % 17 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS f0,
         CASE WHEN event_id % 23 <> 0 THEN CAST(k AS BIGINT) END AS f1, CAST(volume AS BIGINT) AS f2
  FROM e1 WINDOW o AS (PARTITION BY stock_code, date, session ORDER BY t_ms, event_id)
)"""
