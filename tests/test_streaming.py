from pyspark.sql import functions as F

from tickloom.operators import backtest
from tickloom.streaming.positions import stream_positions

SCHEMA = "stock_code string, date string, session int, row_idx long, pred double, ok boolean"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, "d", 1, i, float((i * 37 + ord(s)) % 11 - 5) if i % 4 else None, i % 7 != 0) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in range(3):  # one file a micro-batch
        df.where(F.col("row_idx").between(20 * n, 20 * n + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_positions(stream, 3, -3).writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.stock_code, r.row_idx, r.position) for r in spark.table("held").collect())
    want = sorted((r.stock_code, r.row_idx, r.position) for r in backtest.positions(df, F.lit(3), F.lit(-3)).collect())
    assert got == want
