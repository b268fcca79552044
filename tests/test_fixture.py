"""The published counts of the synthetic eight-session fixture, made anew from its recipe and read from CSV."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions.clock import clock_to_ms, split_of
from tickloom.operators import features, windows
from tickloom.sources import session_files
from tickloom.sources.quotes import KEY

DATES = ["20250106", "20250107", "20250108", "20250109"]
SPLITS = {"train": ("20250106", "20250107"), "val": ("20250108", "20250108"), "test": ("20250109", "20250109")}
STEPS = [0, 10, 30, 50, 100, 200, 350, 400]


def session_rows(day: int, session: int, held_out: float = 1.0):
    t = ((9 if session == 1 else 13) * 3600 + (30 if session == 1 else 0) * 60 + 59) * 1000 + 980
    amplitude = 0.035 if day < 2 else (4.0 + day) * held_out
    for r in range(384):
        if r:
            t += 6000 if r == 190 else STEPS[r % 8]
        bid = round(100 + amplitude * math.sin(r / 13) + r * 0.0005, 3)
        ask, last = bid + 0.011, bid + 0.0055
        if r == 30:
            bid, ask = ask, bid
        if r == 31 or 60 <= r <= 67:
            bid = ask = last = 0
        s, ms = divmod(t, 1000)
        yield (s // 3600) * 10_000_000 + s // 60 % 60 * 100_000 + s % 60 * 1000 + ms, bid, ask, last, "nan" if r in (0, 21) else r * 0.5


def write(root, held_out: float = 1.0):
    for day, date in enumerate(DATES):
        for session in (1, 2):
            d = root / "000000" / date
            d.mkdir(parents=True, exist_ok=True)
            lines = [f"{f},{last!r},{ask!r},{t},{bid!r}" for t, bid, ask, last, f in session_rows(day, session, held_out if day >= 2 else 1.0)]
            (d / f"000000_{date}_{session}.csv").write_text("f0,last,ask,timestamp,bid\n" + "\n".join(lines) + "\n")
    return str(root)


def labelled(spark, path):
    df = session_files.read_sessions(spark, path, ["timestamp", "bid", "ask", "last", "f0"])
    df = df.withColumn("t_ms", clock_to_ms(F.col("timestamp"))).withColumn("split", split_of(F.col("date"), SPLITS))
    good = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    df = df.withColumn("mid2", F.when(good, F.col("bid") + F.col("ask")).otherwise(F.when(F.col("last") > 0, 2 * F.col("last"))))
    return windows.future_label(df, 2500, 3500, 2)


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    return labelled(spark, write(tmp_path_factory.mktemp("raw"))).cache()


def by_split(df, *aggs):
    return {r.split: tuple(r)[1:] for r in df.groupBy("split").agg(*aggs).collect()}


def test_rows_labels_and_reasons(lab):
    got = by_split(lab, F.count("*"), F.countDistinct(*KEY), F.count_if("is_valid"))
    assert got == {"train": (1536, 4, 1284), "val": (768, 2, 642), "test": (768, 2, 642)}
    flags = lab.agg(*[F.count_if(F.col("invalid_reason").bitwiseAND(b) > 0) for b in (1, 2, 4, 8)]).first()
    assert tuple(flags) == (72, 200, 376, 0)


def test_train_quantiles_and_clipping(lab):
    st = features.label_quantiles(lab.where("split = 'train'")).first()
    want = (0.0005861708777956665, 0.0006679692887701094, 0.0006879721768200397)
    assert st.enough and all(math.isclose(a, b, rel_tol=2e-6) for a, b in zip((st.q90, st.q99, st.q100), want, strict=True))
    y, clipped = features.scale_clip(F.col("r_raw").cast("float"), 37.0, st.q99 * 37.0)
    got = by_split(lab.withColumn("c", clipped), F.count_if("c"))
    assert got == {"train": (12,), "val": (642,), "test": (642,)}


def test_windows(lab):
    e = windows.window_eligible(lab, 8, 1000, 450, weight=F.col("is_valid").cast("double"))
    got = by_split(e, F.count_if("end_ok"), F.count_if("span_bad"), F.count_if("gap_bad"))
    assert got == {"train": (472, 784, 28), "val": (236, 392, 14), "test": (236, 392, 14)}
    runs = windows.islands(e, "end_ok")
    n, longest, total = runs.agg(F.count("*"), F.max("run_len"), F.sum("run_len")).first()
    assert (n, total) == (320, 944) and longest <= 5
    assert windows.blocks(runs, 2).agg(F.sum("block_len")).first()[0] == 944
    arrays = windows.window_arrays(e, ["f0"], 8)
    assert arrays.where("size(history) <> 8 or rel_ms[0] <> 0 or rel_ms[7] > 1000").count() == 0 and arrays.count() == 944


def test_held_out_data_does_not_reach_train_statistics(spark, lab, tmp_path_factory):
    other = labelled(spark, write(tmp_path_factory.mktemp("raw2"), held_out=2.0))
    stats = lambda d: features.label_quantiles(d.where("split = 'train'")).first()
    assert stats(lab) == stats(other)
    mean = lambda d: d.where("split = 'test'").agg(F.avg("r_raw")).first()[0]
    assert mean(lab) != mean(other)


def test_discovery_and_sinks(spark, tmp_path):
    path = write(tmp_path / "raw")
    found = session_files.discover(spark, path, dates=("20250107", "20250108"), sessions=[2]).collect()
    assert [(r.stock_code, r.date, r.session) for r in found] == [("000000", "20250107", 2), ("000000", "20250108", 2)]
    with pytest.raises(ValueError, match="missing"):
        session_files.read_sessions(spark, path, ["timestamp", "volume"])
    df = session_files.read_sessions(spark, path, ["timestamp", "bid"])
    session_files.write_sessions(df, str(tmp_path / "out"))
    session_files.write_sessions(df.limit(1), str(tmp_path / "out"), mode="ignore")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3072 and session_files.missing_from(df, back.withColumn("date", F.col("date").cast("string")), ["date", "session"]).count() == 0
    (tmp_path / "side.txt").write_text("1 2.5\n3  nan\n")
    rows = session_files.read_text_columns(spark, str(tmp_path / "side.txt"), ["a", "b"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.a) for r in rows] == [(0, 1.0), (1, 3.0)]
    assert session_files.factor_columns(["g_0", "h_0", "h_1", "t"], ["g_", "h_"], 2) == ["h_0", "h_1"]
