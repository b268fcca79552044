"""Literal cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import clock, model_inputs, price
from tickloom.operators import backtest, baseline, book, catalog, contract, evaluate, features, pack, quantiles, windows
from tickloom.sources import session_files

K = "stock_code string, date string, session int, row_idx long"


def frame(spark, rows, schema):
    return spark.createDataFrame([("s", "d", 1, i, *r) for i, r in enumerate(rows)], f"{K}, {schema}")


def test_clock(spark):
    df = spark.createDataFrame([(93_000_250,), (960_000_000,), (93_060_000,), (-1,), (None,)], "ts long")
    assert [r[0] for r in df.select(clock.clock_to_ms(F.col("ts"))).collect()] == [34_200_250, None, None, None, None]


def test_missing_values_and_clip(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (5.0,)], "x double")
    got = df.select(price.finite_or_null(F.col("x")), price.clip(price.finite_or_null(F.col("x")), -1.0, 1.0), price.fill(F.col("x"), 0.0)).collect()
    assert [tuple(r) for r in got] == [(None, None, 0.0)] * 3 + [(5.0, 1.0, 5.0)]


def test_exponential_mean_with_gaps(spark):
    df = frame(spark, [(None,), (1.0,), (None,), (3.0,)], "x double")
    got = [r.e for r in windows.ewm(df, "x", 3, "e").orderBy("row_idx").collect()]
    assert [g for g in got[1:3]] == [1.0, 1.0] and math.isclose(got[3], (0.25 * 1 + 0.5 * 3) / 0.75)


def test_volume_and_market_value_denominators(spark):
    df = frame(spark, [(2.0, 0, 1), (2.0, 4, 1), (8.0, 12, 1)], "f double, acc_volume long, ok int")
    got = [r.v for r in features.volume_normalise(df, "f", 2, 1.0, "v").orderBy("row_idx").collect()]
    assert all(math.isclose(a, b) for a, b in zip(got, [2.0, 2 / (8 / 3), 8 / (56 / 9)], strict=True))


def test_partial_horizon(spark):
    df = frame(spark, [(0, 200), (1000, 206), (1500, None)], "t_ms long, mid2 long")
    full = windows.future_label(df, 500, 2000, 1).orderBy("row_idx").first()
    part = windows.future_label(df, 500, 2000, 1, full_horizon=False).orderBy("row_idx").first()
    assert full.invalid_reason == windows.SHORT_HORIZON and math.isclose(part.r_raw, 0.03)


def test_duplicate_times_share_bounds(spark):
    df = frame(spark, [(0, 100), (10, 100), (10, 110), (20, 120)], "t_ms long, mid2 long")
    got = [(r.lo, r.hi, r.future_count) for r in windows.future_label(df, 0, 10, 1).orderBy("row_idx").collect()]
    assert got == [(0, 2, 3), (1, 3, 3), (1, 3, 3), (3, 3, 1)]


def test_islands_break_on_missing_rows(spark):
    df = spark.createDataFrame([("s", "d", 1, i, True) for i in (10, 11, 20, 21)], f"{K}, on boolean")
    assert sorted((r.run_start, r.run_len) for r in windows.islands(df, "on").collect()) == [(10, 2), (20, 2)]


def test_positions_and_segments(spark):
    rows = [(2.0, True, 10, 11), (None, True, 10, 11), (9.0, False, 0, 0), (-2.0, True, 12, 13), (0.0, True, 14, 15)]
    df = frame(spark, rows, "pred double, ok boolean, bid_tk long, ask_tk long")
    p = backtest.positions(df, F.lit(1.0), F.lit(-1.0))
    assert [r.position for r in p.orderBy("row_idx").collect()] == [1, 1, 1, -1, -1]
    s = backtest.segments(p).orderBy("entry_row").collect()
    assert [(r.direction, r.entry_row, r.exit_row, r.entry_tk, r.exit_tk, r.terminal_ok) for r in s] == [(1, 0, 3, 11, 12, True), (-1, 3, 4, 12, 15, True)]
    bad = backtest.segments(backtest.positions(df.withColumn("ok", F.col("row_idx") < 4), F.lit(1.0), F.lit(-1.0)))
    assert [r.terminal_ok for r in bad.orderBy("entry_row").collect()] == [True, False]
    with pytest.raises(ValueError):
        backtest.require_order(("2024-01-01", "2024-02-01"), [("2024-02-01", "2024-03-01")])


def test_weighted_metrics_limits(spark):
    same = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, 1.0, 2.0)], "x double, y double, w double")
    assert evaluate.weighted_metrics(same).first().weighted_r2 == 1.0
    none = same.withColumn("w", F.lit(0.0))
    assert tuple(evaluate.weighted_metrics(none).first())[:3] == (0.0, 0.0, 0.0)
    assert evaluate.session_ic(spark.createDataFrame([("s", "d", 1, 1.0, 5.0), ("s", "d", 1, 2.0, 5.0)], "stock_code string, date string, session int, pred double, r_raw double")).first().ic == 0.0


def test_positional_merge_refuses_unequal_files(spark):
    a = spark.createDataFrame([("f", 0, 1), ("f", 1, 2)], "file string, row_idx long, x int")
    assert catalog.positional_merge(a, a).columns == ["file", "row_idx", "x", "x_txt1"]
    with pytest.raises(ValueError, match="length"):
        catalog.positional_merge(a, a.limit(1))


def test_contracts():
    c = contract.LabelContract(2500, 3500, 2, splits={"train": ("20250101", "20250110"), "val": ("20250110", "20250111")})
    assert contract.problems(c) == ["split val is out of order or overlaps"]
    assert c.fingerprint() == contract.LabelContract(2500, 3500, 2, splits=c.splits).fingerprint()
    with pytest.raises(ValueError):
        contract.require_same(c.fingerprint(), contract.LabelContract(1, 2, 1).fingerprint(), "labels")
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}'):
        with pytest.raises(ValueError):
            contract.load_json(text)


def test_schedule_and_scorer(spark):
    df = spark.createDataFrame([(0,), (2,), (10,), (100,)], "s int")
    got = [r[0] for r in df.orderBy("s").select(model_inputs.warmup_cosine(F.col("s"), 0.01, 10, 2, 0.1)).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, [0.0, 0.01, 0.001, 0.001], strict=True))
    scored = model_inputs.score_windows(spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "history array<double>"), lambda x: x.map(sum))
    assert sorted(r.pred for r in scored.collect()) == [3.0, 3.0]
    with pytest.raises(ValueError):
        model_inputs.standardise(F.col("x"), 0.0, 0.0)


def test_imbalance_runs_take_all_levels(spark):
    rows = [(20, 10, 5, 20), (10, 10, 5, 20), (10, 20, 5, 20), (20, 10, 5, 20), (10, 10, 5, 5), (30, 10, 5, 5), (10, 30, 5, 5)]
    df = frame(spark, [(b, a, *[x] * 4, *[y] * 4) for b, a, x, y in rows], ", ".join(f"{c} long" for c in ("bz0", "az0", *(f"bz{i}" for i in range(1, 5)), *(f"az{i}" for i in range(1, 5)))))
    assert [r.obi_runlen for r in book.obi_runs(df).orderBy("row_idx").collect()] == [1, 2, 3, 4, 0, 1, 1]
    assert [r.obi_flicker_cnt for r in book.obi_flicker(df, 3).orderBy("row_idx").collect()] == [0, 0, 1, 0, 0, 0, 1]


def test_audit_answers_none_beyond_the_tolerance(spark):
    ratios = lambda *x: spark.createDataFrame([(f"f{i}", r, abs(math.log(r))) for i, r in enumerate(x)], "factor string, ratio double, dispersion double")
    got = baseline.best_method(ratios(100.0, 2.0, 9.0, 9.0, 9.0), ratios(50.0, 1.0, 2.0, 2.5, 2.0), ratios(60.0, 1.0, 1.5, 9.0, 2.0), 3.0)
    assert [r.method for r in got.orderBy("factor").collect()] == ["none", "raw", "mcap_norm", "volume_norm", "volume_norm"]
    assert baseline.norm_map(got, {"q": 0.9})["groups"]["none"] == ["f0"]
    flat = spark.createDataFrame([("a", "f", 0.0), ("b", "f", 2.0)], "stock_code string, factor string, q double")
    assert baseline.scale_ratio(flat).first().ratio == 2.0 / 1e-12


def test_what_cannot_be_traded_or_aligned_fails(spark):
    df = frame(spark, [(2.0, True, 10, 11, 0), (0.0, False, 0, 0, 5)], "pred double, ok boolean, bid_tk long, ask_tk long, t_ms long")
    held = backtest.positions(df, F.lit(1.0), F.lit(-1.0))
    with pytest.raises(ValueError, match="open at the end"):
        backtest.tradable(held)
    assert backtest.tradable(held, skip=True).count() == 0
    with pytest.raises(ValueError, match="change"):
        backtest.tradable(df.withColumn("position", F.lit(0) + F.col("row_idx").cast("int") * 0 + F.when(F.col("row_idx") == 0, 1).otherwise(1)).withColumn("ok", F.lit(False)))
    labels = df.withColumn("r_raw", F.lit(0.0)).withColumn("is_valid", F.lit(True))
    good = df.select("stock_code", "date", "session", F.col("row_idx").alias("end_row"), "t_ms", "pred")
    assert evaluate.align(good, labels).count() == 2 and evaluate.on_timeline(df.drop("pred"), good.limit(1)).where("pred is null").count() == 1
    for bad in (good.withColumn("t_ms", F.col("t_ms") + 1), good.withColumn("end_row", F.col("end_row") + 9), good.unionByName(good)):
        with pytest.raises(ValueError, match="fit"):
            evaluate.align(bad, labels)


def test_missing_shares_fail(spark):
    df = frame(spark, [(1.0, 10, 11, 10, 5), (1.0, 10, 11, 10, None)], "f double, bid_tk long, ask_tk long, last_tk long, shares long")
    assert features.mcap_normalise(df, "f", "shares", strict=False).where("mcap_norm is null").count() == 1
    with pytest.raises(Exception, match="float shares"):
        features.mcap_normalise(df, "f", "shares").collect()


def test_stride_and_limit(spark):
    df = frame(spark, [(i % 5 != 0,) for i in range(25)], "v boolean")
    assert sorted(r.row_idx for r in windows.strided_sample(df, "v", 6).collect()) == [1, 4, 8, 12, 16, 19]
    got = spark.range(1).select(features.clip_limit(F.lit(0.5), 37.0), features.clip_limit(F.lit(0.5), 37.0, 3.0), features.clip_limit(F.lit(0.0), 37.0)).first()
    assert tuple(got) == (18.5, 3.0, 37e-12)


def test_feature_contract_and_identity():
    c = contract.FeatureContract(("a", "b"), volume_norm=("a",), mcap_norm=("b",), shares={"s": 5.0})
    assert c.fingerprint() != contract.FeatureContract(("a", "b"), volume_norm=("a",)).fingerprint()
    for bad in ({"volume_norm": ("a",), "mcap_norm": ("a",)}, {"volume_norm": ("x",)}, {"mcap_norm": ("b",), "shares": {"s": 0.0}}):
        with pytest.raises(ValueError):
            contract.FeatureContract(("a", "b"), **bad)
    fine = {"stock_code": "s", "model_sha256": "0" * 64, "source_sha256": "1" * 64, "source_rows": 10}
    contract.check_identity(fine, {"stock_code": "s"}, 9)
    for bad, last in (({**fine, "stock_code": "t"}, 9), ({**fine, "model_sha256": "0"}, 9), (fine, 10)):
        with pytest.raises(ValueError):
            contract.check_identity(bad, {"stock_code": "s"}, last)


def test_text_files_skip_blank_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n\n  \n3\t4\n")
    got = session_files.read_text_columns(spark, str(tmp_path), ["x", "y"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.x, r.y) for r in got] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert session_files.renumbered(df, ["b", "c"], "f", 5).columns == ["a", "f5", "f6"]
    session_files.write_json_lines(df, str(tmp_path / "j"))
    assert session_files.read_json_lines(spark, str(tmp_path / "j"), "a int, b int, c int").collect() == df.collect()
    digest = contract.file_digests(spark, [str(tmp_path / "a.txt")]).first()
    assert digest.length == 12 and len(digest.sha256) == 64


@pytest.mark.parametrize("values", [[1e-4, -2e-4, 0.0, -0.0, 5e-324, 1e300, -1e300, 3.0], [2.0], [1.0 + i * 2.0**-52 for i in range(500)], [float(i % 7 - 3) for i in range(1000)], []])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "x double")
    got = quantiles.quantiles(df, F.col("x"), {"a": 0.05, "b": 0.5, "c": 1.0}).first()
    want = []
    for q in (0.05, 0.5, 1.0) if values else ():
        low = math.floor(pos := q * (len(values) - 1))
        s = sorted(values)
        want.append(s[low] + (s[math.ceil(pos)] - s[low]) * (pos - low))
    assert got.n == len(values) and [got.a, got.b, got.c] == (want or [None] * 3)


def test_sessions_must_match_one_to_one(spark):
    one = spark.createDataFrame([("s", "d", 1), ("s", "d", 2)], "stock_code string, date string, session int")
    assert pack.join_sessions(one, one.withColumn("n", F.lit(1))).count() == 2
    with pytest.raises(ValueError, match="without labels"):
        pack.join_sessions(one, one.where("session = 1").withColumn("n", F.lit(1)))
    with pytest.raises(ValueError, match="repeat in the index"):
        pack.join_sessions(one, one.union(one).withColumn("n", F.lit(1)))


def test_preprocessing_fills_before_it_divides(spark):
    df = frame(spark, [(None, 0, 100, 100, 100), (8.0, 4, 100, 100, 100), (None, 12, None, 100, 100)], "f double, acc_volume long, bid_tk long, ask_tk long, last_tk long")
    plain = pack.preprocess(df, contract.FeatureContract(("f",)))
    assert [x.f for x in plain.orderBy("row_idx").collect()] == [0.0, 8.0, 8.0]
    by_volume = pack.preprocess(df, contract.FeatureContract(("f",), volume_norm=("f",), ema_span=2))
    assert all(math.isclose(a, b) for a, b in zip([x.f for x in by_volume.orderBy("row_idx").collect()], [0.0, 8 / (8 / 3), 8 / (56 / 9)], strict=True))
    by_value = pack.preprocess(df, contract.FeatureContract(("f",), mcap_norm=("f",), shares={"s": 1e6}))
    assert all(math.isclose(a, b) for a, b in zip([x.f for x in by_value.orderBy("row_idx").collect()], [0.0, 8e-4, 8e-4], strict=True))
    with pytest.raises(Exception, match="float shares"):
        pack.preprocess(df, contract.FeatureContract(("f",), mcap_norm=("f",), shares={"other": 1e6})).collect()


def test_configuration_names_every_fault():
    rules = {"batch": contract.Rule(int, least=1), "rate": contract.Rule(float, above=0, most=1), "mode": contract.Rule(str, among=("a", "b")), "note": contract.Rule(str, optional=True)}
    good = {"batch": 4, "rate": 0.5, "mode": "a", "train": ["2024-01-01", "2024-01-20"], "test": ["2024-01-21", "2024-01-30"], "out": {"x": "made/x", "y": "made/y"}}
    dates, places = ("train", "test"), ("out.x", "out.y")
    assert contract.config_problems(good, rules, dates, places) == []
    bad = {"batch": True, "rate": 0, "train": ["2024-01-01", "2024-02-30"], "test": ["2024-01-21", "2024-01-20"], "out": {"x": "made", "y": "made/./y"}}
    assert contract.config_problems(bad, rules, dates, places) == [
        "batch must be int", "rate must be above 0", "mode is missing", "train must be two dates", "test ends before it starts", "out.y shares a place with out.x",
    ]
    overlap = {**good, "test": ["2024-01-20", "2024-01-30"]}
    assert contract.config_problems(overlap, rules, dates) == ["test starts before the one before it ends"]
    read = contract.checked('{"batch": 1, "rate": 1, "mode": "b", "out": {"x": "../made"}}', "/base/dir", rules, paths=("out.x",))
    assert read["out"]["x"] == "/base/made"
    with pytest.raises(ValueError, match="batch must be 1 or more; rate"):
        contract.checked('{"batch": 0, "rate": 2, "mode": "b"}', "/", rules)
