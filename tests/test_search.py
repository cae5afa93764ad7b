"""Screens, likeness of curves, rankings, replies, tags, registered factors and result logs against small expected tables."""

import datetime as dt
import math

from tidemark.operators import search, upkeep
from tidemark.sources import tables

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(30)]


def test_screened(spark):
    rows = [("few", 2, 90.0, 0.1, 1.0, 1.0), ("gaps", 20, 44.0, 0.1, 1.0, 1.0), ("flat", 20, 90.0, 0.001, 1.0, 0.01), ("weak", 20, 90.0, 0.002, 0.05, 5.0), ("good", 20, 90.0, 0.05, 0.5, 5.0), ("none", None, None, None, None, None)]
    got = search.screened(spark.createDataFrame(rows, "factor string, valid_dates long, coverage double, valid_ic double, valid_ir double, spread double"))
    assert {r["factor"]: r["fast_reject"] for r in got.collect()} == {
        "few": "valid_ic_count_below_3", "gaps": "coverage_below_45pct", "flat": "validation_signal_near_zero", "weak": "ic_and_icir_both_too_low", "good": None, "none": "valid_ic_count_below_3"}


def test_homogeneous(spark):
    shapes = {"a": lambda i: i, "b": lambda i: -2.0 * i, "c": lambda i: i + 6 * math.sin(i), "d": lambda i: i + 6 * math.sin(i), "e": lambda i: (-1.0) ** i, "f": lambda i: (i * 7) % 5, "g": lambda i: (i * 11) % 13}
    curves = spark.createDataFrame([(n, d, float(f(i))) for n, f in shapes.items() for i, d in enumerate(DAYS)], "name string, trade_date date, value double")
    cand = spark.createDataFrame([(n, k, "s" if n in "aefg" else n, "fam" if n in "ac" else None, None, s) for k, (n, s) in enumerate([("a", 1.0), ("b", 2.0), ("c", 1.0), ("d", 9.0), ("e", 0.0), ("f", 0.0), ("g", 0.0)])],
                                 "name string, place int, structure string, family string, theme string, score double")
    got = {r["name"]: r["reason"] for r in search.homogeneous(curves, cand).collect()}
    pairs = {(r["earlier"], r["later"]): r["corr"] for r in search.curve_pairs(curves, cand).collect()}
    assert pairs[("a", "b")] > 0.999 and pairs[("c", "d")] > 0.999
    assert got["b"] == "near_duplicate_equity_curve" and got["g"] == "same_structure_quota_reached"
    assert got["c"] is None if pairs.get(("a", "c"), 0.0) < 0.96 else got["c"] == "same_family_high_curve_correlation"
    assert got["a"] is got["e"] is got["f"] is None


def test_short_curves_are_not_compared(spark):
    curves = spark.createDataFrame([(n, d, float(i)) for n in "ab" for i, d in enumerate(DAYS[:19])], "name string, trade_date date, value double")
    assert search.curve_pairs(curves, spark.createDataFrame([("a", 0), ("b", 1)], "name string, place int")).count() == 0


def test_theme_scores(spark):
    rows = [("x", 1.0, 10.0, "p"), ("y", 0.5, -50.0, "q"), (None, -9.0, None, "r"), ("x", 0.1, None, "s")]
    got = {r["theme"]: r["weight"] for r in search.theme_scores(spark.createDataFrame(rows, "theme string, score double, excess double, name string")).collect()}
    want = {"x": 1.2 + 0.1 / math.sqrt(3), "y": 0.4 / math.sqrt(2), "general_formula": 0.02 / 2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_reply_factors(spark):
    texts = ['ok [{"name": "a", "expression": "close"}, {"name": "b"}] bye', "no list", None, "] [", "[not json]", '[{"expression": "x [1]"}] ']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", search.reply_factors(search.F.col("t")).alias("f")).orderBy("i").collect()
    assert [[x["expression"] for x in r["f"]] for r in got] == [["close"], [], [], [], [], ["x [1]"]]


def test_with_parameters_and_tags(spark):
    df = spark.createDataFrame([("N = 1 # n\nLIMIT=2\nN = 3\n", "rank(delta(close, 1))"), (None, "1 + 1")], "code string, formula string")
    got = df.select(search.with_parameters(search.F.col("code"), {"N": 7, "LIMIT": "a"}).alias("code"), search.tags(search.F.col("formula")).alias("tags")).collect()
    assert got[0]["code"] == "N = 7# n\nLIMIT='a'\nN = 3\n" and got[1]["code"] is None
    assert got[0]["tags"] == ["横截面排序", "动量反转", "K线结构"] and got[1]["tags"] == ["复合信号"]


def test_registered_factor(spark):
    @search.factor("twice", "test")
    def twice(times: int = 2) -> str:
        return f"close * {times}"

    df = spark.createDataFrame([("A", DAYS[0], 3.0)], "ts_code string, trade_date date, close double")
    assert search.compute(df, "twice").first()["twice"] == 6.0 and search.compute(df, "twice", times=5).first()["twice"] == 15.0
    del search.FACTORS["twice"]


def test_segments_and_fills(spark):
    bar = "ts_code string, trade_date date, close double"
    bars = spark.createDataFrame([("A", DAYS[0], 1.0), ("A", DAYS[0], 1.0), ("A", DAYS[3], 1.0), ("Z", DAYS[1], 1.0)], bar)
    cal = spark.createDataFrame([(d,) for d in DAYS[:5]], "trade_date date")
    codes = spark.createDataFrame([("A",), ("B",)], "ts_code string")
    got = sorted((r["ts_code"], r["first_day"], r["last_day"], r["days"]) for r in tables.missing_segments(bars, cal, codes).collect())
    assert got == [("A", DAYS[1], DAYS[2], 2), ("A", DAYS[4], DAYS[4], 1), ("B", DAYS[0], DAYS[4], 5)]
    assert tables.missing_segments(bars.where("false"), cal.where("false"), codes).count() == 0
    source = spark.createDataFrame([("A", DAYS[0], 9.0), ("A", DAYS[1], 9.0)], bar)
    assert sorted(r["close"] for r in tables.fill_gaps(bars.distinct(), source, ["ts_code", "trade_date"]).collect()) == [1.0, 1.0, 1.0, 9.0]
    asked = spark.createDataFrame([("A", DAYS[0], DAYS[2]), ("A", DAYS[0], DAYS[0])], "ts_code string, start date, end date")
    assert tables.scan_ranges(bars.distinct(), asked).count() == 1


def test_marks_log_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    pinned = tables.marked(df, df.where("k = 2"), ["k"], "pinned")
    again = tables.marked(pinned, df.where("k = 3"), ["k"], "pinned")
    assert [r["pinned"] for r in again.orderBy("k").collect()] == [False, True, True]
    path = str(tmp_path / "log")
    tables.append_results(df, path, "k")
    tables.append_results(df.where("k > 1"), path, "k")
    log = spark.read.parquet(path)
    assert [(r["id"], r["k"]) for r in tables.results_after(log, 2).collect()] == [(3, 3), (4, 2), (5, 3)]
    tables.export_sections({"rows": df, "none": df.where("false")}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "rows")).count() == 3


def test_with_fees(spark):
    df = spark.createDataFrame([(1, 1000.0, True), (2, 100_000.0, False)], "k int, a double, s boolean")
    got = {(r["k"], r["preset"]): (r["commission"], r["stamp_tax"]) for r in upkeep.with_fees(df, upkeep.F.col("a"), upkeep.F.col("s")).collect()}
    assert got[(1, "散户")] == (5.0, 1.0) and got[(1, "ETF")] == (0.1, 0.0) and abs(got[(2, "机构")][0] - 8.0) < 1e-9 and got[(2, "散户")][1] == 0.0
