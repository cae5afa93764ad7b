"""Scans, catalogues and news against small expected tables."""

import datetime as dt

import pytest

from tidemark.operators import catalog


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, code="A"):
    return spark.createDataFrame([(code, day(i), c, c, c, c) for i, c in enumerate(closes)], "ts_code string, trade_date date, open double, high double, low double, close double")


def test_adjusted(spark):
    b = bars(spark, [10.0, 10.0, 10.0, 10.0])
    f = spark.createDataFrame([("A", day(1), 2.0), ("A", day(3), 4.0)], "ts_code string, trade_date date, adj_factor double")
    assert [r["close"] for r in catalog.adjusted(b, f, "qfq").orderBy("trade_date").collect()] == [5.0, 5.0, 5.0, 10.0]
    assert [r["close"] for r in catalog.adjusted(b, f, "hfq").orderBy("trade_date").collect()] == [20.0, 20.0, 20.0, 40.0]
    assert catalog.adjusted(b, f) is b
    with pytest.raises(ValueError):
        catalog.adjusted(b, f, "xfq")


def test_checked(spark):
    got = catalog.checked(bars(spark, [10.0, 0.0, 12.0, 15.0])).orderBy("trade_date").collect()
    assert [(r["close"], r["suspicious"]) for r in got] == [(10.0, False), (12.0, False), (15.0, True)]


def test_aligned_takes_the_first_value_before_it(spark):
    dates = bars(spark, [1.0] * 4)
    bench = spark.createDataFrame([(day(1), 7.0), (day(2), 8.0)], "trade_date date, level double")
    assert [r["level"] for r in catalog.aligned(bench, dates, "level").orderBy("trade_date").collect()] == [7.0, 7.0, 8.0, 8.0]


def test_rolling_pairs_without_motion(spark):
    rows = [(n, day(i), 0.01 * i if n == "x" else 0.02 * i if n == "y" else 0.5) for n in "xyz" for i in range(5)]
    got = {(r["x"], r["y"], r["trade_date"]): r["corr"] for r in catalog.rolling_pairs(spark.createDataFrame(rows, "name string, trade_date date, r double"), "name", 4).collect()}
    assert len(got) == 6
    assert got["x", "y", day(4)] == pytest.approx(1.0) and got["x", "z", day(4)] == 0.0


def test_union_unnamed_and_quota(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    b = spark.createDataFrame([("b", 3), ("c", 4)], "name string, v int")
    assert {tuple(r) for r in catalog.union_unnamed(a, b, "name").collect()} == {("a", 1), ("b", 2), ("c", 4)}
    c = spark.createDataFrame([("k", f"n{i}", float(i % 2)) for i in range(5)], "key string, name string, score double")
    assert [r["name"] for r in catalog.quota(c, "key", "score", "name").orderBy("name").collect()] == ["n0", "n1", "n3"]


def test_news(spark):
    texts = [("芯片股大涨，订单增长", "", ["科技"], "medium"), ("突发：银行板块跌停", None, ["银行"], "high"), ("并未上涨", "", [], "medium"), ("", None, [], "low"), (None, "黄金", ["有色金属"], "low")]
    df = spark.createDataFrame([(t, s) for t, s, _, _ in texts], "title string, summary string")
    got = {(r["title"], r["summary"]): r for r in catalog.analyzed(df).collect()}
    for t, s, sectors, level in texts:
        r = got[t, s]
        assert r["sectors"] == sectors
        if level != "medium":
            assert r["impact"] == level
    assert got["芯片股大涨，订单增长", ""]["score"] == 1.0 and got["芯片股大涨，订单增长", ""]["impact"] == "high"
    assert got["并未上涨", ""]["score"] == -0.25 and got["并未上涨", ""]["label"] == "negative" and got["并未上涨", ""]["impact"] == "medium"


def test_filters(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "t", f"Name {i}", None if i == 3 else "About GOLD", "c") for i in range(6)], "publish_time int, source string, name string, description string, category string")
    assert [r["publish_time"] for r in catalog.filtered(df, source="s", since=2).collect()] == [5, 3]
    assert catalog.catalog(df, "gold", "c").count() == 5 and catalog.catalog(df, None, "d").count() == 0 and catalog.catalog(df).count() == 6
    assert [r["publish_time"] for r in catalog.search(df, ["name", "description"], "name 3", "publish_time").collect()] == [3]
    stored = spark.createDataFrame([("Name 1",)], "name string")
    twice = df.unionByName(df)
    assert sorted(r["publish_time"] for r in catalog.unseen(twice, stored, "name", "publish_time").collect()) == [0, 2, 3, 4, 5]
