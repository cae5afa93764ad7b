"""Simulator goldens, streaming, news, and the registered queries' contract."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from tidemark.operators import news, simulate
from tidemark.streaming import bars as stream

DAYS = [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]
FREE = {"cash": 100_000.0, "commission": 0.0, "min_commission": 0.0, "stamp_tax": 0.0, "slippage": 0.0, "volume_limit": 1.0, "max_position": 1.0, "exposure": 0.95, "select_pct": 0.2, "rebalance": 1}


def panel(spark, vol=10_000.0, opens=None, skip=None):
    rows = []
    for k in range(5):
        op = (opens or {}).get(k) or [10 + k, 10 + k, 12 + k, 13 + k]
        for i, d in enumerate(DAYS):
            if (k, i) != skip:
                rows.append((f"60000{k}.SH", d, float(op[i]), [11.5, 12.5, 13.5, 14.5][i] + k, [9.5, 9.5, 11.5, 12.5][i] + k, float([10, 11, 12, 13][i] + k), vol))
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")


def scores(spark):
    return spark.createDataFrame([("f", f"60000{k}.SH", d, 10.0 - k) for k in range(5) for d in DAYS], "factor string, ts_code string, trade_date date, value double")


def run(spark, p, **more):
    out = simulate.simulate(p, scores(spark), ("top",), simulate.Settings(**(FREE | more))).orderBy("trade_date").collect()
    return {r["trade_date"]: r for r in out}


def test_next_open_and_lots(spark):
    got = run(spark, panel(spark), rebalance=1)
    first = got[DAYS[1]]
    assert (first["buys"], first["cash"]) == (1, 5000.0)  # 9500 shares at the open of 10
    assert got[DAYS[0]]["positions"] == 0 and first["value"] == 5000.0 + 9500 * 11


def test_limit_up_is_not_bought(spark):
    got = run(spark, panel(spark, opens={0: [10, 11, 12.1, 13.2]}))
    assert got[DAYS[1]]["rejected"] >= 1 and got[DAYS[1]]["traded"] == 11.0 * (95_000 // 1100 * 100)


def test_volume_cap(spark):
    got = run(spark, panel(spark, vol=1.0))
    assert got[DAYS[1]]["traded"] == 100 * 10.0


def test_missing_quote_carries_the_last_value(spark):
    got = run(spark, panel(spark, skip=(0, 2)), rebalance=3)
    assert all(r["value"] >= 90_000 for r in got.values())


def test_grid_and_technical(spark):
    g = simulate.grid(panel(spark), scores(spark), [0.2, 0.4], [1, 2]).collect()
    assert len(g) == 4
    t = simulate.technical(panel(spark), "close - open", 0.5, -0.5).collect()
    assert len(t) == 5 and all(r["days"] == 4 for r in t)


def test_streaming_bars_equal_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    ev.repartition(2).write.parquet(f"{tmp_path}/in")
    q = stream.tick_bars(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"), "event_type", "ts", "value", order="event_id").writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    want = stream.tick_bars(ev, "event_type", "ts", "value", order="event_id")
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, want.collect()))


def test_streaming_titles(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "title string, publish_time timestamp")
    rows.write.parquet(f"{tmp_path}/news")
    q = stream.new_titles(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/news")).writeStream.format("memory").queryName("titles").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["title"] for r in spark.table("titles").collect()) == ["a", "b"]


def test_sentiment(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("good news",), ("not good",), ("bad and good bad",), ("",)], "t string")
    got = [tuple(r) for r in df.select(news.sentiment(F.col("t"), {"good": 0.6, "bad": -0.5}, ["ot"]).alias("s")).select("s.score", "s.label").collect()]
    assert got == [(0.6, "positive"), (-0.3, "negative"), (0.1, "neutral"), (0.0, "neutral")]


def test_fuzzy_titles(spark):
    df = spark.createDataFrame([("s", 1, "profits rise at the mill"), ("s", 2, "profits rise at the mills"), ("s", 3, "rain"), ("t", 4, "rain")], "src string, i int, title string")
    assert sorted(r["i"] for r in news.fuzzy_titles(df, "src", "i").collect()) == [1, 3, 4]


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


@pytest.mark.parametrize("name", ["rank_ic", "fifo_pnl", "quality_missing"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["trade_date", "names", "ic"]
