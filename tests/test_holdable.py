"""Runs read the bars that their cash can hold, and only those; results are those of all bars."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import simulate

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(12)]


def _panel(spark, codes, price=10.0, gain=1.0):
    rows = [(f"{c:06d}.SZ", d, *[price * gain**i] * 4, 1000.0) for c in range(codes) for i, d in enumerate(DAYS)]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")


def _run(spark, monkeypatch, panel, s):
    walked = []
    walk = simulate.walk_dates
    monkeypatch.setattr(simulate, "walk_dates", lambda rows, *a: walked.append(rows.where("ts_code <> ''").count()) or walk(rows, *a))
    scores = panel.select("ts_code", "trade_date", F.lit("f").alias("factor"), F.substring("ts_code", 1, 6).cast("double").alias("value"))
    got = simulate.events(panel, scores, ("top",), s).where("kind IN ('day', 'trade')").orderBy("trade_date", "kind", "ts_code").collect()
    return got, walked


def test_bars_that_no_lot_is_paid_for_stay_out(spark, monkeypatch):
    """400 picks of 475 each, a lot costs 1000: nothing is bought, nothing walks."""
    got, walked = _run(spark, monkeypatch, _panel(spark, 400), simulate.Settings(cash=200_000.0, select_pct=1.0, rebalance=3))
    assert walked == [0] and [r["cash"] for r in got] == [200_000.0] * len(DAYS)


def test_a_run_that_outgrows_its_bound_is_walked_again(spark, monkeypatch):
    """Prices rise by half a day (limits off): the account passes twice its cash, and each later lot is bought as if all bars were there."""
    s = simulate.Settings(cash=100_000.0, select_pct=0.4, rebalance=2, max_position=1.0, limit_pct=9.0)
    panel = _panel(spark, 20, gain=1.5)
    got, walked = _run(spark, monkeypatch, panel, s)
    assert len(walked) > 1
    monkeypatch.setattr(simulate, "WORTH", 1e9)
    whole, once = _run(spark, monkeypatch, panel, s)
    assert len(once) == 1 and got == whole and sum(r["kind"] == "trade" for r in got) > 8
