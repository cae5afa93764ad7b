"""Relational operators against brute force over all securities and dates."""

import pandas as pd

from tidemark.operators import relational
from tidemark.sources.panel import market_panel

SF = "/root/testdata/sf0.01"


def test_corr_matrix_has_every_pair(spark):
    rows = market_panel(spark, SF).select("ts_code", "trade_date", "close").toPandas().sort_values(["ts_code", "trade_date"])
    rows["r"] = rows["close"] / rows.groupby("ts_code")["close"].shift(1) - 1
    wide = rows.pivot(index="trade_date", columns="ts_code", values="r")
    c, known = wide.corr(min_periods=20), wide.notna().astype(int)
    days = known.T @ known
    want = {(x, y): (days.at[x, y], c.at[x, y]) for x in wide for y in wide if x < y and days.at[x, y] >= 20}
    got = {(r["x"], r["y"]): (r["days"], r["c"]) for r in relational.run(spark, SF, relational.QUERIES["corr_matrix"]).collect()}
    assert len(want) == 4950 and got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and (pd.isna(v) and got[k][1] is None or abs(got[k][1] - v) < 1e-6)


def test_walk_forward_folds_are_all_that_fit(spark):
    import datetime as dt

    for n in (199, 200, 249, 357, 460):
        days = [dt.date(2015, 1, 5) + dt.timedelta(weeks=i) for i in range(n)]
        panel = spark.createDataFrame([("A", d) for d in days], "ts_code string, trade_date date")
        want = set()
        for k in range(n):
            if k * 50 + 200 <= n:
                for part, a, b in (("train", 0, 145), ("test", 150, 200)):
                    want.add((k, part, b - a, str(days[k * 50 + a]), str(days[k * 50 + b - 1])))
        text = relational.QUERIES["walk_forward_folds"].replace("FROM panel", "FROM {panel}")
        assert {tuple(r) for r in spark.sql(text, panel=panel).collect()} == want


def test_trough_of_equal_depths_is_the_first_day(spark, monkeypatch):
    import datetime as dt

    closes = [10.0, 8.0, 9.0, 8.0, 8.0, 9.0, 10.0]
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), c) for i, c in enumerate(closes)]
    panel = spark.createDataFrame(rows, "ts_code string, trade_date date, close double").coalesce(1)
    monkeypatch.setattr(relational, "market_panel", lambda *a: panel)
    got = relational.run(spark, SF, relational.QUERIES["drawdown_episodes"]).collect()
    assert [(r["trough_day"], r["recovery_day"]) for r in got] == [("2024-01-02", "2024-01-07")]
