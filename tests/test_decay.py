"""Half-life of rank correlations and robustness over folds against pandas."""

import datetime as dt

import numpy as np
import pandas as pd

from tidemark.operators import decay
from tidemark.plans.compile import evaluate
from tidemark.sources.panel import market_panel

SF = "/root/testdata/sf0.001"
FACTORS = {"momentum": "pctchange(close, 4)", "size": "volume"}


def test_open_returns_by_dates_of_the_panel(spark):
    day = lambda i: dt.date(2020, 1, 6) + dt.timedelta(7 * i)
    rows = [("A", day(i), float(10 + i)) for i in range(6)] + [("B", day(i), float(i)) for i in (0, 2, 3, 5)] + [("C", day(i), 0.0 if i == 1 else 5.0) for i in range(4)]
    got = decay.open_returns(spark.createDataFrame(rows, "ts_code string, trade_date date, open double"), (1, 3)).collect()
    found = {(r["ts_code"], r["trade_date"]): (r["r1"], r["r3"]) for r in got}
    assert found["A", day(0)] == (12 / 11 - 1, 14 / 11 - 1) and found["A", day(2)] == (14 / 13 - 1, None) and found["A", day(5)] == (None, None)
    # B has no bar on date 1, nor on date 4: no entry, no exit
    assert found["B", day(0)] == (None, None) and found["B", day(2)] == (None, None) and found["B", day(3)] == (None, None)
    assert found["C", day(0)] == (None, None) and found["C", day(1)] == (0.0, None)


def test_half_lives_against_pandas(spark):
    panel = market_panel(spark, SF)
    rows = panel.select("ts_code", "trade_date", "open").toPandas().merge(evaluate(panel, FACTORS).toPandas()[["ts_code", "trade_date", *FACTORS]], on=["ts_code", "trade_date"])
    opens = rows.pivot(index="trade_date", columns="ts_code", values="open").sort_index()
    opens = opens.where(opens > 0)
    got = {(r["factor"], r["horizon"]): r for r in decay.half_lives(decay.horizon_ics(panel, FACTORS), list(FACTORS)).collect()}
    assert len(got) == 10
    for f in FACTORS:
        values = rows.pivot(index="trade_date", columns="ts_code", values=f).sort_index()
        want = {}
        for h in decay.HORIZONS:
            r = opens.shift(-1 - h) / opens.shift(-1) - 1
            ics = []
            for d in opens.index:
                both = pd.DataFrame({"v": values.loc[d], "r": r.loc[d]}).dropna()
                if len(both) >= 5:
                    ics.append(both["v"].rank().corr(both["r"].rank()))
            ics = [x for x in ics if not np.isnan(x)]
            want[h] = abs(np.mean(ics)) if ics else 0.0
            assert got[f, h]["dates"] == len(ics) and abs(got[f, h]["ic"] - want[h]) < 1e-5
        peak = max(want.values())
        low = [h for h in decay.HORIZONS if want[h] <= peak / 2]
        assert {got[f, h]["best_horizon"] for h in decay.HORIZONS} == {max(want, key=want.get)}
        assert {got[f, h]["half_life"] for h in decay.HORIZONS} == {low[0] if low and peak else 20}


def test_no_date_with_enough_names(spark):
    few = spark.createDataFrame([("A", dt.date(2020, 1, 6), 1.0, 2.0, 3.0)], "ts_code string, trade_date date, open double, close double, volume double")
    got = decay.half_lives(decay.horizon_ics(few, {"size": "volume"}), ["size"]).collect()
    assert len(got) == 5 and {(r["dates"], r["ic"], r["half_life"]) for r in got} == {(0, 0.0, 20)}


def test_robustness_of_planted_folds(spark):
    def fold(name, valid, test):
        return [(name, k, part, ic, s) for k, (v, t) in enumerate(zip(valid, test, strict=True)) for part, (ic, s) in (("valid", v), ("test", t))]

    rows = fold("steady", [(0.04, 0.02)] * 3, [(0.04, 0.02), (0.03, 0.02), (0.05, 0.02)]) + fold("lost", [(0.05, 0.02)] * 2, [(-0.02, -0.01), (None, None)]) + fold("none", [(None, None)], [(0.01, 0.01)])
    got = {r["factor"]: r for r in decay.robustness(spark.createDataFrame(rows, "factor string, fold int, part string, ic_mean double, spread double")).collect()}
    a, b, c = got["steady"], got["lost"], got["none"]
    assert (a["folds"], a["pass_ratio"], a["median_ic"], a["worst_ic"]) == (3, 1.0, 0.04, 0.03) and abs(a["ic_decay"]) < 1e-9 and abs(a["robustness_score"] - (45 + 24 + 9)) < 1e-6
    assert (b["folds"], b["pass_ratio"], b["worst_ic"], b["spread_decay"], b["robustness_score"]) == (2, 0.0, -0.02, 1.0, 0.0) and abs(b["ic_decay"] - 0.6) < 1e-9
    assert (c["ic_decay"], c["spread_decay"]) == (1.0, 1.0) and abs(c["robustness_score"] - (45 + 6 + 3 - 30)) < 1e-6
