"""Metrics, weights, pattern match and text cleaning against plain Python; relational operators against pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analysis, relational
from tidemark.plans.compile import evaluate
from tidemark.sources.panel import market_panel

SF = "/root/testdata/sf0.001"
D0 = dt.date(2024, 1, 1)


def frame(spark, r, b=None):
    rows = [("a", D0 + dt.timedelta(i), float(x), float(b[i]) if b is not None else 0.0) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "k string, d date, r double, b double")


def test_metrics_vector(spark):
    r = [0.01] * 50 + [-0.02] * 20 + [0.01] * 30
    m = analysis.calc_metrics(frame(spark, r), ["k"], "d", "r", "b").first()
    assert m["max_drawdown_duration"] == 50 and m["max_drawdown"] < 0
    assert m["win_rate"] == 80.0 and m["profit_loss_ratio"] == 0.5


def test_metrics_by_hand(spark):
    rng = np.random.default_rng(2)
    b = rng.normal(0.0005, 0.01, 300)
    r = 0.8 * b + rng.normal(0.0002, 0.006, 300)
    m = analysis.calc_metrics(frame(spark, r, b), ["k"], "d", "r", "b").first()
    v = np.cumprod(1 + r)
    dd = v / np.maximum.accumulate(v) - 1
    rf, runs, run = 0.03 / 252, 0, 0
    for x in dd:
        run = run + 1 if x < 0 else 0
        runs = max(runs, run)
    annual = v[-1] ** (252 / 300) - 1
    down = (r[r < rf] - rf).std(ddof=1)
    beta = np.cov(r, b)[0, 1] / b.var(ddof=1)
    want = {
        "total_return": (v[-1] - 1) * 100, "annual_return": annual * 100, "annual_volatility": r.std(ddof=1) * 252**0.5 * 100, "sharpe_ratio": (r - rf).mean() / r.std(ddof=1) * 252**0.5, "max_drawdown": dd.min() * 100, "max_drawdown_duration": runs,
        "sortino_ratio": (r - rf).mean() / down * 252**0.5, "calmar_ratio": annual / -dd.min(), "win_rate": (r > 0).mean() * 100, "profit_loss_ratio": r[r > 0].mean() / -r[r < 0].mean(), "alpha": (r.mean() - rf - beta * (b.mean() - rf)) * 252 * 100, "beta": beta, "information_ratio": (r - b).mean() / (r - b).std(ddof=1) * 252**0.5,
    }
    for k, x in want.items():
        assert abs(m[k] - x) <= (0.0051 if k in ("total_return", "annual_return", "annual_volatility", "max_drawdown", "win_rate", "alpha") else 0.000051), k


def test_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.01, (400, 3)) * [1, 2, 3] + rng.normal(0, 0.005, (400, 1))
    rows = [(f"a{j}", D0 + dt.timedelta(i), float(x[i, j])) for i in range(400) for j in range(3)]
    names, mean, cov = analysis.moments(spark.createDataFrame(rows, "asset string, trade_date date, r double"))
    assert names == ["a0", "a1", "a2"] and np.allclose(cov, np.cov(x.T)) and np.allclose(mean, x.mean(axis=0))
    w = analysis.portfolio_weights(mean, cov, "risk_parity")
    part = w * (cov @ w)
    assert np.allclose(part, part.mean(), rtol=1e-6) and np.isclose(w.sum(), 1)
    assert np.allclose(analysis.portfolio_weights(mean, cov, "inverse"), 1 / np.diag(cov) / (1 / np.diag(cov)).sum())
    t = np.clip(np.linalg.solve(cov, mean - 0.03 / 252), 0, None)
    assert np.allclose(analysis.portfolio_weights(mean, cov, "max_sharpe"), t / t.sum())
    assert np.allclose(analysis.portfolio_weights(mean, cov, "equal"), 1 / 3)


def test_pattern_match(spark):
    rng = np.random.default_rng(1)
    curve = [1, 3, 2, 5, 4, 7, 6, 9, 8, 12]
    closes = np.concatenate([rng.normal(50, 0.1, 30), np.array(curve) * 2 + 40.0, rng.normal(50, 0.1, 20)])
    rows = [("hit", D0 + dt.timedelta(i), float(c)) for i, c in enumerate(closes)] + [("flat", D0 + dt.timedelta(i), 5.0) for i in range(60)] + [("few", D0 + dt.timedelta(i), float(i)) for i in range(6)]
    got = analysis.pattern_match(spark.createDataFrame(rows, "ts_code string, trade_date date, close double"), curve).collect()
    assert [(r["ts_code"], r["start_day"], r["end_day"]) for r in got] == [("hit", D0 + dt.timedelta(30), D0 + dt.timedelta(39))] and got[0]["score"] == 1.0


def test_texts_and_codes(spark, tmp_path):
    good = "沪深300"
    df = spark.createDataFrame([(1, good.encode().decode("latin1"), " a\t\x01b "), (2, "plain?", None), (3, None, "")], "i int, t string, w string")
    got = {r["i"]: (r["t"], r["w"]) for r in df.select("i", analysis.repair_text(F.col("t")).alias("t"), analysis.clean_text(F.col("w")).alias("w")).collect()}
    assert got == {1: (good, "a b"), 2: ("plain?", None), 3: (None, "")}
    codes = spark.createDataFrame([(1, " 600000.sh"), (2, "600000.SH "), (3, "000001.SZ"), (4, " ")], "i int, ts_code string")
    assert [(r["i"], r["ts_code"]) for r in analysis.clean_codes(codes, order="i").orderBy("i").collect()] == [(1, "600000.SH"), (3, "000001.SZ")]
    head = ",".join(f"c{i}" for i in range(13))
    lines = [head, "2024-01-02,x,x,平安(000001.XSHE),买,x,100股,10.5,1050,x,x,x,5", "2024-01-03,x,x,浦发(600000.XSHG),卖,x,-200股,8,1600,x,x,x,6.6", "2024-01-04,x,x,none,卖,x,-200,8,1600,x,x,x,6.6"]
    (tmp_path / "t.csv").write_bytes("\n".join(lines).encode("gbk"))
    got = [tuple(r) for r in analysis.broker_transactions(spark, str(tmp_path / "t.csv")).collect()]
    assert got == [("2024-01-02", "buy", "000001.SZ", 100, 10.5, 1050.0, 5.0), ("2024-01-03", "sell", "600000.SH", 200, 8.0, 1600.0, 6.6)]
    assert spark.sql("SELECT date'2024-07-01' AS d").select(analysis.warm_up_start(F.col("d"))).first()[0] == dt.date(2024, 7, 1) - dt.timedelta(540)


@pytest.fixture(scope="module")
def panel(spark):
    return market_panel(spark, SF).toPandas().sort_values(["ts_code", "trade_date"])


def rows(spark, name):
    return relational.run(spark, SF, relational.QUERIES[name]).toPandas()


def test_evaluate_groups_bounds(spark, panel):
    p = panel.copy()
    g = p.groupby("ts_code")["close"]
    p["f"], p["fwd"] = p["close"] / g.shift(4) - 1, g.shift(-4) / p["close"] - 1
    want = {}
    for d, x in p.dropna(subset=["f", "fwd"]).groupby("trade_date"):
        n = len(x)
        if n >= 5:
            x = x.sort_values(["f", "ts_code"])
            for k in range(5):
                part = x.iloc[int(k * n / 5) : int((k + 1) * n / 5)]
                if len(part):
                    want[str(d)[:10], k] = (len(part), part["fwd"].mean())
    got = {(r.trade_date, r.g): (r.names, r.ret) for r in rows(spark, "evaluate_groups").itertuples()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 1e-5 * max(1, abs(want[k][1])) for k in want)


def test_drawdown_episodes(spark, panel):
    want = {}
    for code, x in panel.groupby("ts_code"):
        peak, start, low, low_day, n = -1.0, None, 0.0, None, 0
        for d, c in zip(x["trade_date"], x["close"], strict=True):
            if c >= peak:
                if start and low <= -0.02:
                    want[code, str(start)] = (str(low_day), str(d), n)
                peak, start, low, n = c, None, 0.0, 0
            else:
                start, n = start or d, n + 1
                if c / peak - 1 < low:
                    low, low_day = c / peak - 1, d
        if start and low <= -0.02:
            want[code, str(start)] = (str(low_day), None, n)
    got = {(r.ts_code, r.start_day): (r.trough_day, r.recovery_day, r.days) for r in rows(spark, "drawdown_episodes").itertuples()}
    assert got == want and len(want) > 5


def test_quality(spark, panel):
    end, days = panel["trade_date"].max(), panel["trade_date"].nunique()
    want = set()
    for code, x in panel.groupby("ts_code"):
        miss, r = 1 - len(x) / days, x["close"].pct_change().abs()
        flat = ((x["open"] == x["high"]) & (x["high"] == x["low"]) & (x["low"] == x["close"])).sum()
        gap = int(str(end).replace("-", "")) - int(str(x["trade_date"].iloc[-1]).replace("-", ""))
        for kind, level in (("missing_dates", 2 if miss > 0.3 else miss > 0.05), ("suspension", 2 if flat >= 10 else flat >= 1), ("extreme_return", 2 if (r > 0.11).sum() >= 5 else (r > 0.11).any()), ("stale_data", 2 if gap > 100 else gap > 10)):
            if level:
                want.add((code, kind, "error" if level == 2 else "warning"))
    got = rows(spark, "quality_issues")
    assert {t for t in got[["ts_code", "kind", "severity"]].itertuples(index=False, name=None) if t[1] not in ("price_sticking", "zero_volume")} == want
    worst = {c: max(({"error": 2, "warning": 1}[s] for k, _, s in got[["ts_code", "kind", "severity"]].itertuples(index=False, name=None) if k == c), default=0) for c in panel["ts_code"].unique()}
    assert {r.ts_code: {"error": 2, "warning": 1, "clean": 0}[r.status] for r in rows(spark, "quality_status").itertuples()} == worst


def test_industry_residual(spark, panel):
    df = market_panel(spark, SF)
    got = evaluate(df, {"a": "xs_industry_residual(volume, log(total_mv))"}).toPandas().set_index(["ts_code", "trade_date"])["a"]
    for d, x in panel.groupby("trade_date"):
        if len(x) >= 6:
            dummies = pd.get_dummies(x["industry"]).to_numpy(float)
            y, m = x["volume"].to_numpy(), np.log(x["total_mv"].to_numpy())
            if np.linalg.matrix_rank(np.column_stack([m, dummies])) < dummies.shape[1] + 1:
                continue
            a = np.column_stack([m, dummies])
            want = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
            assert np.allclose([got[c, d] for c in x["ts_code"]], want, atol=1e-5)


def test_numbers_print_in_full():
    from tidemark.operators.mining import equivalence_key
    from tidemark.plans.ast import parse

    rng = random.Random(1)
    for x in [82.81907992727281, 1234567.0, 1e-7, 3.0, *[rng.random() * 10 ** rng.randint(-8, 12) for _ in range(50)]]:
        assert parse(str(parse(f"close * {x!r}"))) == parse(f"close * {x!r}")
    assert equivalence_key("close * 1.0000001") != equivalence_key("close * 1.0000002")
