"""The language against pandas, its parser, scheduler and graph codec."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.alphas import FORMULAS
from tidemark.operators.builtin import FACTORS
from tidemark.plans import graph
from tidemark.plans.ast import ExpressionError, parse, walk
from tidemark.plans.compile import evaluate, looks_ahead, schedule
from tidemark.sources.panel import COLUMNS, normalize

DAYS = pd.date_range("2024-01-01", periods=120, freq="B")


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(3):
        close = np.round(10 + k + np.cumsum(rng.normal(0, 0.3, 120)) + np.sin(np.arange(120) / 3), 2).clip(1)
        rows.append(pd.DataFrame({"ts_code": f"60000{k}.SH", "trade_date": DAYS.date, "open": np.r_[close[0], close[:-1]], "high": close * 1.02, "low": close * 0.98, "close": close, "volume": rng.integers(1000, 9000, 120).astype(float)}))
    df = pd.concat(rows, ignore_index=True)
    df["amount"] = df["close"] * df["volume"]
    return df


@pytest.fixture(scope="module")
def panel(spark, bars):
    return spark.createDataFrame(bars).cache()


def by_stock(bars, f):
    return pd.concat([f(g.reset_index(drop=True)) for _, g in bars.groupby("ts_code")], ignore_index=True)


PANDAS = {
    "mean(close, 10)": lambda g: g.close.rolling(10).mean(),
    "std(close, 10)": lambda g: g.close.rolling(10).std(),
    "corr(close, volume, 12)": lambda g: g.close.rolling(12).corr(g.volume),
    "cov(close, volume, 12)": lambda g: g.close.rolling(12).cov(g.volume),
    "skew(close, 20)": lambda g: g.close.rolling(20).skew(),
    "kurt(close, 20)": lambda g: g.close.rolling(20).kurt(),
    "ts_pct_rank(close, 9)": lambda g: g.close.rolling(9).rank(pct=True),
    "ts_rank(close, 9)": lambda g: g.close.rolling(9).apply(lambda x: (x <= x[-1]).mean(), raw=True),
    "ts_argmax(close, 7)": lambda g: g.close.rolling(7).apply(np.argmax, raw=True),
    "lowday(close, 7)": lambda g: 6 - g.close.rolling(7).apply(np.argmin, raw=True),
    "wma(close, 5)": lambda g: g.close.rolling(5).apply(lambda x: np.dot(x, [1, 2, 3, 4, 5]) / 15, raw=True),
    "decaylinear(close, 5)": lambda g: g.close.rolling(5).apply(lambda x: np.dot(x, [5, 4, 3, 2, 1]) / 15, raw=True),
    "ts_product(close / 10, 4)": lambda g: (g.close / 10).rolling(4).apply(np.prod, raw=True),
    "ema(close, 6)": lambda g: g.close.ewm(span=6, adjust=False).mean(),
    "sma(close, 6, 1)": lambda g: g.close.ewm(alpha=1 / 6, adjust=False).mean(),
    "ewm(close, 6)": lambda g: g.close.ewm(span=6, adjust=True).mean(),
    "ic_ewm(close, 8)": lambda g: g.close.ewm(halflife=4, adjust=True).mean(),
    "rank(close)": lambda g: g.close.expanding().rank(pct=True),
    "cs_zscore(close)": lambda g: ((g.close - g.close.expanding(2).mean()) / g.close.expanding(2).std()).fillna(0),
    "regbeta(volume, close, 10)": lambda g: g.volume.rolling(10).cov(g.close) / g.volume.rolling(10).var(ddof=0),
    "drawdown_from_high(close, 15)": lambda g: g.close / g.close.rolling(15).max() - 1,
    "efficiency_ratio(close, 10)": lambda g: (g.close - g.close.shift(10)).abs() / g.close.diff().abs().rolling(10).sum(),
    "downside_std(returns, 10)": lambda g: g.close.pct_change(fill_method=None).clip(upper=0).rolling(10).std(),
    "rsi(close, 14)": lambda g: 100 - 100 / (1 + g.close.diff().clip(lower=0).rolling(14).mean() / (-g.close.diff().clip(upper=0)).rolling(14).mean().where(lambda x: x > 1e-12)),
    "winsorize(close, 0.05, 0.95)": lambda g: g.close.clip(g.close.quantile(0.05), g.close.quantile(0.95)),
}


def test_functions_equal_pandas(panel, bars):
    names = {f"x{i}": e for i, e in enumerate(PANDAS)}
    got = evaluate(panel, names).toPandas().sort_values(["ts_code", "trade_date"]).reset_index(drop=True)
    for name, e in names.items():
        want = by_stock(bars, PANDAS[e]).to_numpy(float)
        have = got[name].to_numpy(float)
        assert (np.isnan(want) == np.isnan(have)).all(), e
        assert np.allclose(want, have, rtol=1e-7, atol=1e-9, equal_nan=True), e


def test_cross_section(panel, bars):
    got = evaluate(panel, {"r": "xs_rank(floor(close))", "s": "xs_scale(close)"}).toPandas().sort_values(["ts_code", "trade_date"]).reset_index(drop=True)
    assert np.allclose(got.r, np.floor(bars.close).groupby(bars.trade_date).rank(pct=True))
    assert np.allclose(got.s, bars.close / (bars.close.groupby(bars.trade_date).transform("sum") + 1e-10))


def test_expanding_rank_sees_nothing_ahead(spark):
    rows = [("A", d.date(), c) for d, c in zip(DAYS, [1.0, 2.0, 3.0, 4.0, 0.5], strict=False)]
    got = evaluate(spark.createDataFrame(rows, "ts_code string, trade_date date, close double"), {"x": "rank(close)"}).orderBy("trade_date")
    assert [r["x"] for r in got.collect()] == [1.0, 1.0, 1.0, 1.0, 0.2]


def test_no_look_ahead(spark, bars):
    cut = sorted(set(bars.trade_date))[80]
    causal = {f"x{i}": e for i, e in enumerate(PANDAS) if not looks_ahead(e)} | {"a": FORMULAS[17], "b": FORMULAS[36]}
    whole = evaluate(spark.createDataFrame(bars), causal).where(f"trade_date <= '{cut}'").toPandas()
    part = evaluate(spark.createDataFrame(bars[bars.trade_date <= cut]), causal).toPandas()
    key = ["ts_code", "trade_date"]
    pd.testing.assert_frame_equal(whole.sort_values(key).reset_index(drop=True), part.sort_values(key).reset_index(drop=True))
    assert looks_ahead("winsorize(close)") and looks_ahead("delay(close, -1)") and not looks_ahead("delay(close, 1)")


@pytest.mark.parametrize("text", ["close +", "import os", "__import__('os')", "close.mean()", "mean(close", "lambda x: x", "foo(close)", "mean(close, volume)", "nothing", "corr(close)", "close; open"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionError):
        schedule({"x": text}, COLUMNS)


def test_precedence():
    assert str(parse("1 + 2 * 3 ** 2 ** 1 - -4 / 2")) == str(parse("(1 + (2 * (3 ** (2 ** 1)))) - ((-4) / 2)"))
    assert str(parse("ld > 0 & ld > hd ? ld : 0")) == "where(((ld > 0) & (ld > hd)), ld, 0)"
    assert str(parse("-close ** 2")) == "(-(close ** 2))"


def test_scheduler_shares_layers():
    plan = schedule({str(n): f for n, f in FORMULAS.items()}, COLUMNS)
    alone = sum(schedule({"x": f}, COLUMNS).switches() for f in FORMULAS.values())
    assert plan.switches() <= 6 < alone
    assert len(plan.names) < sum(len(set(walk(parse(f)))) for f in FORMULAS.values())


def test_plan_has_one_exchange_for_each_switch(panel):
    df = evaluate(panel, {"a": "mean(close, 5)", "b": "std(volume, 9) + corr(close, volume, 7)", "c": "ema(close, 5)"})
    assert df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_graph_round_trip():
    for f in [*FORMULAS.values(), *(e for _, e in FACTORS.values()), "close > open ? 1 : 2", "macd_hist(close, 6, 13, 5)"]:
        assert graph.to_tree(graph.from_expression(f)) == parse(f)


def test_graph_errors():
    g = graph.from_expression("mean(close, 5) + 1")
    for change in (lambda x: x["nodes"].append({"id": "z", "type": "output"}), lambda x: x["edges"].pop(), lambda x: x["edges"].append(x["edges"][0]), lambda x: x["nodes"][1].update(type="strange")):
        import copy

        bad = copy.deepcopy(g)
        change(bad)
        with pytest.raises(ExpressionError):
            graph.to_tree(bad)
    loop = {"nodes": [{"id": "a", "type": "math_neg"}, {"id": "o", "type": "output"}], "edges": [{"from": {"nodeId": "a"}, "to": {"nodeId": "a", "port": "in"}}, {"from": {"nodeId": "a"}, "to": {"nodeId": "o", "port": "in"}}]}
    with pytest.raises(ExpressionError):
        graph.to_tree(loop)


def test_normalize(spark):
    raw = spark.createDataFrame([("A", "20240102", 2.0, 10.0), ("A", "2024-01-03", math.nan, 5.0), ("A", "20240102", 1.0, 1.0)], "code string, date string, close double, vol double")
    rows = normalize(raw).orderBy("trade_date").collect()
    assert [(str(r["trade_date"]), r["close"], r["open"], r["amount"]) for r in rows] == [("2024-01-02", 2.0, 2.0, 20.0), ("2024-01-03", None, 2.0, None)]
