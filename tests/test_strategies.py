"""Strategies and the order-driven day loop; the selection simulator's segments and curves."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import simulate, strategies

N = 90
DAYS = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(200)) if d.weekday() < 5][:N]


@pytest.fixture(scope="module")
def series():
    i = np.arange(N)
    out = {}
    for k, code in enumerate(("000001.SZ", "000002.SZ", "600003.SH")):
        close = 10 + 5 * i / N + np.sin(i / (3 + k)) * (1 + k / 2)
        out[code] = {"open": np.append(close[0], close[:-1]), "high": close * 1.02, "low": close * 0.98, "close": close, "volume": 10000 + 2000 * np.sin(i / 4 + k) + 20 * i}
    return out


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [(c, DAYS[i], *[float(s[f][i]) for f in ("open", "high", "low", "close", "volume")]) for c, s in series.items() for i in range(N)]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double").cache()


def ema(x, n):
    out = [x[0]]
    for v in x[1:]:
        out.append(v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
    return np.array(out)


def by_hand(name, s, i):
    """(entry, exit) of a strategy on row i, from the series as lists."""
    c, h, lo, v = (s[f][: i + 1] for f in ("close", "high", "low", "volume"))
    if name == "ma_cross":
        if i < 20:
            return False, False
        a, b, a0, b0 = c[-5:].mean(), c[-20:].mean(), c[-6:-1].mean(), c[-21:-1].mean()
        return a > b and a0 <= b0, a < b and a0 >= b0
    if name == "momentum":
        return (False, False) if i < 20 else (c[-1] > c[-21], c[-1] < c[-21])
    if name == "mean_reversion":
        z = (c[-1] - c[-20:].mean()) / c[-20:].std(ddof=1) if i >= 19 else 0
        return z < -1, z > 0
    if name == "bollinger":
        if i < 19:
            return False, False
        return c[-1] > c[-20:].mean() + 2 * c[-20:].std(ddof=1), c[-1] < c[-20:].mean()
    if name == "macd":
        x = c[-45:]
        if len(x) < 35:
            return False, False
        dif = ema(x, 12) - ema(x, 26)
        hist = dif - ema(dif, 9)
        return hist[-1] > 0 >= hist[-2], hist[-1] < 0 <= hist[-2]
    if name == "rsi":
        d = np.diff(c[-16:])
        if len(d) < 14:
            return False, False
        up, down = np.maximum(d, 0), np.maximum(-d, 0)
        g, b = up[:14].mean(), down[:14].mean()
        for k in range(14, len(d)):
            g, b = (g * 13 + up[k]) / 14, (b * 13 + down[k]) / 14
        r = 100 if b == 0 else 100 - 100 / (1 + g / b)
        return r < 35, r > 65
    if name == "turtle":
        return (False, False) if i < 19 else (c[-1] > h[:-1][-20:].max(), c[-1] < lo[-11:-1].min())
    if name == "volume_price":
        if i < 20:
            return False, i == 19 and c[-1] < c[-20:].mean()
        m = c[-20:].mean()
        return c[-1] > m and c[-2] <= m and v[-1] > v[-20:-1].mean() * 1.2, c[-1] < m
    if i < 20:
        return False, False
    r = np.diff(c[-21:]) / c[-21:-1]
    score = 0.5 / (1 + np.exp(-20 * (c[-1] / c[-21] - 1))) + 0.2 / (1 + 20 * r.std()) + 0.3 * min(v[-5:].mean() / v[-10:-5].mean() / 1.5, 1)
    return score > 0.55, score < 0.45


@pytest.mark.parametrize("name", list(strategies.STRATEGIES))
def test_signals(panel, series, name):
    got = {(r["ts_code"], r["trade_date"]): (r["entry"], r["leave"]) for r in strategies.signals(panel, name).collect()}
    want = {(c, DAYS[i]): tuple(map(bool, by_hand(name, s, i))) for c, s in series.items() for i in range(N)}
    assert {k for k in want if want[k] != got[k]} == set()
    assert any(a for a, _ in want.values()) and any(b for _, b in want.values())


def walk_by_hand(series, sig, r):
    """The day loop over dictionaries: T+1, next open, limits, no stops."""
    cash, held, waiting, values = r.cash, {}, [], []
    for i, day in enumerate(DAYS):
        for c, want in waiting:
            s = series[c]
            prev, op = (s["close"][i - 1] if i else None), s["open"][i]
            side = 1 if want > 0 else -1
            if prev and (side > 0 and op >= round(prev * 1.1, 2) or side < 0 and op <= round(prev * 0.9, 2)):
                continue
            p = min(max(round(op + side * r.slippage, 2), s["low"][i]), s["high"][i])
            n = min(abs(want), int(s["volume"][i] * 100 * r.volume_limit)) // 100 * 100
            if side > 0:
                worth = cash + sum(x[0] * x[1] for x in held.values())
                n = min(n, int(worth * r.max_position / p) // 100 * 100)
                while n > 0 and n * p + max(n * p * r.commission, 5) > cash:
                    n -= 100
                if n > 0:
                    cash -= n * p + max(n * p * r.commission, 5)
                    held[c] = [n, p]
            elif n > 0:
                cash += n * p * (1 - r.stamp_tax) - max(n * p * r.commission, 5)
                held[c][0] -= n
                if not held[c][0]:
                    del held[c]
        for c in held:
            held[c][1] = series[c]["close"][i]
        worth = cash + sum(x[0] * x[1] for x in held.values())
        values.append(round(worth, 2))
        waiting = []
        for c in sorted(series):
            entry, leave = sig[c, day]
            if entry and c not in held:
                n = int(worth * 0.3 / series[c]["close"][i]) // 100 * 100
                if n:
                    waiting.append((c, n))
            elif leave and c in held:
                waiting.append((c, -held[c][0]))
    return values


@pytest.mark.parametrize("name", ["ma_cross", "momentum", "rsi"])
def test_day_loop(panel, series, name):
    s = strategies.signals(panel, name)
    sig = {(r["ts_code"], r["trade_date"]): (r["entry"], r["leave"]) for r in s.collect()}
    rows = strategies.run(panel, {name: s}).collect()
    got = [r["value"] for r in sorted((r for r in rows if r["kind"] == "day"), key=lambda r: r["trade_date"])]
    assert np.allclose(got, walk_by_hand(series, sig, strategies.Rules()), atol=0.02)
    assert any(r["kind"] == "trade" for r in rows)


def bars(spark, opens, closes, code="000001.SZ", vol=1e6):
    rows = [(code, DAYS[i], float(o), float(max(o, c)) * 1.01, float(min(o, c)) * 0.99, float(c), float(vol)) for i, (o, c) in enumerate(zip(opens, closes, strict=True))]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")


def fixed(panel, entry=(), leave=()):
    n = F.row_number().over(strategies.Window.partitionBy("ts_code").orderBy("trade_date")) - 1
    return panel.select("ts_code", "trade_date", n.isin(*entry).alias("entry"), n.isin(*leave, -1).alias("leave"), F.lit(None).cast("double").alias("unit"))


def test_stops_and_reasons(spark):
    free = {"commission": 0.0, "min_commission": 0.0, "stamp_tax": 0.0, "slippage": 0.0, "max_position": 1.0}
    p = bars(spark, [10, 10, 10, 9.5, 9.2, 9.2], [10, 10, 9.4, 9.3, 9.2, 9.2])
    got = [(r["trade_date"], r["kind"], r["what"], r["shares"]) for r in strategies.run(p, {"x": fixed(p, [0])}, strategies.Rules(stop_loss=0.05, **free)).where("kind <> 'day'").orderBy("trade_date").collect()]
    assert got == [(DAYS[1], "trade", "buy", 30000), (DAYS[3], "trade", "sell", 30000)]
    up = bars(spark, [10, 10, 10.6, 11.2, 11.2], [10, 10, 11.0, 11.2, 11.2])
    got = [(r["trade_date"], r["what"]) for r in strategies.run(up, {"x": fixed(up, [0])}, strategies.Rules(take_profit=0.08, **free)).where("kind = 'trade'").orderBy("trade_date").collect()]
    assert got == [(DAYS[1], "buy"), (DAYS[3], "sell")]
    jump = bars(spark, [10, 11, 11], [10, 11, 11])
    assert [r["what"] for r in strategies.run(jump, {"x": fixed(jump, [0])}, strategies.Rules(**free)).where("kind = 'cancelled'").collect()] == ["limit_up_buy_blocked"]
    fall = bars(spark, [10, 10, 9.3, 9.2, 9.2, 9.2], [10, 9.4, 9.3, 9.2, 9.2, 9.2])
    got = strategies.run(fall, {"x": fixed(fall, [0, 3, 4])}, strategies.Rules(max_drawdown=0.01, **free)).where("kind <> 'day'").orderBy("trade_date").collect()
    assert [(r["kind"], r["what"]) for r in got] == [("trade", "buy"), ("trade", "sell"), ("cancelled", "drawdown_breaker"), ("cancelled", "drawdown_breaker")]
    thin = bars(spark, [10, 10, 10], [10, 10, 10], vol=3)
    assert [r["what"] for r in strategies.run(thin, {"x": fixed(thin, [0])}, strategies.Rules(**free)).where("kind = 'cancelled'").collect()] == ["volume_too_small"]


def test_optimize_orders_by_sharpe(panel):
    rows = strategies.optimize(panel, "ma_cross", {"short": [3, 5], "long": [10, 20]}).collect()
    assert len(rows) == 4 and [r["sharpe_ratio"] for r in rows] == sorted((r["sharpe_ratio"] for r in rows), reverse=True)


# --- selection simulator: segments, curves, summary -------------------------

WARM = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9)]
FREE = simulate.Settings(cash=100_000.0, commission=0.0, min_commission=0.0, stamp_tax=0.0, slippage=0.0, volume_limit=1.0, max_position=1.0, exposure=0.95, select_pct=0.2, rebalance=2)


def test_warm_up_segment(spark):
    rows = [(f"60000{k}.SH", d, 10.0 + k, 11.0 + k, 9.0 + k, 10.0 + k, 10_000.0) for k in range(5) for d in WARM]
    p = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")
    f = [[1, 1, 1, 9, 9, 9], [2, 2, 2, 8, 8, 8], [3, 3, 3, 7, 7, 7], [4, 4, 4, 6, 6, 6], [9, 9, 9, 5, 5, 5]]
    scores = spark.createDataFrame([("f", f"60000{k}.SH", d, float(f[k][i])) for k in range(5) for i, d in enumerate(WARM)], "factor string, ts_code string, trade_date date, value double")
    segment = spark.createDataFrame([("s", d) for d in WARM[2:]], "segment string, trade_date date")
    e = simulate.events(p, scores, ("top",), FREE, segments=segment)
    assert {r["trade_date"] for r in simulate.trades(e).collect()} == {dt.date(2024, 1, 4), dt.date(2024, 1, 8)}
    assert sorted(r["trade_date"] for r in simulate.daily(e).collect()) == WARM[2:]


def test_curves_and_summary(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]
    rows = [(f"60000{k}.SH", d, [10, 10, 12, 13][i] + float(k), [11.5, 12.5, 13.5, 14.5][i] + k, [9.5, 9.5, 11.5, 12.5][i] + k, [10, 11, 12, 13][i] + float(k), 10_000.0) for k in range(5) for i, d in enumerate(days)]
    p = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")
    scores = spark.createDataFrame([("f", f"60000{k}.SH", d, 10.0 - k) for k in range(5) for d in days], "factor string, ts_code string, trade_date date, value double")
    s = simulate.Settings(**(simulate.asdict(FREE) | {"rebalance": 1}))
    bench = spark.createDataFrame([(d, v) for d, v in zip(days, (1000.0, 1010.0, 1020.0, 1030.0), strict=True)], "trade_date date, close double")
    e = simulate.events(p, scores, ("top",), s)
    first = simulate.trades(e).orderBy("trade_date").first()
    assert (first["trade_date"], first["shares"], first["action"]) == (days[1], 9500, "buy")
    curve = simulate.curves(simulate.daily(e), bench, s.cash)
    total = simulate.summary(simulate.daily(e), curve, s.cash).first()
    last = curve.orderBy(F.desc("trade_date")).first()
    assert abs(last["excess"] - total["excess_return"]) < 0.05 and total["benchmark_return"] == 3.0


def test_reasons_of_rejection(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 4)]
    rows = []
    for k, (code, name) in enumerate([("600000.SH", "A"), ("600001.SH", "*ST B"), ("688002.SH", "C"), ("600003.SH", "D"), ("600004.SH", "E"), ("600005.SH", "F")]):
        for i, d in enumerate(days):
            op = 10.0 if k or i == 0 else 11.0
            rows.append((code, name, d, op, 12.0, 9.0, 10.0, 0.0 if k == 3 else 10_000.0))
    p = spark.createDataFrame(rows, "ts_code string, name string, trade_date date, open double, high double, low double, close double, volume double")
    scores = spark.createDataFrame([("f", r[0], r[2], 1.0) for r in rows], "factor string, ts_code string, trade_date date, value double")
    got = {r["reason"]: r["n"] for r in simulate.rejections(simulate.events(p, scores, ("top",), FREE)).collect()}
    assert got == {"star_market_filtered": 1, "st_filtered": 1, "paused_or_missing_price": 1, "limit_up_buy_blocked": 1}
    s = simulate.Settings(**(simulate.asdict(FREE) | {"rebalance": 1}))
    got = {r["reason"]: r["n"] for r in simulate.rejections(simulate.events(p, scores, ("top",), s)).collect()}
    assert got["limit_up_buy_blocked"] == 2


@pytest.mark.parametrize(("cash", "want"), [(1000.0, 0), (1005.0, 100), (1010.0, 100), (20_000.0, 1900), (20_006.1, 2000), (20_005.9, 1900)])
def test_affordable(cash, want):
    assert simulate.affordable_lots(cash, 10.0, 0.0003, 5.0, 0.0, 100) == want
