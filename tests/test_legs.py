"""Strategies walk columns: one step a date, orders beyond cash are turned down together, and legs give what one walk gives."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import strategies, walk

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(10)]
MARKET = strategies.Rules(max_drawdown=0.2, stop_loss=0.05, take_profit=0.1, transfer_fee=0.0001)


def _day(codes, price, entry):
    n = len(codes)
    same = pa.array([price] * n, pa.float64())
    return pa.table({"ts_code": codes, "open": same, "high": same, "low": same, "close": same, "vol": pa.array([1e6] * n), "unit": pa.nulls(n, pa.float64()), "entry": [entry] * n, "leave": [False] * n, "no_buy": pa.nulls(n, pa.string()), "no_sell": pa.nulls(n, pa.string())})


def test_orders_beyond_cash_are_turned_down_together(monkeypatch):
    tried = []
    fill = strategies.Desk.fill
    monkeypatch.setattr(strategies.Desk, "fill", lambda self, *a: tried.append(a) or fill(self, *a))
    desk = strategies.Desk(strategies.Rules())
    codes = [f"{i:06d}.SZ" for i in range(20_000)]
    desk.day(DAYS[0], _day(codes, 10.0, True))
    cancelled, events = desk.day(DAYS[1], _day(codes, 10.0, True))
    bought = [c for k, c in zip(events["kind"], events["ts_code"], strict=True) if k == "trade"]
    assert bought == codes[: len(bought)] and 4 <= len(bought) <= len(tried) < 20
    turned = [w for w in cancelled["what"].to_pylist()] + [w for k, w in zip(events["kind"], events["what"], strict=True) if k == "cancelled"]
    assert set(turned) == {"insufficient_cash"} and len(turned) + len(bought) == len(codes)


@pytest.mark.parametrize(("rules", "cash"), [(strategies.Rules(), 1e6), (MARKET, 1e6), (MARKET, 30_000.0)])
def test_the_look_ahead_changes_nothing(rules, cash, monkeypatch):
    """Against the same walk with every order tried by itself."""
    rules = strategies.Rules(**(strategies.asdict(rules) | {"cash": cash}))
    rng = random.Random(3)
    codes = [f"{i:06d}.{'SH' if i % 3 else 'SZ'}" for i in range(700)]
    days = []
    for _ in range(12):
        own = sorted(rng.sample(codes, 600))
        t = {c: [rng.choice([9.995, 10.005, 7.5, 12.345, 700.0]) * rng.uniform(0.9, 1.1) for _ in own] for c in ("open", "close")}
        t["high"], t["low"] = ([f(a, b) for a, b in zip(t["open"], t["close"], strict=True)] for f in (max, min))
        t |= {"ts_code": own, "vol": [rng.choice([0.0, 2.0, 50.0, 1e4]) for _ in own], "unit": pa.array([rng.choice([None, 0.0, 0.01]) for _ in own], pa.float64()), "entry": [rng.random() < 0.5 for _ in own], "leave": [rng.random() < 0.5 for _ in own]}
        t |= {k: pa.array([rng.choice([None, None, None, w, "paused_or_missing_price"]) for _ in own], pa.string()) for k, w in (("no_buy", "limit_up_buy_blocked"), ("no_sell", "limit_down_sell_blocked"))}
        days.append(pa.table(t))

    def walked():
        desk, out = strategies.Desk(rules), []
        for d, t in zip(DAYS, days, strict=False):
            rows = [r for part in desk.day(d, t) for r in zip(*[c.to_pylist() if isinstance(c, pa.Array) else list(c) for c in (part.get(n) if part.get(n) is not None else [None] * len(part["kind"]) for n in ("kind", "ts_code", "what", "wanted", "shares", "price", "value", "cash"))], strict=True)]
            out.append(sorted(rows, key=lambda r: (str(r[1]), str(r[2]), str(r[3]))))
        return out

    got = walked()
    monkeypatch.setattr(strategies._Book, "_short", lambda self, k, worth: (k < 0, k < 0))
    assert got == walked() and {"position_limit", "insufficient_cash"} & {r[2] for day in got for r in day}


def test_legs(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"{c:06d}.SZ", d, *[10 + rng.random()] * 4, 1000.0) for c in range(8) for d in DAYS]
    panel = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")
    sig = panel.select("ts_code", "trade_date", (F.col("close") < 10.5).alias("entry"), (F.col("close") > 10.6).alias("leave"), F.lit(None).cast("double").alias("unit"))
    whole = sorted(map(str, strategies.run(panel, {"a": sig, "b": sig.where("ts_code > '000003.SZ'")}).collect()))
    monkeypatch.setattr(strategies, "LEG", 24)
    assert walk.legs_of([(1, 8), (2, 8), (3, 9), (4, 30), (5, 1)], 24) == [(1, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(map(str, strategies.run(panel, {"a": sig, "b": sig.where("ts_code > '000003.SZ'")}).collect())) == whole
    assert any("'trade'" in r for r in whole)


@pytest.mark.parametrize("rules", [strategies.Rules(), MARKET])
def test_orders_are_filled_at_once(rules, monkeypatch):
    """Against the same walk with every order tried by itself; with cash for all few are."""
    rules = strategies.Rules(**(strategies.asdict(rules) | {"cash": 1e9}))
    rng = random.Random(4)
    codes = [f"{i:06d}.{'SH' if i % 3 else 'SZ'}" for i in range(600)]
    days = []
    for _ in range(10):
        own = sorted(rng.sample(codes, 560))
        t = {c: [rng.choice([9.995, 10.005, 7.5, 12.345, 11.11] * 30 + [float("nan")]) * rng.uniform(0.9, 1.1) for _ in own] for c in ("open", "close")}
        t["high"], t["low"] = ([f(a, b) for a, b in zip(t["open"], t["close"], strict=True)] for f in (max, min))
        t["close"] = [10.0 if c != c else c for c in t["close"]]
        t |= {"ts_code": own, "vol": [rng.choice([0.0, 2.0, 50.0, 300.0]) for _ in own], "unit": [1e-6] * len(own), "entry": [rng.random() < 0.5 for _ in own], "leave": [rng.random() < 0.5 for _ in own]}
        t["open"] = [10.0 if x != x and rng.random() < 0.9 else x for x in t["open"]]
        t |= {k: pa.array([rng.choice([None, None, None, w]) for _ in own], pa.string()) for k, w in (("no_buy", "limit_up_buy_blocked"), ("no_sell", "limit_down_sell_blocked"))}
        days.append(pa.table(t))
    tried, fill = [], strategies.Desk.fill
    monkeypatch.setattr(strategies.Desk, "fill", lambda self, *a: tried.append(a) or fill(self, *a))

    def walked():
        desk, out = strategies.Desk(rules), []
        for d, t in zip(DAYS, days, strict=False):
            cancelled, events = desk.day(d, t)
            turned = list(zip(cancelled["ts_code"].to_pylist(), cancelled["what"].to_pylist(), cancelled["wanted"].tolist(), strict=True)) + [r[1:4] for r in zip(*events.values(), strict=True) if r[0] == "cancelled"]
            out.append((sorted(turned), repr([r for r in zip(*events.values(), strict=True) if r[0] != "cancelled"]), repr(desk.held), desk.cash, desk.about))
        return out

    got, few = walked(), len(tried)
    monkeypatch.setattr(strategies, "FEW", 10**9)
    monkeypatch.setattr(strategies._Stretch, "fill", lambda self, a, b, events: 0)
    assert got == walked()
    trades = sum(day[1].count("'trade'") for day in got)
    assert trades > 500 and few < 0.75 * (len(tried) - few)
