"""A run's account over columns trades as one that takes order by order, and adds up what it holds a few times a date."""

import random

import pyarrow as pa
import pytest

from tidemark.operators import simulate
from tidemark.operators.simulate import Settings, affordable_lots, broker_fee, fill_price, weight, whole_lots

SCHEMA = pa.schema([("ts_code", pa.string()), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "vol")], ("no_sell", pa.string()), ("nth", pa.int32()), ("active", pa.bool_()), ("targets", pa.int32())])


class Plain:
    """Order by order, with dictionaries."""

    def __init__(self, s):
        self.s, self.cash, self.shares, self.opens, self.closes = s, s.cash, {}, {}, {}

    def worth(self, opening):
        return self.cash + sum(n * ((self.opens.get(c) if opening else None) or self.closes.get(c, 0.0)) for c, n in self.shares.items())

    def trade(self, code, bar, wanted):
        s, side = self.s, 1 if wanted > 0 else -1
        blocked = "paused_or_missing_price" if bar is None else None if side > 0 else bar["no_sell"]
        if blocked:
            return ("reject", code, blocked)
        p, held = fill_price(bar["open"], bar["low"], bar["high"], side, s.slippage), self.shares.get(code, 0)
        transfer = s.transfer_fee if ".SH" in code else 0.0
        limits = {"below_lot_or_volume_cap": min(abs(wanted) if side > 0 else min(-wanted, held), bar["vol"] * 100 * s.volume_limit)}
        if side > 0:
            if s.max_position > 0:
                limits["max_position_pct"] = (self.worth(True) * s.max_position - held * bar["open"]) / max(p, 1e-12)
            limits["insufficient_cash"] = affordable_lots(self.cash, p, s.commission, s.min_commission, transfer, s.lot)
        for reason, most in limits.items():
            if whole_lots(most, s.lot) <= 0:
                return ("reject", code, reason)
        n = whole_lots(min(limits.values()), s.lot)
        amount = n * p
        fees = (broker_fee(amount, s.commission, s.min_commission), amount * s.stamp_tax if side < 0 else 0.0, amount * transfer)
        self.cash -= side * amount + sum(fees)
        self.shares[code] = held + side * n
        if not self.shares[code]:
            del self.shares[code]
        return ("trade", code, "buy" if side > 0 else "sell", round(p, 4), n, amount, *fees)

    def day(self, bars, targets, of):
        s, events = self.s, []
        self.opens.update({c: b["open"] for c, b in bars.items()})
        if targets is not None:
            events += [self.trade(c, bars.get(c), -n) for c, n in list(self.shares.items()) if c not in targets]
            each = self.worth(True) * weight(s, of)
            for c in targets:
                goal = whole_lots(int(each / max(round(bars[c]["open"] + s.slippage, 2), 1e-12)), s.lot)
                if goal != self.shares.get(c, 0):
                    events.append(self.trade(c, bars[c], goal - self.shares.get(c, 0)))
        self.closes.update({c: b["close"] for c, b in bars.items()})
        return [*events, ("day", sum(e[5] for e in events if e[0] == "trade"), self.worth(False), self.cash, len(self.shares))]


def _dates(rng, codes, dates, picked):
    for d in range(dates):
        bars = {}
        for c in codes:
            if rng.random() < 0.85:
                o, x = round(rng.uniform(5, 20), 4), round(rng.uniform(5, 20), 4)
                bars[c] = {"open": o, "close": x, "low": min(o, x), "high": max(o, x), "vol": rng.uniform(5, 60), "no_sell": "limit_down_sell_blocked" if rng.random() < 0.1 else None}
        targets = rng.sample(sorted(bars), min(picked, len(bars))) if d % 3 == 0 else None
        yield d, bars, targets


def _table(bars, targets, of):
    rows = [{"ts_code": "", "active": targets is not None, "targets": of}]
    rows += [{"ts_code": c, **bars[c], "nth": targets.index(c) + 1 if targets and c in targets else None} for c in sorted(bars)]
    return pa.Table.from_pylist(rows, SCHEMA)


def _told(parts):
    for part in parts:
        part = {k: v.to_pylist() if isinstance(v, pa.Array) else list(v) for k, v in part.items()}
        for row in (dict(zip(part, v, strict=True)) for v in zip(*part.values(), strict=True)):
            if row["kind"] == "day":
                yield ("day", row["amount"], row["value"], row["cash"], row["positions"])
            elif row["kind"] == "reject":
                yield ("reject", row["ts_code"], row["what"])
            else:
                yield ("trade", *[row[c] for c in ("ts_code", "what", "price", "shares", "amount", "commission", "stamp_tax", "transfer_fee")])


@pytest.mark.parametrize("more", [{}, {"max_position": 0.03, "exposure": 1.0}, {"transfer_fee": 1e-5, "slippage": 0.01}, {"exposure": 1.0, "volume_limit": 9.0, "cash": 30_000.0}])
def test_equal_to_order_by_order(more):
    rng, s = random.Random(3), Settings(**({"cash": 300_000.0} | more))
    codes = [f"{k:06d}.{'SH' if k % 2 else 'SZ'}" for k in range(60)]
    plain, account, kinds = Plain(s), simulate.Account(s), set()
    for d, bars, targets in _dates(rng, codes, 60, 25):
        if d == 31:  # under way in another leg
            account = simulate.pickle.loads(account.state())
        want = plain.day(bars, targets, 25)
        assert sorted(_told(account.day(d, _table(bars, targets, 25))), key=str) == sorted(want, key=str)
        kinds |= {e[2] for e in want if e[0] != "day"}
    assert {"buy", "sell", "paused_or_missing_price"} <= kinds


def test_worth_is_not_added_up_for_each_order(monkeypatch):
    """1500 of 3000 securities are bought on each date that rebalances: three sums a date, where each purchase made one."""
    rng, s, sums = random.Random(5), Settings(cash=1e8), []
    worth = simulate.Account.worth
    monkeypatch.setattr(simulate.Account, "worth", lambda self, *a: sums.append(1) or worth(self, *a))
    account, trades = simulate.Account(s), 0
    for d, bars, targets in _dates(rng, [f"{k:06d}.SZ" for k in range(3000)], 7, 1500):
        trades += sum(e[0] == "trade" for e in _told(account.day(d, _table(bars, targets, 1500))))
    assert trades > 2000 and len(sums) <= 3 * 7


def test_a_run_is_walked_twice_at_most(spark, monkeypatch):
    """Prices double from bar to bar: the account passes any multiple of its bound, and is walked over all bars then."""
    import datetime as dt

    from pyspark.sql import functions as F

    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(12)]
    rows = [(f"{c:06d}.SZ", d, *[10.0 * 2**i] * 4, 1e6) for c in range(10) for i, d in enumerate(days)]
    panel = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume double")
    scores = panel.select("ts_code", "trade_date", F.lit("f").alias("factor"), F.substring("ts_code", 1, 6).cast("double").alias("value"))
    walked, walk = [], simulate.walk_dates
    monkeypatch.setattr(simulate, "walk_dates", lambda rows, *a: walked.append(1) or walk(rows, *a))
    s = Settings(cash=100_000.0, select_pct=0.5, rebalance=1, max_position=1.0, limit_pct=9.0)
    last = simulate.daily(simulate.events(panel, scores, ("top",), s)).orderBy("trade_date").collect()[-1]
    assert len(walked) == 2 and last["value"] > 30 * s.cash
