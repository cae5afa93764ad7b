"""Order-driven strategies: signals are columns, orders walk over dates.

A strategy is two conditions and a size per security and date, declared as SQL over
windows. What they do to an account (orders that wait for the next open, sales from
the day after a purchase on, stops, a drawdown breaker, reasons for cancelled orders) is walked
by date, one run per strategy and parameter set; securities come in from their first entry signal on. A date is a step over columns:
only trades, which cash bounds, are made one by one, and all orders between two of them are turned down at once.
A strategy of one's own is any DataFrame with the columns of ``signals``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import asdict, dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.panel import market_panel
from . import simulate
from .walk import legs_of, walk_dates

_W = "PARTITION BY ts_code ORDER BY trade_date"


def _frame(n: int, end: int = 0) -> str:
    return f"OVER ({_W} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def _macd(a: str, fast: int, slow: int, signal: int) -> str:
    """Last two bars (now, before) of an array's histogram: recursive means from its first element on, in one pass that keeps no arrays."""
    mean = lambda n, x, s: f"{x} * {2.0 / (n + 1)!r}D + {s} * {1 - 2.0 / (n + 1)!r}D"
    first = f"named_struct('f', element_at({a}, 1), 's', element_at({a}, 1), 'e', element_at({a}, 1) - element_at({a}, 1), 'now', 0D, 'before', 0D)"
    means = f"named_struct('f', {mean(fast, 'v', 's.f')}, 's', {mean(slow, 'v', 's.s')}, 'e', s.e, 'now', s.now)"
    signals = f"named_struct('f', m.f, 's', m.s, 'e', {mean(signal, '(m.f - m.s)', 'm.e')}, 'now', 0D, 'before', m.now)"
    last = "named_struct('f', m.f, 's', m.s, 'e', m.e, 'now', (m.f - m.s) - m.e, 'before', m.before)"
    # each step names what the one before has made
    step = f"transform(array(transform(array({means}), m -> {signals})[0]), m -> {last})[0]"
    return f"aggregate(slice({a}, 2, size({a}) - 1), {first}, (s, v) -> {step})"


def _wilder(a: str, n: int) -> str:
    """Mean of the first n, then smoothed over the rest."""
    first = f"aggregate(slice({a}, 1, {n}), 0D, (s, v) -> s + v) / {n}"
    return f"aggregate(slice({a}, {n + 1}, size({a}) - {n}), {first}, (s, v) -> (s * {n - 1} + v) / {n})"


#: Strategies: columns step by step, then entry, exit and size. A size of null is a share of the
#: account's worth; else it is a number of shares for each unit of worth. {x} are parameters.
STRATEGIES: dict[str, dict] = {
    "ma_cross": {
        "params": {"short": 5, "long": 20},
        "steps": [lambda p: {"s": f"avg(close) {_frame(p['short'])}", "l": f"avg(close) {_frame(p['long'])}", "n": f"count(close) {_frame(p['long'])}"}, lambda p: {"s0": f"lag(s) OVER ({_W})", "l0": f"lag(l) OVER ({_W})"}],
        "entry": lambda p: f"n = {p['long']} AND s > l AND s0 <= l0", "exit": lambda p: f"n = {p['long']} AND s < l AND s0 >= l0",
    },
    "momentum": {
        "params": {"lookback": 20},
        "steps": [lambda p: {"m": f"close / lag(close, {p['lookback']}) OVER ({_W}) - 1"}],
        "entry": lambda p: "m > 0", "exit": lambda p: "m < 0",
    },
    "mean_reversion": {
        "params": {"period": 20, "low": -1.0},
        "steps": [lambda p: {"z": f"(close - avg(close) {_frame(p['period'])}) / nullif(stddev_samp(close) {_frame(p['period'])}, 0D)", "n": f"count(close) {_frame(p['period'])}"}],
        "entry": lambda p: f"n = {p['period']} AND z < {p['low']}D", "exit": lambda p: f"n = {p['period']} AND z > 0",
    },
    "bollinger": {
        "params": {"period": 20, "width": 2.0},
        "steps": [lambda p: {"m": f"avg(close) {_frame(p['period'])}", "sd": f"stddev_samp(close) {_frame(p['period'])}", "n": f"count(close) {_frame(p['period'])}"}],
        "entry": lambda p: f"n = {p['period']} AND close > m + {p['width']}D * sd", "exit": lambda p: f"n = {p['period']} AND close < m",
    },
    "macd": {
        "params": {"fast": 12, "slow": 26, "signal": 9},
        "steps": [
            lambda p: {"a": f"collect_list(close) {_frame(p['slow'] + p['signal'] + 10)}"},
            lambda p: {"h": f"CASE WHEN size(a) >= {p['slow'] + p['signal']} THEN {_macd('a', p['fast'], p['slow'], p['signal'])} END"},
        ],
        "entry": lambda p: "h.now > 0 AND h.before <= 0", "exit": lambda p: "h.now < 0 AND h.before >= 0",
    },
    "rsi": {
        "params": {"period": 14, "low": 35.0, "high": 65.0},
        "steps": [
            lambda p: {"c": f"collect_list(close) {_frame(p['period'] + 2)}"},
            lambda p: {"d": "zip_with(slice(c, 2, size(c) - 1), slice(c, 1, size(c) - 1), (x, y) -> x - y)"},
            lambda p: {"up": f"CASE WHEN size(d) >= {p['period']} THEN {_wilder('transform(d, x -> greatest(x, 0D))', p['period'])} END", "down": f"CASE WHEN size(d) >= {p['period']} THEN {_wilder('transform(d, x -> greatest(-x, 0D))', p['period'])} END"},
            lambda p: {"rsi": "CASE WHEN down = 0 THEN 100D ELSE 100D - 100D / (1 + up / down) END"},
        ],
        "entry": lambda p: f"rsi < {p['low']}D", "exit": lambda p: f"rsi > {p['high']}D",
    },
    "turtle": {
        "params": {"entry": 20, "exit": 10, "atr": 14},
        "steps": [
            lambda p: {"hi": f"max(high) {_frame(p['entry'], 1)}", "lo": f"min(low) {_frame(p['exit'], 1)}", "n": f"count(close) {_frame(max(p['entry'], p['atr'] + 1))}", "c0": f"lag(close) OVER ({_W})"},
            lambda p: {"tr": "greatest(high - low, abs(high - c0), abs(low - c0))"},
            lambda p: {"atr": f"avg(tr) {_frame(p['atr'])}"},
        ],
        "entry": lambda p: f"n >= {max(p['entry'], p['atr'] + 1)} AND close > hi", "exit": lambda p: f"n >= {max(p['entry'], p['atr'] + 1)} AND close < lo",
        "unit": lambda p: "CASE WHEN atr > 0 THEN 0.02D / atr ELSE 0D END",
    },
    "volume_price": {
        "params": {"period": 20, "ratio": 1.2},
        "steps": [lambda p: {"m": f"avg(close) {_frame(p['period'])}", "v": f"avg(volume) {_frame(p['period'] - 1, 1)}", "n": f"count(close) {_frame(p['period'])}", "c0": f"lag(close) OVER ({_W})"}],
        "entry": lambda p: f"n = {p['period']} AND close > m AND c0 <= m AND v > 0 AND volume > v * {p['ratio']}D", "exit": lambda p: f"n = {p['period']} AND close < m",
    },
    "multi_factor": {
        "params": {"lookback": 20, "buy": 0.55, "sell": 0.45},
        "steps": [
            lambda p: {"r": f"close / lag(close) OVER ({_W}) - 1", "m": f"close / lag(close, {p['lookback']}) OVER ({_W}) - 1", "v5": f"avg(volume) {_frame(5)}", "v10": f"avg(volume) {_frame(5, 5)}"},
            lambda p: {"sd": f"stddev_pop(r) {_frame(p['lookback'])}"},
            lambda p: {"score": "0.5D / (1 + exp(-20 * m)) + 0.2D / (1 + 20 * sd) + 0.3D * least(CASE WHEN v10 > 0 THEN v5 / v10 ELSE 1D END / 1.5D, 1D)"},
        ],
        "entry": lambda p: f"score > {p['buy']}D", "exit": lambda p: f"score < {p['sell']}D",
    },
}
#: Fixed value: the share of the account's worth that an entry without a size of its own is for.
ENTRY_SHARE = 0.3


#: What a walk reads of a bar.
QUOTE = ("open", "high", "low", "close", "vol", "no_buy", "no_sell")
#: Fixed value: rows of a run that a task sorts at once.
LEG = 3_000_000


def quoted(panel: DataFrame) -> DataFrame:
    """A panel of quotes: signals over it keep them, so that a run joins nothing."""
    return simulate.quotes(panel).withColumn("volume", F.col("vol"))


def signals(panel: DataFrame, strategy: str, **params) -> DataFrame:
    """(ts_code, trade_date, entry, leave, unit, and the quotes of a ``quoted`` panel) of a strategy, declared over the panel's windows; parameters
    that are not given keep their defaults."""
    spec = STRATEGIES[strategy]
    p = spec["params"] | params
    if set(p) != set(spec["params"]):
        raise ValueError(f"{strategy} has the parameters {sorted(spec['params'])}")
    df = panel
    for step in spec["steps"]:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in step(p).items()])
    unit = spec["unit"](p) if "unit" in spec else "CAST(NULL AS DOUBLE)"
    quote = QUOTE if set(QUOTE) <= set(panel.columns) else ()
    return df.selectExpr("ts_code", "trade_date", f"coalesce({spec['entry'](p)}, false) AS entry", f"coalesce({spec['exit'](p)}, false) AS leave", f"{unit} AS unit", *quote)


@dataclass(frozen=True)
class Rules:
    """The broker and account rules by default."""

    cash: float = 1_000_000.0
    commission: float = 0.0003
    min_commission: float = 5.0
    stamp_tax: float = 0.001
    transfer_fee: float = 0.0
    slippage: float = 0.002
    volume_limit: float = 0.25
    max_position: float = 0.25
    max_drawdown: float = 0.0  # none
    stop_loss: float = 0.0  # none
    take_profit: float = 0.0  # none
    lot: int = 100


#: What brokers charge.
BROKERS = {
    "retail": {"commission": 0.0003, "min_commission": 5.0, "slippage": 0.002},
    "discount": {"commission": 0.00015, "min_commission": 5.0, "slippage": 0.001},
    "institution": {"commission": 0.00008, "min_commission": 0.0, "slippage": 0.0005},
    "etf": {"commission": 0.00005, "min_commission": 0.1, "slippage": 0.0003, "stamp_tax": 0.0},
}

KEYS = ["strategy"]
SCHEMA = "strategy string, trade_date date, kind string, ts_code string, what string, wanted long, shares long, price double, commission double, tax double, value double, cash double"


#: Why an order is turned down, by number; 0 is not known yet.
REASONS = ("", "no_data_on_date", "star_market_filtered", "st_filtered", "drawdown_breaker", "limit_up_buy_blocked", "limit_down_sell_blocked", "volume_too_small", "position_limit", "insufficient_cash")
#: Fixed value: orders that are looked at first for one that can be filled.
LOOK = 256
#: Fixed value: fewer orders than these are not worth being filled at once.
FEW = 16
#: What rounding may move a limit by, as a share of it.
SLACK = 1e-6


class Desk:
    """One run: an account, its waiting orders, and the rules of the day."""

    def __init__(self, r: Rules):
        self.r, self.cash, self.peak, self.shut = r, r.cash, r.cash, False
        self.about = r.cash  # worth but for rounding: all that is held is added up only where that may matter
        self.held: dict[str, dict] = {}  # shares, sellable, cost, last price
        self.buys, self.wanted = pa.array([], pa.string()), np.zeros(0, np.int64)  # by code
        self.sales: list[tuple[int, str, int]] = []  # how many of the purchases come before it, code, shares

    def state(self) -> bytes:
        return pickle.dumps(self)

    def worth(self) -> float:
        return self.cash + sum([p["shares"] * p["last"] for p in self.held.values()])

    def day(self, day: object, rows: pa.Table) -> list[dict]:
        """Settles, checks stops and the breaker, fills the waiting orders at the open, values at the close
        and takes the day's signals as orders for the next."""
        r = self.r
        rows = rows.filter(pc.not_equal(rows["ts_code"], ""))
        code = rows["ts_code"].combine_chunks()
        places = lambda names: pc.index_in(pa.array(names, code.type), code)
        bars = {c: rows[c].to_numpy() for c in ("open", "high", "low", "close", "vol", "unit", "entry", "leave")}
        bars |= {c: pc.fill_null(pc.index_in(rows[c], pa.array(REASONS)), 0).to_numpy() for c in ("no_buy", "no_sell")}
        sales = [(c, n) for _, c, n in self.sales]
        before = [k for k, _, _ in self.sales]
        for p in self.held.values():
            p["sellable"] = p["shares"]
        for c, p in self.held.items() if r.stop_loss > 0 or r.take_profit > 0 else ():
            gain = p["last"] / p["cost"] - 1 if p["cost"] > 0 else 0.0
            if r.stop_loss > 0 and gain <= -r.stop_loss or r.take_profit > 0 and gain >= r.take_profit:
                sales.append((c, -p["sellable"]))
        if r.max_drawdown > 0:
            now = self.worth()
            self.peak = max(self.peak, now)
            if not self.shut and (self.peak - now) / self.peak >= r.max_drawdown:
                self.shut = True
                sales += [(c, -p["sellable"]) for c, p in self.held.items()]
        before += [len(self.buys)] * (len(sales) - len(before))
        sold = pc.fill_null(places([c for c, _ in sales]), -1).to_numpy()
        bought = pc.fill_null(pc.index_in(self.buys.cast(code.type), code), -1).to_numpy()
        book = _Book(self, bought, bars)
        stretch = _Stretch(self, book, sales, before, sold, bars)
        at, events, total, look, slow = 0, [], len(sales) + len(self.buys), LOOK, FEW
        while at < total:
            done = stretch.fill(at, min(at + look, total), events)
            at += done
            if done == look:
                look *= 2
                continue
            # what cash or a limit decides is tried by itself, with the more orders after it the more there is of it
            look, slow = LOOK, FEW if done else 4 * slow
            end = min(at + slow, total)
            for k in [*stretch.sales_in(at, end), None]:
                a, b = stretch.purchases(at, end if k is None else stretch.place[k])
                events += book.fill(a, b)
                if k is not None:
                    events.append(self.fill(*sales[k], _bar(bars, sold[k])))
                    at = stretch.place[k] + 1
            at = end
        no = np.flatnonzero(book.why)
        out = [{"kind": pa.repeat("cancelled", len(no)), "ts_code": self.buys.take(pa.array(no)), "what": pa.array(REASONS).take(pa.array(book.why[no])), "wanted": self.wanted[no]}]
        row = pc.fill_null(places(list(self.held)), -1).to_numpy()
        for p, i, last in zip(self.held.values(), row.tolist(), (bars["close"][row] if len(code) else row).tolist(), strict=True):
            if i >= 0:
                p["last"] = last
        self.about = worth = self.worth()
        own = np.sort(row[row >= 0])
        entry = bars["entry"].astype(bool)
        entry[own] = False
        found = np.flatnonzero(entry)
        with np.errstate(all="ignore"):
            unit, close = bars["unit"][found], bars["close"][found]
            shares = np.where(np.isnan(unit), worth * ENTRY_SHARE / close, worth * unit)
            lots = np.where(shares > 0, np.floor_divide(shares, r.lot), 0) * r.lot
        lots = np.where(np.isnan(unit), lots, np.maximum(lots, r.lot))
        ok = np.isfinite(lots) & (lots > 0)
        found, self.wanted = found[ok], lots[ok].astype(np.int64)
        self.buys = code.take(pa.array(found))
        left = own[bars["leave"][own].astype(bool)]
        self.sales = [(k, c, -self.held[c]["shares"]) for k, c in zip(np.searchsorted(found, left).tolist(), code.take(pa.array(left)).to_pylist(), strict=True)]
        events.append(("day", None, None, None, None, None, None, None, round(worth, 2), round(self.cash, 2)))
        names = ("kind", "ts_code", "what", "wanted", "shares", "price", "commission", "tax", "value", "cash")
        none = (None,) * len(names)
        out.append({n: list(v) for n, v in zip(names, zip(*[e + none[len(e) :] for e in events], strict=True), strict=True)})
        return out

    def fill(self, code: str, wanted: int, bar) -> tuple:
        """A trade at the open, as much of it as all limits allow, or a cancelled order with its reason."""
        r, buy = self.r, wanted > 0
        own = self.held.get(code)

        def no(reason: str) -> tuple:
            return ("cancelled", code, reason, wanted)

        if bar is None:
            return no("no_data_on_date")
        shut = bar.no_buy if buy else bar.no_sell
        if shut in ("star_market_filtered", "st_filtered"):
            return no(shut)
        if buy and self.shut:
            return no("drawdown_breaker")
        if shut in ("limit_up_buy_blocked", "limit_down_sell_blocked"):
            return no(shut)
        if not buy and (own is None or own["sellable"] <= 0):
            return no("nothing_to_sell")
        price = simulate.fill_price(bar.open, bar.low, bar.high, 1 if buy else -1, r.slippage)
        transfer = r.transfer_fee if ".SH" in code.upper() else 0.0
        volume = bar.vol * 100 * r.volume_limit
        limits = {"volume_too_small": min(abs(wanted), int(volume) if volume >= 1 else abs(wanted), own["sellable"] if not buy else abs(wanted))}
        if buy:
            cash = simulate.affordable_lots(self.cash, price, r.commission, r.min_commission, transfer, r.lot)
            room = lambda worth: (worth * r.max_position - (own["shares"] * own["last"] if own else 0.0)) / max(price, 1e-12)
            if r.max_position > 0 and not room(self.about * (1 - SLACK)) > max(r.lot, min(cash, *limits.values())):
                limits["position_limit"] = room(self.worth())
            limits["insufficient_cash"] = cash
        for reason, most in limits.items():
            if simulate.whole_lots(most, r.lot) <= 0:
                return no(reason)
        n = simulate.whole_lots(min(limits.values()), r.lot)
        amount = n * price
        commission = max(amount * r.commission, r.min_commission)
        tax = amount * transfer + (0.0 if buy else amount * r.stamp_tax)
        self.cash -= (amount if buy else -amount) + commission + tax
        self.about -= commission + tax
        if buy:
            before = own or {"shares": 0, "sellable": 0, "cost": 0.0, "last": price}
            self.about += before["shares"] * (price - before["last"])
            before["cost"] = (before["cost"] * before["shares"] + amount) / (before["shares"] + n)
            before["shares"] += n
            before["last"] = price
            self.held[code] = before
        else:
            self.about += n * (price - own["last"])
            own["shares"] -= n
            own["sellable"] -= n
            if not own["shares"]:
                del self.held[code]
        return ("trade", code, "buy" if buy else "sell", wanted, n, round(price, 4), round(commission, 2), round(tax, 2))


def _bar(bars: dict[str, np.ndarray], i: int | None) -> SimpleNamespace | None:
    if i is None or i < 0:
        return None
    return SimpleNamespace(**{c: float(bars[c][i]) for c in ("open", "high", "low", "close", "vol")}, **{c: REASONS[bars[c][i]] for c in ("no_buy", "no_sell")})


class _Book:
    """A date's purchases in order. ``why``: reasons of those that were turned down without a look at each."""

    def __init__(self, desk: Desk, at: np.ndarray, bars: dict[str, np.ndarray]):
        r, n = desk.r, len(at)
        self.desk, self.at, self.bars, self.why = desk, at, bars, np.zeros(n, np.int8)
        there = at >= 0
        b = {c: np.full(n, np.nan) for c in ("open", "high", "low", "vol")}
        for c in b:
            b[c][there] = bars[c][at[there]]
        shut = np.zeros(n, np.int8)
        shut[there] = bars["no_buy"][at[there]]
        # a price's bounds: what rounding to cents may do to it; a price that is not known is looked at
        raw = np.maximum(b["open"] + r.slippage, 0.0)
        self.low, self.high = raw - 0.006, raw + 0.006
        inside = (b["high"] > 0) & (b["low"] > 0)
        for side in (self.low, self.high):
            side[inside] = np.maximum(b["low"], np.minimum(b["high"], side))[inside]
        self.odd = ~(np.isfinite(self.low) & (self.low > 0))
        volume = b["vol"] * 100 * r.volume_limit
        self._set(~there, "no_data_on_date")
        for reason in ("star_market_filtered", "st_filtered"):
            self._set(shut == REASONS.index(reason), reason)
        if desk.shut:
            self._set(there, "drawdown_breaker")
        for reason in ("limit_up_buy_blocked", "limit_down_sell_blocked"):
            self._set(shut == REASONS.index(reason), reason)
        self._set((volume >= 1) & (volume < r.lot), "volume_too_small")

    def _set(self, rows: np.ndarray, reason: str) -> None:
        self.why[(self.why == 0) & rows] = REASONS.index(reason)

    def fill(self, a: int, b: int) -> list[tuple]:
        """Purchases a to b: those that cash may pay for are tried in order, the others between them are turned down together. As purchases
        only lower cash and worth, what was surely too dear stays so; after one that fails, what is left is looked at anew."""
        out, look = [], LOOK
        while a < b:
            end = min(a + look, b)
            free = np.flatnonzero(self.why[a:end] == 0) + a
            worth = self.desk.about
            no_room, no_cash = self._short(free, worth)
            tried = free[~(no_room | no_cash)]
            upto = end
            for k in tried:
                cash = self.desk.cash
                out.append(self.desk.fill(self.desk.buys[int(k)].as_py(), int(self.desk.wanted[k]), _bar(self.bars, self.at[k])))
                if self.desk.cash == cash or not self.desk.about > 0.75 * worth:
                    upto = int(k) + 1
                    break
            passed = free < upto
            self.why[free[passed & no_room]] = REASONS.index("position_limit")
            self.why[free[passed & no_cash]] = REASONS.index("insufficient_cash")
            a, look = upto, LOOK if upto < end else 2 * look
        return out

    def _short(self, k: np.ndarray, worth: float) -> tuple[np.ndarray, np.ndarray]:
        """Which purchases surely have no room for a lot, and which have room (for two, so that worth may fall) but surely no cash for one."""
        r, lot = self.desk.r, self.desk.r.lot
        with np.errstate(all="ignore"):
            low, high, cash = self.low[k], self.high[k], self.desk.cash
            room = worth * r.max_position if r.max_position > 0 else np.inf
            no_room = room / low < lot * (1 - 2 * SLACK)
            by_rate, by_least = cash / (low * (1 + r.commission)), (cash - (r.min_commission if r.commission > 0 else 0.0)) / low  # without transfer fees, which only add
            no_cash = (room / high >= 2 * lot) & (np.minimum(by_rate, by_least) + SLACK < lot * (1 - SLACK))
        odd = self.odd[k]
        return no_room & ~odd, no_cash & ~odd


class _Stretch:
    """A date's orders in their order, sales among purchases, filled many at once as long as cash and limits of worth decide nothing: then
    cash and worth before each order are running sums, added up in the same order as one by one."""

    def __init__(self, desk: Desk, book: _Book, sales: list[tuple[str, int]], before: list[int], sold: np.ndarray, bars: dict[str, np.ndarray]):
        r, self.desk, self.book, self.sales = desk.r, desk, book, sales
        nb, ns = len(book.at), len(sales)
        self.place = np.array(before, np.int64) + np.arange(ns)
        self.sale = np.zeros(nb + ns, bool)
        self.sale[self.place] = True
        self.k = np.where(self.sale, np.cumsum(self.sale), np.cumsum(~self.sale)) - 1  # number among sales or purchases
        at = np.full(nb + ns, -1, np.int64)
        at[self.sale], at[~self.sale] = sold, book.at
        there = at >= 0
        b = {c: np.full(nb + ns, np.nan) for c in ("open", "high", "low", "vol")}
        for c in b:
            b[c][there] = bars[c][at[there]]
        self.b = b
        self.codes = np.empty(nb + ns, object)
        self.codes[self.sale], self.codes[~self.sale] = [c for c, _ in sales], desk.buys.to_pylist()
        self.wanted = np.zeros(nb + ns, np.int64)
        self.wanted[self.sale], self.wanted[~self.sale] = [n for _, n in sales], desk.wanted
        # why an order is turned down, whatever cash there is
        self.why = np.zeros(nb + ns, np.int8)
        self.why[~self.sale] = book.why
        shut = np.zeros(nb + ns, np.int8)
        shut[there] = bars["no_sell"][at[there]]
        self.why[self.sale & ~there] = REASONS.index("no_data_on_date")
        for reason in ("star_market_filtered", "st_filtered", "limit_up_buy_blocked", "limit_down_sell_blocked"):
            self.why[self.sale & (shut == REASONS.index(reason))] = REASONS.index(reason)
        # what is sold for a second reason is tried by itself
        first = np.zeros(ns, bool)
        first[np.unique(np.array([c for c, _ in sales], str), return_index=True)[1]] = True
        with np.errstate(all="ignore"):
            most = np.abs(self.wanted).astype(float)
            volume = b["vol"] * 100 * r.volume_limit
            self.most = np.where(volume >= 1, np.minimum(most, np.floor(volume)), most)
            self.n = np.where(self.most > 0, np.floor_divide(self.most, r.lot), 0.0) * r.lot
            self.why[self.sale & (self.why == 0) & (self.n <= 0)] = REASONS.index("volume_too_small")
            self.raw = np.maximum(0.0, b["open"] + np.where(self.sale, -1, 1) * r.slippage)
        self.known = np.isfinite(self.raw) & np.isfinite(b["high"]) & np.isfinite(b["low"]) & (self.n > 0)
        self.known[self.place[~first]] = False
        self.why[self.place[~first]] = 0

    def sales_in(self, a: int, b: int) -> range:
        return range(*np.searchsorted(self.place, (a, b)).tolist())

    def purchases(self, a: int, b: int) -> tuple[int, int]:
        """Numbers of the purchases at places a to b."""
        return a - int(np.searchsorted(self.place, a)), b - int(np.searchsorted(self.place, b))

    def fill(self, a: int, b: int, events: list[tuple]) -> int:
        """Fills orders from place a on, up to b or the first that has to be tried by itself, and adds what happens; how many, none if too few for it."""
        desk, r, s = self.desk, self.desk.r, slice(a, b)
        sale, trade = self.sale[s], self.why[s] == 0
        with np.errstate(all="ignore"):
            price, high, low = np.array([round(x, 2) if x == x else x for x in self.raw[s].tolist()]), self.b["high"][s], self.b["low"][s]
            price = np.where((high > 0) & (low > 0), np.maximum(low, np.minimum(high, price)), price)
            ok = ~trade | self.known[s] & (price > 0)
            own = [desk.held.get(c) if t else None for c, t in zip(self.codes[s], trade, strict=True)]
            ok &= ~trade | (np.array([p is not None for p in own], bool) == sale)
            held = np.array([p["sellable"] if p else 0 for p in own], np.int64)
            ok &= ~trade | ~sale | (held == -self.wanted[s])
            n, last = np.where(trade, self.n[s], 0.0), np.array([p["last"] if p else 0.0 for p in own])
            transfer = np.array([r.transfer_fee if ".SH" in c.upper() else 0.0 for c in self.codes[s]]) if r.transfer_fee else np.zeros(len(n))
            amount = n * price
            commission = np.maximum(amount * r.commission, r.min_commission)
            tax = amount * transfer + np.where(sale, amount * r.stamp_tax, 0.0)
            paid = np.where(trade, np.where(sale, -amount, amount) + commission + tax, 0.0)
            cash = np.subtract.accumulate(np.concatenate(([desk.cash], paid)))
            moves = np.zeros(2 * len(n) + 1)
            moves[0], moves[1::2], moves[2::2] = desk.about, np.where(trade, -(commission + tax), 0.0), np.where(trade & sale, n * (price - last), 0.0)
            about = np.add.accumulate(moves)[::2]
            by_rate = cash[:-1] / (price * (1 + r.commission + transfer))
            by_least = (cash[:-1] - (r.min_commission if r.commission > 0 else 0.0)) / (price * (1 + transfer))
            lots = np.floor_divide(np.maximum(0.0, np.minimum(by_rate, by_least) + 1e-9), r.lot) * r.lot
            room = about[:-1] * (1 - SLACK) * r.max_position / np.maximum(price, 1e-12) if r.max_position > 0 else np.inf
            ok &= ~trade | sale | (lots >= n) & (room > np.maximum(r.lot, np.minimum(lots, self.most[s])))
        upto = len(ok) if ok.all() else int(np.argmin(ok))
        if upto < FEW and upto < len(ok):
            return 0
        desk.cash, desk.about = float(cash[upto]), float(about[upto])
        rows = zip(self.codes[s][:upto].tolist(), sale.tolist(), self.why[s].tolist(), self.wanted[s].tolist(), n.astype(np.int64).tolist(), price.tolist(), commission.tolist(), tax.tolist(), amount.tolist(), own, strict=False)
        for code, sell, why, wanted, m, p, c, t, x, old in rows:
            if why:
                if sell:  # purchases are reported together
                    events.append(("cancelled", code, REASONS[why], wanted))
                continue
            if not sell:
                desk.held[code] = {"shares": m, "sellable": 0, "cost": x / m, "last": p}
            elif old["shares"] == m:
                del desk.held[code]
            else:
                old["shares"] -= m
                old["sellable"] -= m
            events.append(("trade", code, "sell" if sell else "buy", wanted, m, round(p, 4), round(c, 2), round(t, 2)))
        return upto


def run(panel: DataFrame, runs: dict[str, DataFrame], rules: Rules = Rules()) -> DataFrame:
    """Events (``SCHEMA``) of several strategies over one panel: a day per date, trades, cancelled orders.
    ``runs``: signals by the name of the run."""
    bars = simulate.quotes(panel)
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    parts = [s.withColumn("seen", F.max("entry").over(w)).where("seen").drop("seen").withColumn("strategy", F.lit(name)) for name, s in runs.items()]
    parts = [s if set(QUOTE) <= set(s.columns) else s.join(bars, ["ts_code", "trade_date"]) for s in parts]
    sizes = panel.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    days = sorted(map(tuple, sizes.collect()))  # a row per date
    legs = legs_of(days, LEG)
    clock = panel.sparkSession.createDataFrame(days, sizes.schema).select("trade_date", F.explode(F.array(*[F.lit(n) for n in runs])).alias("strategy"), F.lit("").alias("ts_code"))
    rows = clock
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    options = asdict(rules)

    def start(key: tuple, state: bytes | None) -> Desk:
        return pickle.loads(state) if state else Desk(Rules(**options))

    number = (F.array_position(F.array(*[F.lit(n) for n in runs]), F.col("strategy")) - 1).cast("int")
    return walk_dates(rows, KEYS, "trade_date", ["ts_code"], start, SCHEMA, legs, (len(runs), number))


def optimize(panel: DataFrame, strategy: str, grid: dict[str, list], rules: Rules = Rules(), year: int = 252) -> DataFrame:
    """(strategy, final_value, total_return, sharpe_ratio, max_drawdown), best Sharpe ratio first: every combination of
    parameters is a run of one job."""
    import itertools

    names = sorted(grid)
    bars = quoted(panel)
    runs = {f"{strategy}({', '.join(f'{n}={v}' for n, v in zip(names, vs, strict=True))})": signals(bars, strategy, **dict(zip(names, vs, strict=True))) for vs in itertools.product(*[grid[n] for n in names])}
    return results(run(panel, runs, rules), rules, year)


def results(events: DataFrame, rules: Rules = Rules(), year: int = 252) -> DataFrame:
    """One row per run, best Sharpe ratio (over 3 % a year) first."""
    w = Window.partitionBy("strategy").orderBy("trade_date")
    is_ = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(kind)
    # one pass over the events: a row per run and date
    days = events.groupBy("strategy", "trade_date").agg(F.max("value").alias("value"), is_("trade"), is_("cancelled"))
    days = days.withColumn("r", F.col("value") / F.coalesce(F.lag("value").over(w), F.lit(rules.cash)) - 1).withColumn("dd", F.col("value") / F.greatest(F.lit(rules.cash), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    sd = F.stddev_samp("r")
    out = days.groupBy("strategy").agg(F.max_by("value", "trade_date").alias("final_value"), F.round(100 * (F.max_by("value", "trade_date") / rules.cash - 1), 2).alias("total_return"), F.round(F.when(sd > 1e-12, (F.avg("r") - 0.03 / year) / sd * year**0.5).otherwise(0.0), 4).alias("sharpe_ratio"), F.round(100 * F.min("dd"), 2).alias("max_drawdown"), F.sum("trade").alias("trades"), F.sum("cancelled").alias("cancelled"))
    return out.orderBy(F.desc("sharpe_ratio"), "strategy")


# --- registered queries ----------------------------------------------------


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = simulate._cents(market_panel(spark, sf_dir))
        return run(panel, {name: signals(quoted(panel), name)})

    return query


def strategy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = simulate._cents(market_panel(spark, sf_dir))
    return results(run(panel, {n: signals(quoted(panel), n) for n in STRATEGIES}, Rules(stop_loss=0.1, take_profit=0.2, max_drawdown=0.5)))


def strategy_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize(simulate._cents(market_panel(spark, sf_dir)), "ma_cross", {"short": [3, 5], "long": [10, 20]})


def strategy_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = simulate._cents(market_panel(spark, sf_dir))
    e = run(panel, {n: signals(quoted(panel), n) for n in ("momentum", "turtle", "bollinger")})
    return e.where("kind = 'cancelled'").groupBy("strategy", F.col("what").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy("strategy", F.desc("n"), "reason")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"strategy_{n}": _query(n) for n in STRATEGIES} | {f.__name__: f for f in (strategy_results, strategy_optimize, strategy_cancelled)}


def oracle_sql() -> dict[str, str]:
    return {}
