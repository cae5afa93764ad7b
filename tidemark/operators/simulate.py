"""Execution-aware portfolio simulation of factor scores.

Ranks, tradability and prices are columns computed in Spark; only what depends on
cash walks over dates (see ``walk``), one run per factor, direction, segment and parameter
set. Of the panel a run sees the bars of securities that it may hold: from a date on which its
worth pays for a lot of them until they are sold for certain, so what a run reads follows its cash and not the
number of securities; one that outgrows this bound sees all bars of what it ever picks. A date is a step over columns: sales, which no cash bounds,
are made at once, and only trades of targets one by one. What it reports are events (days, trades, rejections), and everything else
follows from them in DataFrames.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compile import evaluate
from ..sources.panel import market_panel
from ..sources.work import staged
from .walk import legs_of, walk_dates


@dataclass(frozen=True)
class Settings:
    """The market's rules by default."""

    cash: float = 1_000_000.0
    select_pct: float = 0.1
    rebalance: int = 5
    commission: float = 0.0003
    min_commission: float = 5.0
    stamp_tax: float = 0.001
    transfer_fee: float = 0.0
    slippage: float = 0.001  # an amount of money for each share
    volume_limit: float = 0.1
    max_position: float = 0.12
    exposure: float = 0.95
    lot: int = 100
    limit_pct: float = 0.1
    growth_limit_pct: float = 0.2
    st_limit_pct: float = 0.05
    skip_star: bool = True
    skip_st: bool = True


#: What identifies a run.
RUN = ["factor", "direction", "segment", "select_pct", "rebalance"]
RUN_SCHEMA = "factor string, direction string, segment string, select_pct double, rebalance int"
EVENTS = f"{RUN_SCHEMA}, trade_date date, kind string, ts_code string, what string, price double, shares long, amount double, commission double, stamp_tax double, transfer_fee double, value double, cash double, positions int"
#: Fixed value: scored securities without which a date does not rebalance.
LEAST_SCORED = 5
#: How many times its cash a run is first thought to be worth at most; one that is worth more is walked again over all bars of what it picks.
WORTH = 2.0
#: Fixed value: rows of a run that a task sorts at once.
LEG = 3_000_000
#: What rounding may move a limit by, as a share of it.
SLACK = 1e-6


# --- rules as columns ------------------------------------------------------


def limit_share(code: Column, name: Column, s: Settings) -> Column:
    """How far a price may move in a day."""
    return F.when(F.upper(F.coalesce(name, F.lit(""))).contains("ST"), s.st_limit_pct).when(code.rlike("^(300|688)"), s.growth_limit_pct).otherwise(s.limit_pct)


def quotes(panel: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bars with ``no_buy`` and ``no_sell``: the reason why a security cannot be traded on the date, or
    null. The panel may have a ``name`` (ST is told by it)."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    name = F.col("name") if "name" in panel.columns else F.lit(None).cast("string")
    bars = panel.select("ts_code", "trade_date", "open", "high", "low", "close", F.col("volume").alias("vol"), name.alias("name"), F.lag("close").over(w).alias("prev"))
    pct = limit_share(F.col("ts_code"), F.col("name"), s)
    shut = F.when(F.lit(s.skip_star) & F.col("ts_code").startswith("688"), "star_market_filtered")
    shut = shut.when(F.lit(s.skip_st) & F.upper(F.coalesce("name", F.lit(""))).contains("ST"), "st_filtered")
    live = (F.col("open") > 0) & (F.col("close") > 0) & (F.col("vol") > 0)
    shut = shut.when(~F.coalesce(live, F.lit(False)), "paused_or_missing_price")
    up, down = F.bround(F.col("prev") * (1 + pct), 2), F.bround(F.col("prev") * (1 - pct), 2)
    known = F.col("prev") > 0
    return bars.select("ts_code", "trade_date", "open", "high", "low", "close", "vol", shut.when(known & (F.col("open") >= up), "limit_up_buy_blocked").alias("no_buy"), shut.when(known & (F.col("open") <= down), "limit_down_sell_blocked").alias("no_sell"))


def schedule(panel: DataFrame, segments: DataFrame | None, sets: list[tuple[float, int]], directions: tuple[str, ...]) -> DataFrame:
    """(direction, segment, select_pct, rebalance, trade_date, signal, due): the dates of each run; ``signal`` is
    the panel's date before, in the segment or not, and every ``rebalance``-th date of
    the segment is due. segments: (segment, trade_date), or None for all dates. A row per date of a
    calendar: windows over it are small."""
    days = panel.select("trade_date").distinct().withColumn("signal", F.lag("trade_date").over(Window.orderBy("trade_date")))
    own = days.withColumn("segment", F.lit("")) if segments is None else days.join(segments.select("segment", "trade_date").distinct(), "trade_date")
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("segment").orderBy("trade_date")) - 1)
    runs = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(float(p)).alias("select_pct"), F.lit(int(k)).alias("rebalance")) for d in directions for p, k in sets])
    own = own.withColumn("r", F.explode(runs)).select("r.*", "segment", "trade_date", "signal", "i")
    return own.select("direction", "segment", "select_pct", "rebalance", "trade_date", "signal", (F.col("signal").isNotNull() & (F.col("i") % F.col("rebalance") == 0)).alias("due"))


# --- sizes -----------------------------------------------------------------


def whole_lots(shares: float, lot: int) -> int:
    return int(max(0.0, shares) // lot) * lot


def fill_price(open_: float, low: float, high: float, side: int, slip: float) -> float:
    """The open moved against the trader by ``slip``, within the bar."""
    p = round(max(0.0, open_ + side * slip), 2)
    return max(low, min(high, p)) if high > 0 and low > 0 else p


def broker_fee(amount: float, rate: float, least: float) -> float:
    return max(amount * rate, least) if amount > 0 and rate > 0 else 0.0


def affordable_lots(cash: float, price: float, rate: float, least: float, other: float, lot: int) -> int:
    """Most shares in whole lots whose amount, commission (at least ``least``) and other rates fit into cash."""
    if price <= 0:
        return 0
    by_rate = cash / (price * (1 + rate + other))
    by_least = (cash - (least if rate > 0 else 0.0)) / (price * (1 + other))
    return whole_lots(min(by_rate, by_least) + 1e-9, lot)


def weight(s: Settings, targets: int) -> float:
    """The share of an account's worth that each of so many targets gets."""
    return min(min(max(s.exposure, 0.0), 1.0) / max(1, targets), max(s.max_position, 0.0))


class Account:
    """Cash of one run, and shares and last prices of the securities that it has seen, as columns. ``bound``: the greatest worth that its rows are
    enough for."""

    def __init__(self, s: Settings, bound: float = math.inf):
        self.s, self.cash, self.most, self.bound = s, s.cash, s.cash, bound  # most: the greatest worth that targets were sized by
        self.codes = pa.array([], pa.string())
        self.shares, self.since, self.buys = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # since: which purchase made the position
        self.opens, self.closes = np.zeros(0), np.zeros(0)  # 0: not known

    def state(self) -> bytes:
        return pickle.dumps(self)

    def held(self) -> np.ndarray:
        """Places of the positions in the order in which they were opened."""
        own = np.flatnonzero(self.shares)
        return own[np.argsort(self.since[own])]

    def worth(self, opening: bool) -> float:
        """Cash and shares at the last opens (closes where none is known) or closes."""
        own = self.held()
        price = np.where(self.opens[own] > 0, self.opens[own], self.closes[own]) if opening else self.closes[own]
        return self.cash + sum((self.shares[own] * price).tolist())

    def see(self, code: pa.Array) -> np.ndarray:
        """Places of the securities, new ones included."""
        at = pc.index_in(code, self.codes)
        if at.null_count:
            new = code.filter(pc.is_null(at))
            self.codes = pa.concat_arrays([self.codes, new])
            self.shares, self.since, self.opens, self.closes = (np.concatenate((x, np.zeros(len(new), x.dtype))) for x in (self.shares, self.since, self.opens, self.closes))
            at = pc.index_in(code, self.codes)
        return at.to_numpy()

    def transfer(self, own: np.ndarray) -> np.ndarray:
        """The transfer fee's rate for each place."""
        if not self.s.transfer_fee:
            return np.zeros(len(own))
        return np.array([self.s.transfer_fee if ".SH" in c.upper() else 0.0 for c in self.codes.take(pa.array(own)).to_pylist()])

    def sell(self, own: np.ndarray, row: np.ndarray, bars: dict) -> tuple[list[dict], list[float]]:
        """Sells all of the positions, as far as limits allow, in their order: events and amounts. Rows: places among the bars, or -1."""
        s, there = self.s, row >= 0
        if not len(own):
            return [], []
        why = np.full(len(own), "paused_or_missing_price", object)
        why[there] = bars["no_sell"][row[there]]
        free = np.flatnonzero(np.equal(why, None))
        b = {c: bars[c][row[free]] for c in ("open", "high", "low", "vol")}
        price = np.array([round(max(0.0, x - s.slippage), 2) for x in b["open"].tolist()])
        with np.errstate(invalid="ignore"):
            price = np.where((b["high"] > 0) & (b["low"] > 0), np.maximum(b["low"], np.minimum(b["high"], price)), price)
            n = np.floor_divide(np.maximum(0.0, np.minimum(self.shares[own[free]], b["vol"] * 100 * s.volume_limit)), s.lot) * s.lot
        why[free[n <= 0]] = "below_lot_or_volume_cap"
        sold, n, price = own[free[n > 0]], n[n > 0], price[n > 0]
        amount = n * price
        commission = np.where((amount > 0) & (s.commission > 0), np.maximum(amount * s.commission, s.min_commission), 0.0)
        tax, transfer = amount * s.stamp_tax, amount * self.transfer(sold)
        self.cash = float(np.subtract.accumulate(np.concatenate(([self.cash], -amount + _sum(commission, tax, transfer))))[-1])
        n = n.astype(np.int64)
        self.shares[sold] -= n
        no = np.flatnonzero(~np.equal(why, None))
        out = [{"kind": pa.repeat("reject", len(no)), "ts_code": self.codes.take(pa.array(own[no])), "what": pa.array(why[no], pa.string())}]
        out.append({"kind": pa.repeat("trade", len(sold)), "ts_code": self.codes.take(pa.array(sold)), "what": pa.repeat("sell", len(sold)), "price": [round(x, 4) for x in price.tolist()], "shares": n, "amount": amount, "commission": commission, "stamp_tax": tax, "transfer_fee": transfer})
        return out, amount.tolist()

    def trade(self, at: int, code: str, bar: dict, wanted: float, about: float) -> tuple[tuple, float]:
        """Buys (wanted > 0) or sells of a target what all limits allow. The event (a trade, or the first limit
        that leaves less than can be traded), and ``about``, the worth at opens but for rounding, after it."""
        s, side, held = self.s, 1 if wanted > 0 else -1, int(self.shares[at])
        if side < 0 and bar["no_sell"] is not None:
            return ("reject", code, bar["no_sell"]), about
        p = fill_price(bar["open"], bar["low"], bar["high"], side, s.slippage)
        transfer = s.transfer_fee if ".SH" in code.upper() else 0.0
        limits = {"below_lot_or_volume_cap": min(abs(wanted) if side > 0 else min(-wanted, held), bar["vol"] * 100 * s.volume_limit)}
        if side > 0:
            cash = affordable_lots(self.cash, p, s.commission, s.min_commission, transfer, s.lot)
            room = lambda worth: (worth * s.max_position - held * bar["open"]) / max(p, 1e-12)
            # all that is held is added up only where that may matter
            if s.max_position > 0 and not room(about * (1 - SLACK)) > max(s.lot, min(cash, *limits.values())):
                limits["max_position_pct"] = room(self.worth(True))
            limits["insufficient_cash"] = cash
        for reason, most in limits.items():
            if whole_lots(most, s.lot) <= 0:
                return ("reject", code, reason), about
        n = whole_lots(min(limits.values()), s.lot)
        amount = n * p
        fees = (broker_fee(amount, s.commission, s.min_commission), amount * s.stamp_tax if side < 0 else 0.0, amount * transfer)
        self.cash -= side * amount + sum(fees)
        if not held:
            self.buys += 1
            self.since[at] = self.buys
        self.shares[at] = held + side * n
        return ("trade", code, "buy" if side > 0 else "sell", round(p, 4), n, amount, *fees), about + side * n * (bar["open"] - p) - sum(fees)

    def rebalance(self, at: np.ndarray, bars: dict, chosen: np.ndarray, of: int) -> tuple[list[dict], list[float]]:
        """Sells all but the chosen bars' securities (best first), then brings these to equal weight; there are ``of`` targets, as
        those that are neither held nor paid for by a lot's share may be left out. Events, and amounts of trades in order."""
        s = self.s
        row, target = np.full(len(self.codes), -1, np.int64), np.zeros(len(self.codes), bool)
        row[at], target[at[chosen]] = np.arange(len(at)), True
        own = self.held()
        own = own[~target[own]]
        out, amounts = self.sell(own, row[own], bars)
        about = worth = self.worth(True)
        self.most = max(self.most, worth)
        each = worth * weight(s, of)
        price = np.array([max(round(x + s.slippage, 2), 1e-12) for x in bars["open"][chosen].tolist()])
        wanted = np.floor_divide(np.maximum(0.0, np.trunc(each / price)), s.lot) * s.lot - self.shares[at[chosen]]
        chosen, wanted = chosen[wanted != 0], wanted[wanted != 0]
        own, events = at[chosen], []
        columns = [bars[c][chosen].tolist() for c in _TRADED]
        for k, code, w, *bar in zip(own.tolist(), self.codes.take(pa.array(own, pa.int64())).to_pylist(), wanted.tolist(), *columns, strict=True):
            event, about = self.trade(k, code, dict(zip(_TRADED, bar, strict=True)), w, about)
            events.append(event)
        amounts += [e[5] for e in events if e[0] == "trade"]
        if events:
            none = (None,) * len(_EVENT)
            out.append({n: list(v) for n, v in zip(_EVENT, zip(*[e + none[len(e) :] for e in events], strict=True), strict=True)})
        return out, amounts

    def day(self, day: object, rows: pa.Table) -> list[dict]:
        """Events of a date. Its first row is the run's own, unless it lies in a gap of the segment: then prices are noted, and nothing is told."""
        if self.most > self.bound:
            return [{"kind": ["over"], "amount": [self.most]}]
        told = rows["ts_code"][0].as_py() == ""
        first, rows = rows.slice(0, 1), rows.slice(1) if told else rows
        code = rows["ts_code"].combine_chunks().cast(pa.string())
        at = self.see(code)
        bars = {c: rows[c].to_numpy() for c in ("open", "high", "low", "close", "vol", "nth", "no_sell")}
        open_, close = bars["open"] > 0, bars["close"] > 0
        self.opens[at[open_]] = bars["open"][open_]
        out, amounts = [], []
        if told and first["active"][0].as_py():
            nth = bars["nth"].astype(float)
            chosen = np.flatnonzero(~np.isnan(nth))
            out, amounts = self.rebalance(at, bars, chosen[np.argsort(nth[chosen])], first["targets"][0].as_py())
        if self.most > self.bound:
            return [{"kind": ["over"], "amount": [self.most]}]
        self.closes[at[close]] = bars["close"][close]
        if not told:
            return []
        return [*out, {"kind": ["day"], "amount": [float(sum(amounts))], "value": [self.worth(False)], "cash": [self.cash], "positions": [int(np.count_nonzero(self.shares))]}]


#: What a trade reads of a bar, and columns of trades.
_TRADED = ("open", "high", "low", "vol", "no_sell")
_EVENT = ("kind", "ts_code", "what", "price", "shares", "amount", "commission", "stamp_tax", "transfer_fee")


def _sum(*parts: np.ndarray) -> np.ndarray:
    """What ``sum`` makes of each row: with rounding errors added up beside."""
    total, lost = parts[0], 0.0
    for x in parts[1:]:
        new = total + x
        lost = lost + np.where(np.abs(total) >= np.abs(x), (total - new) + x, (x - new) + total)
        total = new
    return total + lost


# --- runs ------------------------------------------------------------------


def events(panel: DataFrame, scores: DataFrame, directions: tuple[str, ...] = ("top", "bottom"), s: Settings = Settings(), sets: list[tuple[float, int]] | None = None, segments: DataFrame | None = None) -> DataFrame:
    """All events of all runs (``EVENTS``): a day per date of the segment, trades and rejections.

    scores: (ts_code, trade_date, factor, value). On due dates with at least ``LEAST_SCORED``
    scores of the date before, the best ``select_pct`` of all scored are picked among those that can be bought;
    ties go by code. Trades are made at the open, values at the close; a missing quote carries the last one.
    """
    sets = sets or [(s.select_pct, s.rebalance)]
    bars = quotes(panel, s)
    plan = schedule(panel, segments, sets, directions)
    due = plan.where("due").select(*RUN[1:], "trade_date", "signal")
    scored = scores.where("value IS NOT NULL").select("factor", "ts_code", F.col("trade_date").alias("signal"), "value").join(F.broadcast(due), "signal")
    scored = scored.join(bars.select("ts_code", "trade_date", "open", "no_buy", F.lit(True).alias("quoted")), ["ts_code", "trade_date"], "left")
    scored = scored.withColumn("no_buy", F.when(F.col("quoted"), F.col("no_buy")).otherwise("paused_or_missing_price"))
    date = Window.partitionBy(*RUN, "trade_date")
    sign = F.when(F.col("direction") == "bottom", F.col("value")).otherwise(-F.col("value"))
    scored = scored.withColumn("n", F.count(F.lit(1)).over(date)).withColumn("free", F.count(F.when(F.col("no_buy").isNull(), 1)).over(date)).where(F.col("n") >= LEAST_SCORED)
    scored = scored.withColumn("nth", F.row_number().over(date.orderBy(F.col("no_buy").isNotNull(), sign, "ts_code")))
    goal = F.greatest(F.lit(1), F.floor(F.col("n") * F.greatest(F.lit(0.001), F.least(F.col("select_pct"), F.lit(1.0)))))
    picked = F.col("no_buy").isNull() & (F.col("nth") <= goal)
    # what is told of scored rows further on: picks, refusals, and that the date has scores
    told = scored.where(picked | F.col("no_buy").isNotNull() | (F.col("nth") == 1))
    told = staged(told.select(*RUN, "trade_date", "ts_code", "nth", "no_buy", "open", picked.alias("picked"), F.least("free", goal).cast("int").alias("targets")), "told")
    # a row per run, and one per date for the run itself: as many as the curves have
    first = plan.select(*RUN[1:]).distinct()
    runs = staged(scores.select("factor").distinct().crossJoin(F.broadcast(first)).withColumn("run", (F.row_number().over(Window.orderBy(*RUN)) - 1).cast("int")), "runs")
    own = told.join(F.broadcast(runs), RUN).drop(*RUN)
    picks = own.where("picked")
    active = own.where("nth = 1").select("run", "trade_date", F.lit(True).alias("active"), "targets")
    clock = F.broadcast(runs).join(plan.select(*RUN[1:], "trade_date"), RUN[1:]).select("run", "trade_date").join(active, ["run", "trade_date"], "left")
    clock = staged(clock.withColumn("ts_code", F.lit("")).withColumn("active", F.coalesce("active", F.lit(False))), "clock")
    last = clock.groupBy("run").agg(F.max("trade_date").alias("last"))
    options, tasks = asdict(s), max(1, runs.count())
    legs = legs_of(sorted(map(tuple, panel.groupBy("trade_date").count().collect())), LEG)  # a row per date

    def walked(worth: float, some: DataFrame | None) -> DataFrame:
        """Events of runs that are worth so much at most when they buy; ``over`` where one is worth more."""
        of = (lambda df: df) if some is None else (lambda df: df.join(F.broadcast(some), "run", "left_semi"))
        rows = _holdable(of(picks), active, bars, last, s, worth)
        rows = rows.unionByName(of(clock), allowMissingColumns=True)

        def start(key: tuple, state: bytes | None) -> Account:
            return pickle.loads(state) if state else Account(Settings(**options), worth)

        schema = f"run int, {EVENTS.removeprefix(RUN_SCHEMA + ', ')}"
        return staged(walk_dates(rows, ["run"], "trade_date", ["ts_code"], start, schema, legs, (tasks, F.col("run"))), "events")

    out = walked(WORTH * s.cash, None)
    over = staged(out.where("kind = 'over'").select("run").distinct(), "over")
    if not over.isEmpty():
        out = out.join(F.broadcast(over), "run", "left_anti").unionByName(walked(math.inf, over))
    out = out.join(F.broadcast(runs), "run").select(*[c.split()[0] for c in EVENTS.split(", ")])
    turned = told.where("no_buy IS NOT NULL").select(*RUN, "trade_date", F.lit("reject").alias("kind"), "ts_code", F.col("no_buy").alias("what"))
    return out.unionByName(turned, allowMissingColumns=True)


def _holdable(picks: DataFrame, active: DataFrame, bars: DataFrame, last: DataFrame, s: Settings, worth: float) -> DataFrame:
    """Bars (with ``nth`` where picked) on the dates on which a run may hold a security: from a pick for which an account of
    ``worth`` would size a lot or more, to a rebalancing date that surely sells all of it: not picked, not blocked, and with enough volume.
    Of worth without bound, all bars from the first pick on. A security's picks go with it, so bars stay where they are."""
    each = F.least(F.lit(min(max(s.exposure, 0.0), 1.0)) / F.greatest("targets", F.lit(1)), F.lit(max(s.max_position, 0.0))) * (worth * (1 + 1e-9))
    shares = each / F.greatest(F.col("open") + s.slippage - 0.01, F.lit(1e-12))
    sized = picks.withColumn("shares", shares).withColumn("sized", F.lit(math.isinf(worth)) | (F.col("shares") >= s.lot))
    own = lambda c: F.when(F.col("sized"), F.col(c))
    ever = sized.groupBy("run", "ts_code").agg(F.min(own("trade_date")).alias("first"), F.max(own("shares")).alias("most"), F.map_from_entries(F.collect_list(F.struct("trade_date", F.struct("nth", "sized")))).alias("picks")).where("first IS NOT NULL")
    rows = bars.join(ever, "ts_code").join(F.broadcast(last), "run").where((F.col("trade_date") >= F.col("first")) & (F.col("trade_date") <= F.col("last")))
    rows = rows.join(F.broadcast(active.select("run", "trade_date", "active")), ["run", "trade_date"], "left").withColumn("pick", F.try_element_at("picks", "trade_date"))
    # what only a trade reads is not sent for other dates
    rows = rows.select("run", "trade_date", "ts_code", "open", "close", *[F.when(F.col("active"), F.col(c)).alias(c) for c in ("high", "low", "vol", "no_sell")], F.col("pick.nth").alias("nth"), F.coalesce("pick.sized", F.lit(False)).alias("sized"), "active", "most")
    if math.isinf(worth):
        return rows.drop("sized", "active", "most")
    sold = F.col("active") & F.col("nth").isNull() & F.col("no_sell").isNull() & (F.col("vol") * 100 * s.volume_limit >= F.col("most"))
    w = Window.partitionBy("run", "ts_code").orderBy("trade_date")
    bought = F.max(own("trade_date")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.max(F.when(sold, F.col("trade_date"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("bought", bought).withColumn("gone", gone).where(F.col("gone").isNull() | (F.col("gone") < F.col("bought")))
    return rows.drop("sized", "active", "most", "bought", "gone")


def daily(events_: DataFrame) -> DataFrame:
    """Per run and date: value, cash, positions, traded, and how many buys, sells and rejections."""
    is_ = lambda k, w=None: F.sum(((F.col("kind") == k) & (F.lit(True) if w is None else F.col("what") == w)).cast("int")).cast("int")
    day = lambda c: F.max(F.when(F.col("kind") == "day", F.col(c)))
    return events_.groupBy(*RUN, "trade_date").agg(F.round(day("value"), 2).alias("value"), F.round(day("cash"), 2).alias("cash"), day("positions").alias("positions"), F.round(day("amount"), 2).alias("traded"), is_("trade", "buy").alias("buys"), is_("trade", "sell").alias("sells"), is_("reject").alias("rejected"))


def trades(events_: DataFrame) -> DataFrame:
    """Trades with their amounts and fees to the cent."""
    money = [F.round(c, 2).alias(n) for c, n in (("amount", "trade_value"), ("commission", "commission"), ("stamp_tax", "stamp_tax"), ("transfer_fee", "transfer_fee"))]
    return events_.where("kind = 'trade'").select(*RUN, "trade_date", F.col("ts_code").alias("code"), F.col("what").alias("action"), "price", "shares", *money, F.round(F.col("commission") + F.col("stamp_tax") + F.col("transfer_fee"), 2).alias("fee"))


def rejections(events_: DataFrame) -> DataFrame:
    """How often each reason kept an order back, by run."""
    return events_.where("kind = 'reject'").groupBy(*RUN, F.col("what").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def curves(days: DataFrame, benchmark: DataFrame, cash: float) -> DataFrame:
    """Per run and date of ``daily``: value, normalized, benchmark, benchmark_normalized and excess (in percent of
    the run's start). benchmark: (trade_date, close); gaps take the close before, or else
    the first one."""
    w = Window.partitionBy(*RUN).orderBy("trade_date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = days.select(*RUN, "trade_date", "value").join(benchmark.select("trade_date", F.col("close").alias("b")), "trade_date", "left")
    x = x.withColumn("b", F.coalesce(F.last("b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("b", ignorenulls=True).over(whole)))
    x = x.withColumn("b0", F.first("b").over(whole)).withColumn("v0", F.first("value").over(whole))
    x = x.withColumn("benchmark", F.round(F.when(F.col("b0") > 0, F.col("b") / F.col("b0") * cash).otherwise(cash), 2))
    x = x.withColumn("m0", F.first("benchmark").over(whole))
    return x.select(*RUN, "trade_date", "value", F.round(F.col("value") / F.col("v0"), 6).alias("normalized"), "benchmark", F.round(F.col("benchmark") / F.col("m0"), 6).alias("benchmark_normalized"), F.round((F.col("value") / F.col("v0") - F.col("benchmark") / F.col("m0")) * 100, 4).alias("excess"))


def summary(days: DataFrame, curve: DataFrame, cash: float, year: int = 252) -> DataFrame:
    """Per run: total_return, annual_return, max_drawdown, turnover, benchmark_return and excess_return in percent,
    sharpe_ratio (without a riskless rate, more than two returns), trade_count."""
    w = Window.partitionBy(*RUN).orderBy("trade_date")
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev = F.coalesce(F.lag("value").over(w), F.lit(cash))
    x = days.withColumn("r", F.col("value") / prev - 1).withColumn("dd", (peak - F.col("value")) / peak).withColumn("turn", F.col("traded") / F.col("value") * 100)
    n, sd = F.count(F.lit(1)), F.stddev_samp("r")
    x = x.groupBy(*RUN).agg(n.alias("n"), ((F.max_by("value", "trade_date") / cash - 1) * 100).alias("total"), (F.max("dd") * 100).alias("dd"), F.when((n > 2) & (sd > 0), F.avg("r") / sd * math.sqrt(year)).otherwise(0.0).alias("sharpe"), F.avg("turn").alias("turn"), F.sum(F.col("buys") + F.col("sells")).alias("trades"))
    b = curve.groupBy(*RUN).agg(((F.max_by("benchmark", "trade_date") / cash - 1) * 100).alias("bench"))
    annual = (F.pow(F.greatest(F.lit(1e-6), 1 + F.col("total") / 100), year / F.col("n")) - 1) * 100
    return x.join(b, RUN).select(*RUN, F.round("total", 2).alias("total_return"), F.round(annual, 2).alias("annual_return"), F.round("dd", 2).alias("max_drawdown"), F.round("sharpe", 3).alias("sharpe_ratio"), F.col("trades").alias("trade_count"), F.round("turn", 2).alias("turnover"), F.round("bench", 2).alias("benchmark_return"), F.round(F.round("total", 2) - F.round("bench", 2), 2).alias("excess_return"))


def simulate(panel: DataFrame, scores: DataFrame, directions: tuple[str, ...] = ("top", "bottom"), s: Settings = Settings()) -> DataFrame:
    """Equity by date for each factor and direction. ``scores``: (ts_code, trade_date, factor, value)."""
    return daily(events(panel, scores, directions, s)).drop("segment", "select_pct", "rebalance")


def technical(panel: DataFrame, expression: str, enter: float, leave: float) -> DataFrame:
    """Threshold strategy per security: in after a value above ``enter``, out after one
    below ``leave``, fills at the next open; declarative, as state is the last signal."""
    x = evaluate(panel, {"value": expression, "o": "open"})
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    signal = F.when(F.col("value") > enter, 1).when(F.col("value") < leave, 0)
    x = x.withColumn("state", F.coalesce(F.last(signal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("r", F.coalesce(F.lead("o").over(w) / F.col("o") - 1, F.lit(0.0)) * F.col("state")).withColumn("turn", F.abs(F.col("state") - F.coalesce(F.lag("state").over(w), F.lit(0))))
    return x.groupBy("ts_code").agg(F.count(F.lit(1)).alias("days"), F.sum("turn").cast("long").alias("fills"), F.sum("state").cast("long").alias("days_in"), F.sum(F.log1p(F.col("r") - F.col("turn") * 0.0008)).alias("log_return"))


def grid(panel: DataFrame, scores: DataFrame, pcts: list[float], steps: list[int]) -> DataFrame:
    """Final value for each (select_pct, rebalance): parameter sets are runs of one job, best first."""
    s = Settings()
    days = daily(events(panel, scores, ("top",), s, [(p, k) for p in pcts for k in steps]))
    return days.groupBy("factor", "select_pct", "rebalance").agg(F.max_by("value", "trade_date").alias("final_value"), F.sum(F.col("buys") + F.col("sells")).cast("int").alias("trades")).orderBy(F.desc("final_value"), "factor", "select_pct", "rebalance")


def market_mean(panel: DataFrame) -> DataFrame:
    """(trade_date, close): the equal-weight benchmark, a cumulated mean of returns against each security's last
    close."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    r = panel.select("trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("r")).groupBy("trade_date").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("r"))
    return r.select("trade_date", F.exp(F.sum(F.log1p("r")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))).alias("close"))


def _scores(panel: DataFrame) -> DataFrame:
    f = evaluate(panel, {"momentum": "pctchange(close, 4)", "volume": "mean(volume, 4)"})
    return f.selectExpr("ts_code", "trade_date", "stack(2, 'momentum', momentum, 'volume', volume) AS (factor, value)").where("value IS NOT NULL")


def _cents(panel: DataFrame) -> DataFrame:
    return panel.select("ts_code", "trade_date", *[(F.col(c) / 10000).alias(c) for c in ("open", "high", "low", "close")], "volume")


def selection_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return simulate(_cents(p), _scores(p))


def selection_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return curves(daily(events(_cents(p), _scores(p), ("top",))), market_mean(p), Settings().cash)


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    days = daily(events(_cents(p), _scores(p)))
    return summary(days, curves(days, market_mean(p), Settings().cash), Settings().cash)


def selection_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return trades(events(_cents(p), _scores(p), ("top",)))


def selection_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return rejections(events(_cents(p), _scores(p)))


def technical_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical(market_panel(spark, sf_dir), "zscore(close, 10)", 0.5, -0.5)


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return grid(_cents(p), _scores(p), [0.1, 0.3], [4, 8])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (selection_backtest, selection_curves, selection_summary, selection_trades, selection_rejections, technical_backtest, grid_search)}


def oracle_sql() -> dict[str, str]:
    return {}
