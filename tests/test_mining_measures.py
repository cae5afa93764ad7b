"""Scores and gates of candidates against brute force in pandas."""

import math

import numpy as np
import pandas as pd

from tidemark.operators import mining, simulate
from tidemark.plans.compile import evaluate
from tidemark.sources.panel import market_panel

SF = "/root/testdata/sf0.01"
LATE = {"late": "delay(close, 250)", "momentum": "pctchange(close, 4)"}


def run_by_hand(rows, dates, cash=1_000_000.0, step=4):
    """Sells, then buys of the best tenth at the open of each fourth date; default rules."""
    held, last, values, turn, trades = {}, {"open": {}, "close": {}}, [], [], 0
    for i, day in enumerate(dates):
        here = list(rows[rows["trade_date"] == day].sort_values("ts_code").itertuples())
        bars = {b.ts_code: b for b in here if b.open > 0}
        worth = lambda f: cash + sum(n * (getattr(bars[c], f) if c in bars else last[f][c]) for c, n in held.items())  # noqa: E731,B023
        scored = [b for b in here if not math.isnan(b.score)]  # with or without a bar
        traded = 0.0
        if i % step == 0 and len(scored) >= 5:
            k = max(1, int(len(scored) * 0.1))
            picks = [b.ts_code for b in sorted((b for b in scored if b.open > 0 and b.can_buy), key=lambda b: (-b.score, b.ts_code))][:k]

            def sell(c, n):
                nonlocal cash, traded, trades
                b = bars.get(c)
                if b is None or not b.can_sell:
                    return
                n = min(n, held[c], int(min(int(n) // 100 * 100, b.vol * 10)) // 100 * 100)
                if n <= 0:
                    return
                amount = n * max(b.low, min(b.high, round(b.open - 0.001, 2)))
                cash += amount - max(amount * 0.0003, 5.0) - amount * 0.001
                held[c] -= n
                held.update() if held[c] else held.pop(c)
                traded, trades = traded + amount, trades + 1

            for c in [c for c in held if c not in picks]:
                sell(c, held[c])
            if picks:
                total = worth("open")
                goal = min(total * 0.95 / len(picks), total * 0.12)
                for c in picks:
                    b = bars[c]
                    want = int(goal / round(b.open + 0.001, 2)) // 100 * 100 - held.get(c, 0)
                    if want < 0:
                        sell(c, -want)
                    if want <= 0:
                        continue
                    p, cap, now = max(b.low, min(b.high, round(b.open + 0.001, 2))), int(b.vol * 10) // 100 * 100, worth("open")
                    n = min(want, cap)
                    if n >= 100 and held.get(c, 0) * b.open + n * p > now * 0.12:
                        n = min(max(0, int((now * 0.12 - held.get(c, 0) * b.open) / p)) // 100 * 100, cap)
                    if n >= 100 and n * p + max(n * p * 0.0003, 5.0) > cash:
                        n = min(n, int(cash / (p * 1.0003)) // 100 * 100)
                    if n >= 100:
                        cash -= n * p + max(n * p * 0.0003, 5.0)
                        held[c] = held.get(c, 0) + n
                        traded, trades = traded + n * p, trades + 1
        for f in last:  # a security without a bar is valued at its last price of the kind
            last[f].update({c: getattr(b, f) for c, b in bars.items()})
        values.append(round(worth("close"), 2))
        turn.append(traded / values[-1] * 100)
    v = pd.Series([1_000_000.0, *values])
    r = v.pct_change().dropna()
    return {"total": (v.iloc[-1] / 1e6 - 1) * 100, "drawdown": ((v[1:].cummax() - v[1:]) / v[1:].cummax()).max() * 100, "turnover": np.mean(turn), "sharpe": r.mean() / r.std() * math.sqrt(52) if r.std() > 0 else 0.0, "trades": trades}


def test_measures(spark):
    p = market_panel(spark, SF).cache()
    prices = simulate._cents(p)
    got = {(r["factor"], r["fold"]): r for r in mining.judged(mining.candidates(p, prices, LATE)).collect()}
    days = sorted(r["trade_date"] for r in p.select("trade_date").distinct().collect())
    folds = mining.walk_forward(len(days))
    assert got.keys() == {(f, k) for f in LATE for k in range(len(folds))}
    wide = evaluate(p, LATE).toPandas()
    stats = {(r["factor"], r["fold"], r["part"]): r for r in mining.batch_metrics(p, LATE).collect()}
    close = p.groupBy("trade_date").avg("close").toPandas().set_index("trade_date").iloc[:, 0]
    bars = simulate.quotes(prices).toPandas()
    bars["can_buy"], bars["can_sell"] = bars["no_buy"].isna(), bars["no_sell"].isna()
    scores = mining._stacked(p, LATE).where("value IS NOT NULL").toPandas().rename(columns={"value": "score"})
    scores["trade_date"] = scores["trade_date"].map(dict(zip(days, days[1:], strict=False)))
    rows = pd.concat([bars.merge(scores[scores["factor"] == f].drop(columns="factor"), on=["ts_code", "trade_date"], how="outer").assign(factor=f) for f in LATE])
    for (factor, k), r in got.items():
        of = {part: days[a:b] for part, (a, b) in folds[k].items()}
        mine = wide[wide["trade_date"].isin(of["valid"])]
        assert abs(r["coverage"] - 100 * mine[factor].notna().mean()) < 1e-9 and r["names"] == mine[mine[factor].notna()]["ts_code"].nunique()
        stat = stats.get((factor, k, "test"))
        assert abs(r["test_p"] - (math.erfc(abs(stat["t_stat"]) / math.sqrt(2)) if stat else 1.0)) < 1e-12
        assert abs(r["bonferroni_p"] - min(1.0, r["test_p"] * 2)) < 1e-12
        runs = {part: run_by_hand(rows[rows["factor"] == factor], of[part]) for part in ("valid", "test")}
        for part in runs:
            assert abs(r[f"{part}_excess"] - (runs[part]["total"] - 100 * (close[of[part][-1]] / close[of[part][0]] - 1))) < 1e-6
        assert all(abs(r[c] - runs["test"][c]) < 1e-6 for c in ("drawdown", "turnover", "sharpe", "trades")) and abs(r["valid_drawdown"] - runs["valid"]["drawdown"]) < 1e-6
        assert r["complexity"] == 1 and r["tested"] == 2
        assert abs(r["deflated_sharpe"] - (runs["test"]["sharpe"] - 0.15 * math.sqrt(math.log(2)))) < 1e-6 and abs(r["capacity_score"] - max(0.0, 100 - min(r["turnover"], 500) / 5)) < 1e-9
    assert {"coverage_below_45pct", "valid_stock_count_below_5", "no_real_trades", "test_ic_statistically_weak"} <= set(got[("late", 0)]["reasons"])
    assert got[("momentum", 0)]["trades"] > 0 and len({r["capacity_score"] for r in got.values()}) > 1


def test_rows_are_dealt_once_for_ranks(spark):
    """Ties are counted in the order of ranks: a value's rows are not sorted or dealt for them alone."""
    import re

    from tidemark.sources.panel import market_panel

    plan = mining.batch_metrics(market_panel(spark, "/root/testdata/sf0.001"), {"a": "pctchange(close, 4)", "b": "volume"})._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[factor#", plan)) <= 3 and not re.search(r"hashpartitioning\(factor#\d+, trade_date#\d+, (value|_fwd)", plan)
