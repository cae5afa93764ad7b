"""Ranks over growing histories and over whole tables, and lots, against brute force; and the shape of their plans."""

import random
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import registry
from tidemark.operators import lots, ranks
from tidemark.plans.compile import evaluate


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def history(seed, codes=4, days=150):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(f"s{k}", i, None if rng.random() < 0.05 else float(rng.integers(0, 20))) for k in range(codes) for i in range(days)], columns=["ts_code", "trade_date", "close"])


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "ts_code string, trade_date int, close double")


def test_ranks_of_growing_histories(spark, monkeypatch):
    monkeypatch.setattr(registry, "LONG", 5)
    pdf = history(1)
    got = evaluate(frame(spark, pdf), {"a": "rank(close)", "b": "ts_rank(close, 20)", "c": "ts_pct_rank(close, 20)"})
    assert "collect_list" not in plan_of(got)
    got = got.toPandas().sort_values(["ts_code", "trade_date"]).astype({"a": float, "b": float, "c": float})
    g = pdf.groupby("ts_code").close
    np.testing.assert_allclose(got["a"], g.expanding().rank(pct=True).to_numpy())
    np.testing.assert_allclose(got["b"], g.rolling(20).rank(pct=True, method="max").to_numpy())
    np.testing.assert_allclose(got["c"], g.rolling(20).rank(pct=True).to_numpy())


def test_short_windows_read_one_array(spark):
    pdf = history(2, 3, 60)
    got = evaluate(frame(spark, pdf), {"c": "ts_pct_rank(close, 9)"}).toPandas().sort_values(["ts_code", "trade_date"])
    np.testing.assert_allclose(got["c"].astype(float), pdf.groupby("ts_code").close.rolling(9).rank(pct=True).to_numpy())


def test_long_history(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ts_code": "x", "trade_date": np.arange(20_000), "close": rng.random(20_000)})
    got = evaluate(spark.createDataFrame(pdf), {"a": "rank(close)"}).toPandas().sort_values("trade_date")
    np.testing.assert_allclose(got["a"], pdf.close.expanding().rank(pct=True))


def test_percent_ranks(spark):
    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.1 else float(rng.choice([0, 0, 0, 1, 2, *range(50)])), float(rng.random())) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a double, b double").repartition(5)
    got = ranks.percent_ranks(df, {"ra": "a", "rb": "b"})
    pdf = got.toPandas().sort_values("i").reset_index(drop=True)
    np.testing.assert_allclose(pdf["ra"].astype(float), pdf["a"].astype(float).rank(pct=True))
    np.testing.assert_allclose(pdf["rb"], pdf["b"].rank(pct=True))
    # the only window without partitions is over the ranges, and it reads a row of each
    assert all("_part" in line for line in plan_of(got).splitlines() if line.strip(" :+-").startswith("Window") and "windowspecdefinition(_part" in line)
    empty = ranks.percent_ranks(df.limit(0), {"ra": "a"})
    assert empty.count() == 0


def queue_pnl(trades, last):
    """The rule itself, with a queue of lots."""
    out = {}
    for code in sorted({t[0] for t in trades}):
        q, realized, matched = deque(), 0.0, defaultdict(int)
        mine = sorted((t for t in trades if t[0] == code and t[4] and t[4] > 0 and t[5] and t[5] > 0), key=lambda t: (t[1], t[3] != "buy", t[2]))
        for no, (_, _, _, side, n, price, fee) in enumerate(mine, 1):
            if side == "buy":
                q.append([n, (n * price + fee) / n, no])
                continue
            left, cost = n, 0.0
            while left and q:
                k = min(left, q[0][0])
                cost += k * q[0][1]
                matched[q[0][2], no] += k
                q[0][0] -= k
                left -= k
                if not q[0][0]:
                    q.popleft()
            if left:
                matched[None, no] += left
            realized += n * price - fee - cost - left * price
        for n, _, no in q:
            matched[no, None] += n
        held, cost = sum(x[0] for x in q), sum(x[0] * x[1] for x in q)
        open_ = held * last[code] - cost if held and last.get(code, 0) > 0 else 0.0
        if mine:
            out[code] = (round(realized, 6), round(open_, 6), held, round(cost, 6)), dict(matched)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lots_against_a_queue(spark, seed):
    rng = random.Random(seed)
    trades = [(rng.choice(["a", "b", "c"]), f"2024-01-{rng.randint(1, 9):02d}", i, rng.choice(["buy", "sell", "sell"] if seed % 2 else ["buy", "buy", "sell"]), rng.choice([0, 1, 5, 100, 300]), rng.choice([0.0, 1.5, 2.25, 10.0]), float(rng.randint(0, 5))) for i in range(120)]
    last = {"a": 3.0, "b": 0.0}
    df = spark.createDataFrame(trades, "ts_code string, trade_date string, trade_no int, side string, shares int, price double, fees double").repartition(3)
    prices = spark.createDataFrame(list(last.items()), "ts_code string, last_price double")
    want = queue_pnl(trades, last)
    got = {r["ts_code"]: r for r in lots.stock_pnl(df, prices, 1e6).collect()}
    assert got.keys() == want.keys()
    for code, (numbers, _) in want.items():
        r = got[code]
        assert (r["realized_pnl"], r["unrealized_pnl"], r["ending_position"], r["ending_cost"]) == pytest.approx(numbers)
        assert r["total_pnl"] == pytest.approx(numbers[0] + numbers[1]) and r["contribution_pct"] == pytest.approx((numbers[0] + numbers[1]) / 1e4)
    pairs = defaultdict(dict)
    for r in lots.match_lots(lots._ordered(df)).collect():
        key = (r["buy_no"], r["sell_no"])
        pairs[r["ts_code"]][key] = pairs[r["ts_code"]].get(key, 0) + r["shares"]
    assert {c: p for c, (_, p) in want.items()} == dict(pairs)


def test_lots_of_one_busy_security(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("'x' AS ts_code", "id + 1 AS no", "CASE WHEN id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side", "1 + id % 7 AS shares")
    got = lots.match_lots(rows)
    assert "Join" not in plan_of(got)
    pieces = got.collect()
    assert sum(r["shares"] for r in pieces if r["buy_no"]) == sum(1 + i % 7 for i in range(0, n, 2)) and len(pieces) < 3 * n
    assert lots.match_lots(rows.limit(0)).count() == 0
