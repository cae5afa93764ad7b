"""Relational queries a second time in pandas, over all securities and dates: no text is shared with the plans."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import relational
from tidemark.sources.panel import market_panel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    p = market_panel(spark, SF).toPandas().sort_values(["ts_code", "trade_date"], ignore_index=True)
    p["day"] = p["trade_date"].astype(str)
    by = p.groupby("ts_code")
    p["prev"] = by["close"].shift(1)
    p["r"] = p["close"] / p["prev"] - 1
    p["f"] = p["close"] / by["close"].shift(4) - 1
    p["fwd"] = by["close"].shift(-4) / p["close"] - 1
    return p


@pytest.fixture(scope="module")
def market(panel):
    return panel.dropna(subset="r").groupby("day")["r"].mean().sort_index()


@pytest.fixture(scope="module")
def signal(panel):
    s = panel.dropna(subset=["f", "fwd"]).copy()
    s["n"] = s.groupby("day")["f"].transform("size")
    s["rn"] = s.sort_values(["f", "ts_code"]).groupby("day").cumcount() + 1
    return s[s["n"] >= 5]


@pytest.fixture(scope="module")
def run(spark):
    def go(name, *keys):
        rows = [r.asDict() for r in relational.run(spark, SF, relational.QUERIES[name]).collect()]
        out = {tuple(r[k] for k in keys): tuple(v for c, v in sorted(r.items()) if c not in keys) for r in rows}
        assert len(out) == len(rows)
        return out

    return go


def same(got, want):
    """Equal keys; numbers within the twenty bits and nine decimals that are kept."""
    assert want and got.keys() == want.keys()
    for k, w in want.items():
        w = w if isinstance(w, tuple) else (w,)
        assert len(w) == len(got[k])
        for a, b in zip(got[k], w, strict=True):
            if b is None or isinstance(b, float) and np.isnan(b):
                assert a is None or np.isnan(a), k
            elif isinstance(b, str | bool | np.bool_):
                assert a == b, k
            else:
                assert abs(a - b) <= 2e-9 + 2e-6 * abs(b), (k, a, b)


def each(frame, *columns, key=("ts_code", "day")):
    return {tuple(getattr(t, k) for k in key): tuple(getattr(t, c) for c in columns) for t in frame.itertuples()}


def test_rank_and_board_ic(run, signal):
    want = {(d,): (g["f"].rank().corr(g["fwd"].rank()), len(g)) for d, g in signal.groupby("day")}
    same(run("rank_ic", "trade_date"), want)
    same(run("board_ic", "trade_date"), {(d,): g["f"].corr(g["fwd"]) for d, g in signal.groupby("day") if len(g) >= 10})
    ics = pd.Series({k: v[0] for k, v in want.items()}).dropna()
    same(run("ic_summary"), {(): (len(ics), ics.mean(), ics.std(), ics.mean() / ics.std(), (ics > 1e-9).mean(), ics.mean() / ics.std() * len(ics) ** 0.5)})


def test_groups(run, signal):
    size = np.maximum(1, signal["n"] // 5)
    g = signal.assign(g=np.minimum((signal["rn"] - 1) // size, 4))
    want = {(d, k): (len(x), x["fwd"].mean()) for (d, k), x in g.groupby(["day", "g"])}
    same(run("board_groups", "trade_date", "g"), want)
    spread = pd.Series({d: want[d, 4][1] - want[d, 0][1] for d in sorted(g["day"].unique())})
    same(run("longshort_curve", "trade_date"), {(d,): (x, t) for (d, x), t in zip(spread.items(), spread.cumsum(), strict=True)})
    edge = np.maximum(1, np.floor(signal["n"] * 0.1))
    side = np.where(signal["rn"] <= edge, "bottom", np.where(signal["rn"] > signal["n"] - edge, "top", ""))
    picked = signal.assign(side=side)
    got = {k: v for k, v in run("top_bottom_pct", "trade_date", "ts_code").items() if k[0] in set(signal["day"])}
    same(got, {k: v for k, v in each(picked[picked["side"] != ""], "side", key=("day", "ts_code")).items()})


def test_market_curve(run, market):
    v = (1 + market).cumprod()
    under = v / v.cummax() - 1
    same(run("underwater", "trade_date"), {(d,): x for d, x in under.items()})
    rf = 0.03 / 52
    low = market[market < rf] - rf
    n, lg = len(market), np.log1p(market).sum()
    names = {"log_total": lg, "log_annual": lg * 52 / n, "vol": market.std() * 52**0.5, "sharpe": (market.mean() - rf) / market.std() * 52**0.5, "sortino": (market.mean() - rf) / low.std() * 52**0.5, "max_drawdown": under.min(), "win_rate": (market > 0).mean(), "n": n}
    same(run("metrics"), {(): tuple(x for _, x in sorted(names.items()))})
    low = np.sort(market.to_numpy())
    k = int(np.floor(0.05 * n))
    same(run("var_cvar"), {(): (low[: max(k, 1)].mean(), low[k])})
    z = (market - market.mean()) / market.std()
    skew, kurt = (z**3).mean(), (z**4).mean() - 3
    same(run("moments"), {(): (n / 6 * (skew**2 + kurt**2 / 4), kurt, skew)})
    bins = np.minimum(np.floor((market - market.min()) / (market.max() - market.min()) * 50), 49).astype(int)
    same(run("histogram50", "bin"), {(b,): c for b, c in bins.value_counts().items()})
    sd, mu = market.rolling(20).std().dropna(), market.rolling(20).mean().dropna()
    same(run("rolling_risk", "trade_date"), {(d,): (mu[d] / sd[d] * 52**0.5, sd[d] * 52**0.5) for d in sd.index})


def test_returns_by_period(run, panel, market):
    months = {k: g["close"].iloc[-1] / g["close"].iloc[0] - 1 for k, g in panel.groupby(["ts_code", panel["day"].str[:7]])}
    same(run("monthly_returns", "ts_code", "month"), months)
    bench = {m: (1 + g).prod() - 1 for m, g in market.groupby(market.index.str[:7])}
    want = {k: (bench.get(k[1]), x - bench[k[1]] if k[1] in bench else None, x) for k, x in months.items()}
    same(run("monthly_excess", "ts_code", "month"), want)
    years = {(c, int(y)): round(g["close"].iloc[-1] / g["close"].iloc[0] - 1, 6) for (c, y), g in panel.groupby(["ts_code", panel["day"].str[:4]])}
    same(run("annual_returns", "ts_code", "y"), years)


def test_alpha_beta(run, panel, market):
    want = {}
    for c, g in panel.dropna(subset="r").groupby("ts_code"):
        b = market.loc[g["day"]].to_numpy()
        r = g["r"].to_numpy()
        beta = np.cov(r, b)[0, 1] / np.var(b, ddof=1)
        want[c,] = (r.mean() - beta * b.mean(), beta, (r - b).mean() / np.std(r - b, ddof=1))
    same(run("alpha_beta", "ts_code"), want)


def test_quality(run, panel):
    days = panel["day"].nunique()
    by = panel.groupby("ts_code")
    status = lambda n: "error" if n > 0.3 * days else "warning" if n > 0.05 * days else "clean"
    same(run("quality_missing", "ts_code"), {(c,): (days - n, status(days - n)) for c, n in by.size().items()})
    jumps = panel[panel["r"].abs() > 0.11].groupby("ts_code").size()
    same(run("quality_extremes", "ts_code"), {(c,): n for c, n in jumps.items()})
    flat = (panel[["open", "high", "low"]].eq(panel["close"], axis=0)).all(axis=1).groupby(panel["ts_code"]).sum()
    empty = (panel["volume"] == 0).groupby(panel["ts_code"]).sum()
    same(run("quality_suspension", "ts_code"), {(c,): (flat[c], empty[c]) for c in flat.index})
    stuck, under = {}, {}
    for c, g in by:
        longest = here = deep = below = 0
        peak = last = None
        for x in g["close"]:
            here = here + 1 if x == last else 1
            below = 0 if peak is None or x >= peak else below + 1
            peak, last = x if peak is None else max(x, peak), x
            longest, deep = max(longest, here), max(deep, below)
        stuck[c,], under[c,] = (longest, "warning" if longest >= 5 else "clean"), deep
    same(run("quality_sticking", "ts_code"), stuck)
    same(run("drawdown_duration", "ts_code"), under)


def test_sticking_of_planted_prices(spark):
    """The test tables have no price that stays."""
    closes = {"A": [5, 5, 5, 5, 5, 6], "B": [5, 5, 5, 5, 6, 5], "C": [1, 2, 2, 3, 3, 3], "D": [7]}
    rows = [(c, pd.Timestamp("2020-01-06").date() + pd.Timedelta(days=7 * i), float(x)) for c, xs in closes.items() for i, x in enumerate(xs)]
    text = relational.QUERIES["quality_sticking"].replace("FROM panel", "FROM {panel}")
    got = spark.sql(text, panel=spark.createDataFrame(rows, "ts_code string, trade_date date, close double")).collect()
    assert {tuple(r) for r in got} == {("A", 5, "warning"), ("B", 4, "clean"), ("C", 3, "clean"), ("D", 1, "clean")}


def test_signals(run, panel):
    by = panel.groupby("ts_code")
    roll = lambda c, n, how: by[c].transform(lambda x: getattr(x.rolling(n), how)())
    m, sd = roll("close", 20, "mean"), roll("close", 20, "std")
    z = (panel["close"] - m) / sd
    want = panel.assign(z=z, side=np.where(z < -1, "buy", np.where(z > 0, "sell", "hold")))[m.notna()]
    same(run("signal_mean_reversion", "ts_code", "trade_date"), each(want, "side", "z"))
    up, down = panel["close"] > m + 2 * sd, panel["close"] < m
    same(run("signal_bollinger", "ts_code", "trade_date"), each(panel.assign(side=np.where(up, "buy", "sell"))[m.notna() & (up | down)], "side"))
    hi = by["high"].transform(lambda x: x.rolling(20).max().shift(1))
    lo = by["low"].transform(lambda x: x.rolling(10).min().shift(1))
    out = hi.notna() & ((panel["close"] > hi) | (panel["close"] < lo))
    same(run("signal_turtle", "ts_code", "trade_date"), each(panel.assign(side=np.where(panel["close"] > hi, "buy", "sell"))[out], "side"))


def test_scans(run, panel):
    top = panel.sort_values(["amount", "ts_code"], ascending=[False, True])
    k = top.groupby("day").cumcount() + 1
    same(run("top_holdings", "trade_date", "ts_code"), each(top.assign(k=k)[k <= 10], "k", key=("day", "ts_code")))
    same(run("last_rows", "ts_code", "trade_date"), each(panel.groupby("ts_code").tail(5), "close"))
    a = panel["amount"] / 100
    want = panel.assign(c=np.maximum(a * 0.0003, 5.0), s=panel["volume"] * 0.002, t=a * 0.001, u=a * 0.00002)
    same(run("trading_costs", "ts_code", "trade_date"), each(want, "c", "s", "t", "u"))
    many, few = set(panel.loc[panel["volume"] > 60, "ts_code"]), set(panel.loc[panel["volume"] < 10, "ts_code"])
    same(run("set_operations", "kind"), {("both",): len(many & few), ("first",): len(many - few)})
    same(run("batch_summary", "industry"), {(i,): (g["ts_code"].nunique(), g["day"].min(), g["close"].max(), g["day"].max()) for i, g in panel.groupby("industry")})
    want = {}
    dates = sorted(panel["day"].unique())
    for c, g in panel.groupby("ts_code"):
        own, gap = set(g["day"]), []
        for d in [d for d in dates if min(own) <= d <= max(own)]:
            if d not in own:
                gap.append(d)
            elif gap:
                want[c, gap[0]], gap = (len(gap), gap[-1]), []
    same(run("calendar_gaps", "ts_code", "first_day"), want)


def test_turnover_and_weights(run, signal):
    g = signal.assign(g=np.minimum((signal["rn"] - 1) // np.maximum(1, signal["n"] // 5), 4))
    days = sorted(g["day"].unique())
    held = {(i + 1, k): set(x["ts_code"]) for i, d in enumerate(days) for k, x in g[g["day"] == d].groupby("g")}
    want = {(i, k): 1 - len(s & held[i - 1, k]) / len(s | held[i - 1, k]) for (i, k), s in held.items() if (i - 1, k) in held}
    same(run("evaluate_turnover", "date_no", "g"), want)
    moves = {}
    for i in range(1, len(days) + 2):
        new, old = held.get((i, 4), set()), held.get((i - 1, 4), set())
        d = [(c in new) / max(len(new), 1) - (c in old) / max(len(old), 1) for c in new | old]
        moves[i,] = (sum(x for x in d if x > 0), -sum(x for x in d if x < 0))
    same(run("weight_turnover", "date_no"), moves)
    ics = pd.DataFrame([(d[:4], x["f"].rank().corr(x["fwd"].rank())) for d, x in signal.groupby("day")], columns=["y", "ic"]).groupby("y")["ic"].mean().abs()
    same(run("ic_weights", "y"), {(y,): v for y, v in (ics / ics.sum()).items()})


def test_neutral_and_filled(run, panel):
    want = {}
    for d, x in panel.groupby("day"):
        if len(x) >= 5:
            cap = np.log(x["total_mv"])
            y, m = x["volume"] - x.groupby("industry")["volume"].transform("mean"), cap - cap.groupby(x["industry"]).transform("mean")
            slope = (y * m).sum() / (m * m).sum() if round((m * m).sum(), 12) else 0.0
            want |= {(c, d): v for c, v in zip(x["ts_code"], y - m * slope, strict=True)}
    got = run("xs_ols_neutral", "ts_code", "trade_date")
    assert want and got.keys() == want.keys() and max(abs(got[k][0] - v) for k, v in want.items()) < 1e-3
    known = panel["turnover_rate"].where(panel["volume"].astype(int) % 3 == 0).groupby(panel["ts_code"]).ffill()
    same(run("asof_ffill", "ts_code", "trade_date"), each(panel.assign(filled=known), "filled"))


def test_portfolio_and_samples(run, panel, market):
    iv = 1 / panel.groupby("ts_code")["r"].var()
    w = iv / iv.sum()
    r = panel.dropna(subset="r").assign(x=lambda t: t["r"] * t["ts_code"].map(w)).groupby("day")["x"].sum().sort_index()
    same(run("portfolio_sim", "trade_date"), {(d,): (v, x) for d, v, x in zip(r.index, np.log1p(r).cumsum(), r, strict=True)})
    v = (1 + market).cumprod()
    step = int(np.ceil(len(v) / 260))
    same(run("curve_downsample", "trade_date"), {(d,): x for i, (d, x) in enumerate(v.items()) if i % step == 0 or i == len(v) - 1})
    prev = panel[panel["prev"].notna()].copy()
    digits = prev["ts_code"].str[4:6].astype(int) % 10
    prev["pct"] = np.where(digits == 7, 5, np.where(digits == 3, 20, 10))
    prev["up"], prev["down"] = np.floor(prev["prev"] * (100 + prev["pct"]) / 100 + 0.5), np.floor(prev["prev"] * (100 - prev["pct"]) / 100 + 0.5)
    want = prev.assign(b=prev["open"] >= prev["up"], s=prev["open"] <= prev["down"])
    same(run("price_limits", "ts_code", "trade_date"), each(want, "b", "down", "pct", "s", "up"))


FAULTS = [
    ("quality_extremes", "0.11D", "0.15D"), ("quality_sticking", "count(1) AS n", "count(1) + 1 AS n"), ("signal_bollinger", "2 * sd", "1.9D * sd"), ("signal_turtle", "AND 1 PRECEDING", "AND CURRENT ROW"),
    ("top_holdings", "amount DESC", "volume DESC"), ("monthly_returns", "max_by(close, trade_date)", "max(close)"), ("var_cvar", "0.05D", "0.06D"), ("alpha_beta", "lag(close, 1)", "lag(close, 2)"), ("trading_costs", "0.0003D", "0.0004D"),
]
TESTS = {"quality_extremes": test_quality, "quality_sticking": test_quality, "signal_bollinger": test_signals, "signal_turtle": test_signals, "top_holdings": test_scans, "trading_costs": test_scans}


@pytest.mark.parametrize(("name", "right", "wrong"), FAULTS)
def test_planted_faults_are_seen(name, right, wrong, run, panel, market, monkeypatch):
    text = relational.QUERIES[name]
    assert right in text
    monkeypatch.setitem(relational.QUERIES, name, text.replace(right, wrong))
    with pytest.raises(AssertionError):
        if name in TESTS:
            TESTS[name](run, panel)
        elif name == "var_cvar":
            test_market_curve(run, market)
        elif name == "alpha_beta":
            test_alpha_beta(run, panel, market)
        else:
            test_returns_by_period(run, panel, market)
