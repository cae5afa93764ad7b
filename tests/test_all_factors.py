"""Every alpha, built-in factor and function of the language against numpy: a second evaluator of the
formulas over arrays of dates by securities, which shares no text with the plans. Windows are looked at
one by one, so nothing is carried from one to the next."""

import numpy as np
import pandas as pd
import pytest
from numpy.lib.stride_tricks import sliding_window_view

from tidemark.functions.registry import FUNCTIONS, MACROS
from tidemark.operators.alphas import FORMULAS
from tidemark.operators.builtin import FACTORS
from tidemark.plans.ast import parse
from tidemark.plans.compile import evaluate

DATES, CODES, INDUSTRIES = 300, 10, 3
NAN = np.nan


@pytest.fixture(scope="module")
def cube():
    rng = np.random.default_rng(5)
    shape = (DATES, CODES)
    close = 20 * np.exp(np.cumsum(rng.normal(0, 0.02, shape), axis=0))
    open_ = close * np.exp(rng.normal(0, 0.01, shape))
    volume = np.floor(rng.uniform(1e4, 9e4, shape))
    high, low = np.maximum(open_, close) * (1 + rng.uniform(0.001, 0.02, shape)), np.minimum(open_, close) * (1 - rng.uniform(0.001, 0.02, shape))
    more = {c: rng.uniform(1, 50, shape) for c in ("pe", "pb", "ps", "turnover_rate")} | {c: rng.uniform(1e5, 9e5, shape) for c in ("circ_mv", "total_mv")}
    more["pe"][rng.random(shape) < 0.1] = NAN
    return {"open": open_, "high": high, "low": low, "close": close, "volume": volume, "amount": volume * (high + low + close) / 3} | more


@pytest.fixture(scope="module")
def panel(spark, cube):
    days = np.repeat(pd.date_range("2023-01-02", periods=DATES, freq="B").date, CODES)
    df = pd.DataFrame({"ts_code": [f"6000{k:02d}.SH" for k in range(CODES)] * DATES, "trade_date": days, "industry": [f"I{k % INDUSTRIES}" for k in range(CODES)] * DATES} | {c: v.ravel() for c, v in cube.items()})
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "ts_code string, trade_date date, industry string, " + ", ".join(f"{c} double" for c in cube)).cache()


# --- the second evaluator ---------------------------------------------------


def shift(x, n):
    out = np.full(x.shape, NAN)
    if n > 0:
        out[n:] = x[:-n]
    elif n < 0:
        out[:n] = x[-n:]
    else:
        out[:] = x
    return out


def windows(x, n):
    return sliding_window_view(np.concatenate([np.full((n - 1, x.shape[1]), NAN), x]), n, axis=0)


def rolled(f):
    def run(x, n):
        w = windows(x, n)
        return np.where(np.isnan(w).any(-1), NAN, f(np.nan_to_num(w)))

    return run


def over(a, b):
    return a / np.where(b == 0, NAN, b)


def averaged(values, last):
    return (values < last).sum(-1) + ((values == last).sum(-1) + 1) / 2


def coarse(x):
    return x * 131073.0 - (x * 131073.0 - x)


def by_date(x):
    return pd.DataFrame(coarse(x)).rank(axis=1, pct=True).to_numpy()


def power(a, b):
    a, b = np.broadcast_arrays(a, b)
    ok = ((a > 0) | (a < 0) & (b == np.floor(b))) & (np.abs(b * np.log(np.abs(np.where(a == 0, NAN, a)))) < 700)
    return np.select([ok, (a == 0) & (b > 0), (a == 0) & (b == 0)], [np.power(np.where(ok, a, 1.0), b), 0.0, 1.0], NAN)


def signed_power(a, b):
    a, b = np.broadcast_arrays(a, b)
    ok = np.abs(b * np.log(np.abs(np.where(a == 0, NAN, a)))) < 700
    return np.where((a == 0) & (b > 0), a, np.where(ok, np.sign(a) * np.power(np.abs(np.where(ok, a, 1.0)), b), NAN))


def pair(f):
    def run(a, b, n):
        a, b = np.broadcast_arrays(a, b)
        gone = np.isnan(a) | np.isnan(b)
        x, y = windows(np.where(gone, NAN, a), n), windows(np.where(gone, NAN, b), n)
        return np.where(np.isnan(x).any(-1), NAN, f(np.nan_to_num(x), np.nan_to_num(y)))

    return run


def moves(x):
    return x.std(-1) > 1e-9 * (1e-9 + np.abs(x.mean(-1)))


def joint(x, y):
    return ((x - x.mean(-1, keepdims=True)) * (y - y.mean(-1, keepdims=True))).mean(-1)


def correlation(x, y):
    ok = moves(x) & moves(y)
    return np.where(ok, np.round(np.clip(joint(x, y) / np.where(ok, x.std(-1) * y.std(-1), 1.0), -1, 1), 9), NAN)


def covariance(x, y):
    c = joint(x, y) * x.shape[-1] / (x.shape[-1] - 1)
    return np.where(moves(x) & moves(y) & (np.abs(c) > 1e-12 * x.std(-1) * y.std(-1)), c, 0.0)


def slope(x, y):
    return over(joint(x, y) * x.shape[-1] / (x.shape[-1] - 1), x.var(-1))


def skewness(x):
    n, d = x.shape[-1], x - x.mean(-1, keepdims=True)
    return np.sqrt(n * (n - 1)) / (n - 2) * over((d**3).mean(-1), (d**2).mean(-1) ** 1.5)


def excess(x):
    n, d = x.shape[-1], x - x.mean(-1, keepdims=True)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (over((d**4).mean(-1), (d**2).mean(-1) ** 2) - 3) + 6)


def recursion(x, a, normalised=False):
    out = np.full(x.shape, NAN)
    for c in range(x.shape[1]):
        y = w = None
        for t in range(len(x)):
            if not np.isnan(x[t, c]):
                if normalised:
                    y, w = (x[t, c], 1.0) if y is None else (x[t, c] + (1 - a) * y, 1 + (1 - a) * w)
                    out[t, c] = y / w
                else:
                    y = x[t, c] if y is None else a * x[t, c] + (1 - a) * y
                    out[t, c] = y
    return out


def so_far(f, least=1):
    def run(x):
        out = np.full(x.shape, NAN)
        for c in range(x.shape[1]):
            for t in range(len(x)):
                seen = x[: t + 1, c][~np.isnan(x[: t + 1, c])]
                if not np.isnan(x[t, c]) and len(seen) >= least:
                    out[t, c] = f(seen)
        return out

    return run


def since(c):
    out = np.full(c.shape, NAN)
    for t in range(len(c)):
        out[t] = np.where(c[t], 0, out[t - 1] + 1 if t else NAN)
    return out


def clip_at(x, lo, hi, axis):
    return np.clip(x, np.nanquantile(x, lo, axis=axis, keepdims=True), np.nanquantile(x, hi, axis=axis, keepdims=True))


def in_industry(x):
    out = np.empty(x.shape)
    for k in range(INDUSTRIES):
        part = x[:, k::INDUSTRIES]
        out[:, k::INDUSTRIES] = part - np.nanmean(part, axis=1, keepdims=True)
    return out


def residual(y, x):
    gone = np.isnan(x) | np.isnan(y)
    y, x = in_industry(np.where(gone, NAN, y)), in_industry(np.where(gone, NAN, x))
    return y - x * np.nansum(x * y, axis=1, keepdims=True) / np.nansum(x * x, axis=1, keepdims=True)


def known(f):
    return lambda a, b: np.where(np.isnan(a) | np.isnan(b), NAN, f(a, b))


def deviation(x, n, ddof=1):
    return rolled(lambda w: w.std(-1, ddof=ddof))(x, n)


def mean(x, n):
    return rolled(lambda w: w.mean(-1))(x, n)


def total(x, n):
    return rolled(lambda w: w.sum(-1))(x, n)


def top(x, n):
    return rolled(lambda w: w.max(-1))(x, n)


def ema(x, n):
    return recursion(x, 2 / (n + 1))


def macd(x, a=12, b=26):
    return ema(x, a) - ema(x, b)


def rsi(x, n=14):
    d = x - shift(x, 1)
    return 100 - 100 / (1 + over(mean(np.maximum(d, 0), n), mean(np.maximum(-d, 0), n)))


def weighted(rising):
    return rolled(lambda w: w @ (np.arange(1, w.shape[-1] + 1)[:: 1 if rising else -1] / (w.shape[-1] * (w.shape[-1] + 1) / 2)))


def side(keep):
    return lambda x, n: deviation(np.where(np.isnan(x), NAN, np.where(keep(x), x, 0.0)), n)


OPS = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": over, "neg": np.negative, "abs": np.abs, "sign": np.sign, "floor": np.floor, "ceil": np.ceil,
    "<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "==": np.equal, "!=": lambda a, b: (a != b) & ~np.isnan(a) & ~np.isnan(b),
    "&": np.logical_and, "|": np.logical_or, "not": np.logical_not, "num_of": lambda c: c.astype(float), "where": np.where, "fill": lambda a, b: np.where(np.isnan(a), b, a),
    "log": lambda x: np.round(np.log(np.where(x > 0, x, NAN)), 12), "sqrt": lambda x: np.sqrt(np.where(x >= 0, x, NAN)), "power": power, "**": power, "signedpower": signed_power,
    "signed_log": lambda x: np.sign(x) * np.log1p(np.abs(x)), "max": known(np.maximum), "min": known(np.minimum), "clip": lambda x, lo=-3.0, hi=3.0: np.clip(x, lo, hi), "round_val": lambda x, k=0: np.round(x, k),
    "delay": shift, "delta": lambda x, n: x - shift(x, n), "pctchange": lambda x, n: over(x, shift(x, n)) - 1, "mean": mean, "sum": total, "std": deviation, "ts_max": top, "ts_min": rolled(lambda w: w.min(-1)),
    "zscore": lambda x, n: over(x - mean(x, n), deviation(x, n)), "breakout": lambda x, n: x > shift(top(x, n), 1), "drawdown_from_high": lambda x, n: over(x, top(x, n)) - 1, "bars_since": since,
    "count_true": lambda c, n: total(c.astype(float), n), "sumif": lambda x, c, n: total(np.where(np.isnan(x), NAN, np.where(c, x, 0.0)), n), "cumsum": lambda x: np.where(np.cumsum(~np.isnan(x), 0) > 0, np.nancumsum(x, 0), NAN),
    "cross_up": lambda a, b: (a > b) & (shift(a, 1) <= shift(b, 1)), "cross_down": lambda a, b: (a < b) & (shift(a, 1) >= shift(b, 1)),
    "corr": pair(correlation), "cov": pair(covariance), "regbeta": pair(slope), "regresi": lambda a, b, n: b - (mean(b, n) - pair(slope)(a, b, n) * mean(a, n)) - pair(slope)(a, b, n) * a,
    "skew": rolled(skewness), "kurt": rolled(excess), "downside_std": side(lambda x: x < 0), "upside_std": side(lambda x: x > 0),
    "ts_rank": rolled(lambda w: (w <= w[..., -1:]).mean(-1)), "ts_pct_rank": rolled(lambda w: averaged(w, w[..., -1:]) / w.shape[-1]), "ts_argmax": rolled(lambda w: w.argmax(-1)), "ts_argmin": rolled(lambda w: w.argmin(-1)),
    "highday": rolled(lambda w: w.shape[-1] - 1.0 - w.argmax(-1)), "lowday": rolled(lambda w: w.shape[-1] - 1.0 - w.argmin(-1)), "ts_product": rolled(lambda w: w.prod(-1)), "wma": weighted(True), "decaylinear": weighted(False),
    "ema": ema, "sma": lambda x, n, m: recursion(x, m / n), "ewm": lambda x, n: recursion(x, 2 / (n + 1), True), "ic_ewm": lambda x, n: recursion(x, 1 - 0.5 ** (2 / n), True), "macd_dif": macd, "macd_dea": lambda x: ema(macd(x), 9), "macd_hist": lambda x: macd(x) - ema(macd(x), 9),
    "rsi": rsi, "efficiency_ratio": lambda x, n: over(np.abs(x - shift(x, n)), total(np.abs(x - shift(x, 1)), n)),
    "rank": so_far(lambda s: averaged(s, s[-1]) / len(s)), "cs_zscore": lambda x: np.nan_to_num(so_far(lambda s: (s[-1] - s.mean()) / (s.std(ddof=1) or NAN), 2)(x)), "cs_demean": so_far(lambda s: s[-1] - s.mean()), "scale": so_far(lambda s: s[-1] / np.abs(s).sum()),
    "prior_rank": lambda x: np.broadcast_to(np.arange(1.0, len(x) + 1)[:, None], x.shape), "winsorize": lambda x, lo=0.01, hi=0.99: clip_at(x, lo, hi, 0),
    "xs_rank": by_date, "xs_demean": lambda x: x - np.nanmean(x, axis=1, keepdims=True), "xs_scale": lambda x: x / (np.nansum(np.abs(x), axis=1, keepdims=True) + 1e-10), "xs_zscore": lambda x: (x - np.nanmean(x, axis=1, keepdims=True)) / np.nanstd(x, axis=1, keepdims=True),
    "xs_winsor": lambda x, lo=0.01, hi=0.99: clip_at(x, lo, hi, 1), "xs_industry_demean": in_industry, "xs_industry_residual": residual,
}
OPS |= {"ternary": OPS["where"], "cs_rank": OPS["rank"], "cs_percentile": OPS["rank"], "SignedPower": signed_power, "advm": mean, "ts_corr_signed": OPS["corr"], "count": OPS["count_true"], "sumac": OPS["cumsum"], "Ts_ArgMax": OPS["ts_argmax"],
        "Ts_ArgMin": OPS["ts_argmin"], "product": OPS["ts_product"], "ts_decay": OPS["wma"], "indneutralize": OPS["cs_demean"], "IndNeutralize": OPS["cs_demean"]}
VARIABLES = {
    "vol": "volume", "returns": "pctchange(close, 1)", "vwap": "amount / volume", "hd": "high - delay(high, 1)", "ld": "delay(low, 1) - low",
    "dtm": "where(open > delay(open, 1), max(high - open, open - delay(open, 1)), 0)", "dbm": "where(open < delay(open, 1), max(open - low, open - delay(open, 1)), 0)",
    "tr": "max(high - low, max(abs(delay(close, 1) - high), abs(delay(close, 1) - low)))",
}
#: Steps of the plans' own, which the exponential means are written with.
INNER = {"decayed_pair", "decayed_ema", "decayed_mean", "xs_slope_residual"}


def value(node, cube, known_):
    key = str(node)
    if key not in known_:
        if node.op == "num":
            return float(node.value) if node.value != int(node.value) else int(node.value)
        if node.op == "var":
            known_[key] = cube[node.value] if node.value in cube else value(parse(VARIABLES[node.value]), cube, known_)
        else:
            args = [value(a, cube, known_) for a in node.args]
            if node.op in FUNCTIONS and not FUNCTIONS[node.op].params or node.op in ("+", "-", "*", "/"):
                args = [np.full((DATES, CODES), float(a)) if isinstance(a, (int, float)) else a for a in args]
            with np.errstate(all="ignore"):
                known_[key] = OPS[node.op](*args)
    return known_[key]


def compare(panel, cube, expressions, most=1e-7):
    got = evaluate(panel, expressions).toPandas().sort_values(["trade_date", "ts_code"])
    seen, wrong = {}, {}
    for name, e in expressions.items():
        want, have = np.asarray(value(parse(e), cube, seen), float), got[name].to_numpy(float).reshape(DATES, CODES)
        bad = (np.isnan(want) != np.isnan(have)) | (np.abs(want - have) > most * (1 + np.abs(want)))
        if bad.any():
            t, c = np.argwhere(bad)[0]
            wrong[name] = (int(bad.sum()), float(want[t, c]), float(have[t, c]), int(t))
        assert (~np.isnan(want)).sum() >= CODES, name
    assert not wrong, wrong


@pytest.mark.parametrize("first", range(1, 192, 48))
def test_alphas(panel, cube, first):
    compare(panel, cube, {f"a{n}": FORMULAS[n] for n in range(first, min(first + 48, 192))})


def test_builtin(panel, cube):
    compare(panel, cube, {n: e for n, (_, e) in FACTORS.items()})


WINDOWED = "mean advm sum std ts_max ts_min zscore drawdown_from_high skew kurt downside_std upside_std ts_rank ts_pct_rank ts_argmax Ts_ArgMax ts_argmin Ts_ArgMin highday lowday wma ts_decay decaylinear ema ewm ic_ewm rsi efficiency_ratio delay delta pctchange".split()
PLAIN = "abs neg sign log sqrt floor ceil signed_log rank cs_rank cs_percentile cs_zscore cs_demean indneutralize IndNeutralize scale prior_rank xs_rank xs_demean xs_scale xs_zscore xs_winsor winsorize cumsum sumac clip round_val xs_industry_demean macd_dif macd_dea macd_hist".split()
PAIRS = "corr ts_corr_signed cov regbeta regresi".split()
OTHERS = {
    "power": "power(close / 20, -1.5) + (close / 20) ** 2", "signedpower": "signedpower(returns, 0.5) + SignedPower(returns, 2)", "max": "max(pe, close) + min(pe, 9)", "where": "where(pe > close, pe, close) + ternary(pe != 3, 1, 2)", "fill": "fill(pe, 0)",
    "num_of": "num_of((close > open) & ~(pe < 20) | (high <= 20)) + num_of(close == close) + num_of(low >= 20)", "count_true": "count_true(close > open, 7) + count(pe > 20, 5)", "sumif": "sumif(close, pe > 20, 7)", "bars_since": "bars_since(close > ts_max(delay(close, 1), 20))",
    "cross": "num_of(cross_up(close, mean(close, 5))) - num_of(cross_down(close, mean(close, 5)))", "breakout": "num_of(breakout(close, 20))", "sma": "sma(close, 7, 2)", "product": "ts_product(1 + returns, 5) + product(close / open, 5)", "gap": "gap_pct()", "vol_zscore": "vol_zscore(20)",
    "residual": "xs_industry_residual(returns, pe)", "vars": "dtm + dbm + tr + hd + ld + vol + vwap",
}


def test_every_function(panel, cube):
    batch = {f"w_{n}": f"{n}(returns, 9)" for n in WINDOWED} | {f"n_{n}": f"{n}(pe, 5)" for n in ("mean", "ts_max", "ema", "ewm", "std")}
    batch |= {f"p_{n}": f"{n}(returns)" for n in PLAIN} | {f"c_{n}": f"{n}(returns, delta(volume, 1) / 10000, 9)" for n in PAIRS} | {f"g_{n}": f"{n}(pe, close, 4)" for n in PAIRS} | {f"o_{n}": e for n, e in OTHERS.items()}
    OPS["gap_pct"], OPS["vol_zscore"] = lambda: over(cube["open"], shift(cube["close"], 1)) - 1, lambda n: OPS["zscore"](cube["volume"], n)
    text = " ".join(batch.values())
    names = (set(FUNCTIONS) | set(MACROS)) - INNER
    assert not [n for n in names if n[0].isalpha() and n != "not" and f"{n}(" not in text]
    compare(panel, cube, batch, 1e-6)
