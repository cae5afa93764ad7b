"""Registered queries of the factor language: one per function or small family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import evaluate, to_sql
from ..sources.panel import COLUMNS, HISTORY, PANEL_SQL, market_panel

#: Query name: columns and their expressions.
EXPRESSIONS: dict[str, dict[str, str]] = {
    "panel_returns": {"ret": "returns"},
    "panel_vwap": {"v": "vwap"},
    "dsl_arithmetic": {"a": "(open + close) * 2 - high / low", "b": "-close ** 2", "c": "close / (open - open)"},
    "dsl_compare": {"a": "close > open", "b": "(close >= open) & (high > delay(high, 1)) | ~(low < delay(low, 1))", "c": "close == open ? 1 : 2"},
    "dsl_elementwise": {"a": "abs(close - open)", "l": "log(close)", "s": "sqrt(volume)", "g": "sign(close - open)", "f": "floor(close / 7)", "c": "ceil(close / 7)"},
    "dsl_round_power": {"r": "round_val(close / 1000, 1)", "p": "power(close / 100000, 1.5)", "n": "neg(close)"},
    "dsl_max_min": {"a": "max(open, close)", "b": "min(open, 150000)"},
    "dsl_clip": {"a": "clip(zscore(close, 10), -1, 1)"},
    "dsl_signedpower": {"a": "signedpower(close - open, 0.5)", "b": "signed_log(close - open)"},
    "dsl_where": {"a": "where(close > delay(close, 1), volume, 0)", "b": "ternary(close < open, 1, 0)"},
    "dsl_tr": {"a": "tr"},
    "dsl_dtm": {"a": "dtm", "b": "dbm"},
    "dsl_hd_ld": {"a": "hd", "b": "ld"},
    "dsl_fundamentals": {"a": "pe + pb", "b": "ps * turnover_rate", "c": "log(total_mv) - log(circ_mv)"},
    "dsl_mean": {"a": "mean(close, 10)", "b": "advm(volume, 20)"},
    "dsl_std": {"a": "std(close, 20)"},
    "dsl_sum": {"a": "sum(volume, 5)"},
    "dsl_ts_max": {"a": "ts_max(high, 15)"},
    "dsl_ts_min": {"a": "ts_min(low, 15)"},
    "dsl_delay": {"a": "delay(close, 3)"},
    "dsl_delta": {"a": "delta(close, 3)"},
    "dsl_pctchange": {"a": "pctchange(close, 5)"},
    "dsl_corr": {"a": "corr(close, volume, 12)", "b": "ts_corr_signed(high, low, 6)"},
    "dsl_cov": {"a": "signed_log(cov(close, volume, 10))"},
    "dsl_zscore": {"a": "zscore(close, 20)", "b": "vol_zscore(15)"},
    "dsl_cross": {"a": "cross_up(mean(close, 5), mean(close, 20))", "b": "cross_down(mean(close, 5), mean(close, 20))"},
    "dsl_count_true": {"a": "count_true(close > open, 10)"},
    "dsl_bars_since": {"a": "bars_since(close > 1.2 * delay(close, 1))"},
    "dsl_breakout": {"a": "breakout(close, 20)"},
    "dsl_drawdown": {"a": "drawdown_from_high(close, 30)"},
    "dsl_gap": {"a": "gap_pct()"},
    "dsl_efficiency": {"a": "efficiency_ratio(close, 10)"},
    "dsl_ts_rank": {"a": "ts_rank(close, 10)"},
    "dsl_ts_pct_rank": {"a": "ts_pct_rank(floor(close / 20000), 12)"},
    "dsl_argmax": {"a": "ts_argmax(close, 10)", "b": "ts_argmin(close, 10)"},
    "dsl_highday": {"a": "highday(high, 20)", "b": "lowday(low, 20)"},
    "dsl_wma": {"a": "wma(close, 10)", "b": "ts_decay(volume, 5)"},
    "dsl_decaylinear": {"a": "decaylinear(close, 10)"},
    "dsl_product": {"a": "ts_product(1 + returns, 5)"},
    "dsl_skew": {"a": "skew(close, 20)"},
    "dsl_kurt": {"a": "kurt(close, 20)"},
    "dsl_downside": {"a": "downside_std(returns, 20)", "b": "upside_std(returns, 20)"},
    "dsl_regbeta": {"a": "regbeta(close, volume, 20)"},
    "dsl_regresi": {"a": "regresi(volume, close, 15)"},
    "dsl_expanding_rank": {"a": "rank(close)", "b": "cs_percentile(volume)"},
    "dsl_expanding_zscore": {"a": "cs_zscore(close)", "b": "cs_demean(close)"},
    "dsl_scale": {"a": "scale(close)", "b": "sumac(volume)"},
    "dsl_sumif": {"a": "sumif(volume, close > open, 10)"},
    "dsl_ema": {"a": "ema(close, 12)", "b": "ewm(close, 12)", "c": "ic_ewm(close, 10)"},
    "dsl_sma": {"a": "sma(close, 6, 1)"},
    "dsl_macd": {"dif": "macd_dif(close)", "dea": "macd_dea(close)", "hist": "macd_hist(close, 6, 13, 5)"},
    "dsl_rsi": {"a": "rsi(close, 14)"},
    "dsl_winsorize": {"a": "winsorize(close, 0.05, 0.95)"},
    "xs_rank": {"a": "xs_rank(close)", "b": "xs_rank(floor(volume / 50))"},
    "xs_scale": {"a": "xs_scale(close - open)"},
    "xs_demean": {"a": "xs_demean(close)"},
    "xs_winsor_zscore": {"a": "xs_zscore(xs_rank(xs_winsor(close, 0.01, 0.99)))"},
    "xs_industry_residual": {"a": "xs_industry_residual(volume, log(total_mv))"},
    "dsl_nested": {"a": "xs_rank(corr(xs_rank(close), xs_rank(volume), 5)) - ts_pct_rank(xs_rank(delta(close, 2)), 5)"},
}


#: Dates go out as text, which all engines write alike.
KEEP = ("ts_code", "CAST(trade_date AS STRING) AS trade_date")


def query(expressions: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: evaluate(market_panel(spark, sf_dir), expressions, KEEP, bits=20, history=HISTORY)


def sql(expressions: dict[str, str]) -> str:
    return to_sql(f"({PANEL_SQL}) AS panel", COLUMNS, expressions, KEEP, bits=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: query(e) for k, e in EXPRESSIONS.items()} | {"panel_ohlcv": lambda s, d: market_panel(s, d).selectExpr("* EXCEPT (trade_date)", KEEP[1])}


def oracle_sql() -> dict[str, str]:
    return {k: sql(e) for k, e in EXPRESSIONS.items()} | {"panel_ohlcv": f"SELECT * EXCLUDE (trade_date), {KEEP[1]} FROM ({PANEL_SQL}) AS panel"}
