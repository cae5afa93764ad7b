"""The built-in factors: fifty named single-security expressions in ten categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import evaluate, to_sql
from ..sources.panel import COLUMNS, HISTORY, PANEL_SQL, market_panel
from .dsl_queries import KEEP

# Category of each factor and the expression that defines it.
FACTORS: dict[str, tuple[str, str]] = {
    "valuation_ep_ttm": ("basics", "1 / pe"),
    "valuation_bp": ("basics", "1 / pb"),
    "valuation_sp_ttm": ("basics", "1 / ps"),
    "valuation_low_circ_mv": ("basics", "-log(circ_mv)"),
    "valuation_low_total_mv": ("basics", "-log(total_mv)"),
    "growth_price_60": ("growth", "pctchange(close, 60)"),
    "growth_vwap_20": ("growth", "pctchange(vwap, 20)"),
    "growth_momentum_accel": ("growth", "pctchange(close, 20) - pctchange(delay(close, 20), 40)"),
    "growth_volume_price_confirm": ("growth", "pctchange(close, 20) * (mean(volume, 5) / mean(volume, 20))"),
    "quality_trend_smooth_60": ("quality", "abs(pctchange(close, 60)) / (std(returns, 60) * sqrt(60))"),
    "quality_price_stability_60": ("quality", "-std(returns, 60)"),
    "quality_downside_control_60": ("quality", "-std(where(returns < 0, returns, 0), 60)"),
    "quality_drawdown_control_60": ("quality", "-abs(drawdown_from_high(close, 60))"),
    "emotion_turnover_rate": ("emotion", "turnover_rate"),
    "emotion_turnover_surge_5_20": ("emotion", "mean(turnover_rate, 5) / mean(turnover_rate, 20)"),
    "emotion_volume_ratio_5_20": ("emotion", "mean(volume, 5) / mean(volume, 20)"),
    "emotion_upper_shadow_20": ("emotion", "mean((high - max(close, open)) / abs(close - open), 20)"),
    "risk_volatility_20": ("risk", "std(returns, 20)"),
    "risk_volatility_60": ("risk", "std(returns, 60)"),
    "risk_atr_14": ("risk", "mean(fill(tr, high - low), 14) / close"),
    "risk_max_drawdown_60": ("risk", "drawdown_from_high(close, 60)"),
    "pershare_float_share_proxy": ("pershare", "circ_mv / close"),
    "pershare_total_share_proxy": ("pershare", "total_mv / close"),
    "pershare_turnover_per_mv": ("pershare", "turnover_rate / log(circ_mv)"),
    "style_small_value": ("style", "-log(circ_mv) + 1 / pb"),
    "style_low_vol_value": ("style", "-std(returns, 60) + 1 / pb"),
    "style_momentum_low_vol": ("style", "pctchange(close, 60) - std(returns, 60)"),
    "style_liquidity_compensation": ("style", "-log(mean(amount, 20))"),
    "technical_rsi_14": ("technical", "rsi(close, 14)"),
    "technical_bias_20": ("technical", "(close - mean(close, 20)) / mean(close, 20)"),
    "technical_ma_position": ("technical", "(num_of(close > mean(close, 5)) + num_of(close > mean(close, 10)) + num_of(close > mean(close, 20)) + num_of(close > mean(close, 60))) / 4"),
    "technical_macd_diff": ("technical", "ema(close, 12) - ema(close, 26)"),
    "technical_boll_z_20": ("technical", "(close - mean(close, 20)) / std(close, 20)"),
    "technical_vwap_deviation_20": ("technical", "(close - mean(vwap, 20)) / mean(vwap, 20)"),
    "momentum_5": ("momentum", "pctchange(close, 5)"),
    "momentum_20": ("momentum", "pctchange(close, 20)"),
    "momentum_60": ("momentum", "pctchange(close, 60)"),
    "momentum_120": ("momentum", "pctchange(close, 120)"),
    "reversal_5": ("momentum", "-pctchange(close, 5)"),
    "reversal_20": ("momentum", "-pctchange(close, 20)"),
    "momentum_breakout_60": ("momentum", "(close - ts_min(low, 60)) / (ts_max(high, 60) - ts_min(low, 60))"),
    "volatility_20": ("risk", "std(returns, 20)"),
    "atr_14": ("risk", "mean(fill(tr, high - low), 14) / close"),
    "volume_ratio_5": ("emotion", "volume / mean(volume, 5)"),
    "volume_momentum": ("emotion", "mean(volume, 5) / mean(volume, 20)"),
    "rsi_14": ("technical", "rsi(close, 14)"),
    "bias_20": ("technical", "(close - mean(close, 20)) / mean(close, 20)"),
    "ma_position": ("technical", "(num_of(close > mean(close, 5)) + num_of(close > mean(close, 10)) + num_of(close > mean(close, 20)) + num_of(close > mean(close, 60))) / 4"),
    "high_low_range": ("technical", "mean((high - low) / close, 20)"),
    "upper_shadow": ("emotion", "mean((high - max(close, open)) / abs(close - open), 20)"),
}


def categories() -> list[str]:
    return sorted({c for c, _ in FACTORS.values()})


def _of(category: str) -> dict[str, str]:
    return {n: e for n, (c, e) in FACTORS.items() if c == category}


def factors(panel: DataFrame, names: list[str], bits: int | None = None) -> DataFrame:
    return evaluate(panel, {n: FACTORS[n][1] for n in names}, bits=bits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"builtin_{c}": (lambda spark, sf_dir, c=c: evaluate(market_panel(spark, sf_dir), _of(c), KEEP, 20, HISTORY)) for c in categories()}


def oracle_sql() -> dict[str, str]:
    return {f"builtin_{c}": to_sql(f"({PANEL_SQL}) AS panel", COLUMNS, _of(c), KEEP, 20) for c in categories()}
