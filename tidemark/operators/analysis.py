"""Metrics of return series, portfolio weights, pattern match, and cleaning of texts and codes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.panel import market_panel
from . import handmade


def calc_metrics(returns: DataFrame, keys: list[str], time: str, value: str, benchmark: str, riskless: float = 0.03, year: int = 252) -> DataFrame:
    """One row per key with the metrics of its returns by date, in percent where they are returns: total_return,
    annual_return, annual_volatility, sharpe_ratio, max_drawdown, max_drawdown_duration, sortino_ratio,
    calmar_ratio, win_rate (share of dates that gain), profit_loss_ratio, alpha, beta, information_ratio.
    Null, NaN and infinite returns are 0; what cannot be computed is 0."""
    clean = lambda c: F.when(F.abs(F.nanvl(c, F.lit(None).cast("double"))) < float("inf"), c).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = returns.select(*keys, time, clean(F.col(value)).alias("r"), clean(F.col(benchmark)).alias("b"))
    x = x.withColumn("v", F.product(1 + F.col("r")).over(so_far))
    x = x.withColumn("dd", F.col("v") / F.max("v").over(so_far) - 1).withColumn("top", F.sum((F.col("dd") >= 0).cast("int")).over(so_far))
    x = x.withColumn("run", F.sum((F.col("dd") < 0).cast("int")).over(Window.partitionBy(*keys, "top").orderBy(time)))
    rf = riskless / year
    below = F.when(F.col("r") < rf, F.col("r") - rf)
    s = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("v", time).alias("end"), F.avg("r").alias("mu"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"), F.least(F.min("dd"), F.lit(0.0)).alias("mdd"), F.max("run").alias("duration"),
        F.coalesce(F.stddev_samp(below), F.lit(0.0)).alias("down"), F.avg((F.col("r") > 0).cast("double")).alias("win"), F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("gain"), F.abs(F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("loss"),
        F.avg("b").alias("mb"), F.coalesce(F.try_divide(F.covar_samp("r", "b"), F.when(F.var_samp("b") > 1e-12, F.var_samp("b"))), F.lit(0.0)).alias("beta"), F.coalesce(F.stddev_samp(F.col("r") - F.col("b")), F.lit(0.0)).alias("te"))
    ratio = lambda a, b, least=1e-12: F.when(b > least, a / b).otherwise(0.0)
    annual = F.when(F.col("end") > 0, F.pow(F.col("end"), year / F.col("n")) - 1).otherwise(0.0)
    c = F.col
    return s.select(
        *keys, F.round((c("end") - 1) * 100, 2).alias("total_return"), F.round(annual * 100, 2).alias("annual_return"), F.round(c("sd") * math.sqrt(year) * 100, 2).alias("annual_volatility"), F.round(ratio(c("mu") - rf, c("sd")) * math.sqrt(year), 4).alias("sharpe_ratio"),
        F.round(c("mdd") * 100, 2).alias("max_drawdown"), F.coalesce("duration", F.lit(0)).cast("long").alias("max_drawdown_duration"), F.round(ratio(c("mu") - rf, c("down")) * math.sqrt(year), 4).alias("sortino_ratio"), F.round(ratio(annual, -c("mdd"), 0.0), 4).alias("calmar_ratio"),
        F.round(c("win") * 100, 2).alias("win_rate"), F.round(F.coalesce(ratio(c("gain"), c("loss"), 0.0), F.lit(0.0)), 4).alias("profit_loss_ratio"), F.round((c("mu") - rf - c("beta") * (c("mb") - rf)) * year * 100, 2).alias("alpha"), F.round(c("beta"), 4).alias("beta"), F.round(ratio(c("mu") - c("mb"), c("te")) * math.sqrt(year), 4).alias("information_ratio"))


# --- portfolio weights -----------------------------------------------------


def moments(returns: DataFrame, asset: str = "asset", time: str = "trade_date", value: str = "r") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, mean returns and covariances of a few assets (a row per pair comes to the driver)."""
    a, b = (returns.select(F.col(asset).alias(n), F.col(time).alias(time), F.col(value).alias(v)) for n, v in (("x", "u"), ("y", "v")))
    rows = a.join(b, time).where("x <= y AND u IS NOT NULL AND v IS NOT NULL").groupBy("x", "y").agg(F.covar_samp("u", "v").alias("c"), F.avg("u").alias("m")).collect()
    names = sorted({r["x"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    mean, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in rows:
        i, j = at[r["x"]], at[r["y"]]
        cov[i, j] = cov[j, i] = r["c"] or 0.0
        if i == j:
            mean[i] = r["m"]
    return names, mean, cov


def portfolio_weights(mean: np.ndarray, cov: np.ndarray, method: str, riskless: float = 0.03, year: int = 252, rounds: int = 100) -> np.ndarray:
    """Long-only weights that sum to one: ``equal``, ``inverse`` variance, ``max_sharpe`` (tangency, negative ones
    cut), ``risk_parity`` (equal contributions to variance)."""
    k = len(mean)
    if method == "equal":
        w = np.ones(k)
    elif method == "inverse":
        w = 1 / np.maximum(np.diag(cov), 1e-12)
    elif method == "max_sharpe":
        w = np.clip(np.linalg.pinv(cov) @ (mean - riskless / year), 0, None)
    elif method == "risk_parity":
        w = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-12))
        for _ in range(rounds):  # coordinates in turn: each contribution becomes 1 / k of a variance of one
            for i in range(k):
                rest = cov[i] @ w - cov[i, i] * w[i]
                w[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] / k)) / (2 * cov[i, i]) if cov[i, i] > 0 else 0.0
    else:
        raise ValueError(f"unknown method {method!r}")
    return w / w.sum() if w.sum() > 0 else np.ones(k) / k


# --- pattern match ---------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    span = x.max() - x.min()
    return (x - x.min()) / span if span > 1e-9 else np.zeros(len(x))


def best_window(closes: np.ndarray, curve: np.ndarray) -> tuple[float, int, int]:
    """(score, start, end) of the window that correlates best with the curve stretched to its length; windows are
    as long as the curve, 0.7 and 1.4 times, and step by a third."""
    best = (0.0, 0, 0)
    for size in sorted({len(curve), int(len(curve) * 0.7), int(len(curve) * 1.4)}):
        if not 5 <= size <= len(closes):
            continue
        ref = np.interp(np.linspace(0, 1, size), np.linspace(0, 1, len(curve)), _unit(curve))
        ref = ref - ref.mean()
        windows = np.lib.stride_tricks.sliding_window_view(closes, size)[:: max(1, size // 3)]
        parts = windows - windows.mean(axis=1, keepdims=True)
        scale = np.sqrt((parts**2).sum(axis=1) * (ref @ ref))
        score = np.where(scale > 1e-12, parts @ ref / np.where(scale > 1e-12, scale, 1.0), 0.0)
        i = int(score.argmax())
        if score[i] > best[0]:
            best = (float(score[i]), i * max(1, size // 3), i * max(1, size // 3) + size)
    return best


def pattern_match(panel: DataFrame, curve: list[float], least: float = 0.3, top: int = 10, rows: int = 20) -> DataFrame:
    """(ts_code, score, start_day, end_day): the securities whose closes match the curve best; a group is one
    security's history, with ``rows`` dates at least."""
    wanted = np.asarray(curve, float)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        score, a, b = best_window(pdf["close"].to_numpy(float), wanted) if len(pdf) >= rows else (0.0, 0, 0)
        found = [(pdf["ts_code"].iloc[0], round(score, 4), pdf["trade_date"].iloc[a], pdf["trade_date"].iloc[b - 1])] if score >= least else []
        return pd.DataFrame(found, columns=["ts_code", "score", "start_day", "end_day"])

    out = panel.select("ts_code", "trade_date", "close").groupBy("ts_code").applyInPandas(one, "ts_code string, score double, start_day date, end_day date")
    return out.orderBy(F.desc("score"), "ts_code").limit(top)


# --- texts, codes, dates ---------------------------------------------------


def clean_text(c: Column) -> Column:
    """Control characters and white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x20\x7F]+", " "))


def clean_codes(codes: DataFrame, code: str = "ts_code", order: str | None = None) -> DataFrame:
    """Codes trimmed and in capitals, each once, where it comes first in ``order``."""
    key = F.upper(F.trim(code))
    out = codes.withColumn(code, key).where(F.length(code) > 0)
    if order is None:
        return out.dropDuplicates([code])
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(code).orderBy(order))).where("_n = 1").drop("_n")


def warm_up_start(c: Column, days: int = 540) -> Column:
    return F.date_sub(c.cast("date"), days)


# The signs of code page 1252 beyond Latin-1, and the code points of their bytes.
_CP1252 = "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
# Points for each match of a pattern.
_POINTS = {"[\u4e00-\u9fff]": 3, "[\u00c0-\u00ff\u0192\u2018-\u203a\u20ac]": -2, "\ufffd": -4, "\\?": -1}


def repair_text(c: Column) -> Column:
    """Texts whose UTF-8 was read as Latin-1 or CP1252 read anew, where that makes them better: three points for each
    CJK character, two off for each sign of the mistake, four for a replacement character, one for a question mark."""

    def again(single: Column) -> Column:
        """A text of one-byte characters as the UTF-8 that its bytes are; null where they are none."""
        safe = F.when(single.rlike("^[\\x00-\\xFF]*$"), single)
        return F.try_validate_utf8(F.encode(safe, "ISO-8859-1").cast("string"))

    def worth(t: Column) -> Column:
        return sum((F.regexp_count(t, F.lit(p)) * k for p, k in _POINTS.items()), F.lit(0))

    readings = [c, again(c), again(F.translate(F.when(~c.rlike("[\\x80-\\x9F]"), c), _CP1252, _BYTES))]
    ranked = F.array(*[F.struct(worth(t).alias("points"), F.lit(-k).alias("earlier"), t.alias("t")) for k, t in enumerate(readings)])
    return F.array_max(F.filter(ranked, lambda x: x["t"].isNotNull()))["t"]


def broker_transactions(spark: SparkSession, path: str) -> DataFrame:
    """(date, action, code, shares, price, amount, fee) of GBK-coded statements with a heading; rows without a
    security or a number of shares are left out. Columns go by their place. A task reads whole files:
    statements of one account are small, and Spark's CSV reader knows no GBK."""

    def read(batches):
        import csv
        import io
        import re

        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                for r in list(csv.reader(io.StringIO(bytes(content).decode("gbk"))))[1:]:
                    name, shares = (re.search(r"\((\d{6})\.X(SHG|SHE)\)", r[3]), re.search(r"-?\d+", r[6])) if len(r) > 12 else (None, None)
                    if name and shares:
                        rows.append((r[0].strip(), "buy" if r[4].strip() == "买" else "sell", name[1] + (".SH" if name[2] == "SHG" else ".SZ"), abs(int(shares[0])), float(r[7]), float(r[8]), float(r[12])))
            yield pd.DataFrame(rows, columns=["date", "action", "code", "shares", "price", "amount", "fee"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "date string, action string, code string, shares long, price double, amount double, fee double")


def page_after(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next rows by key after one that was seen."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


# --- registered queries ----------------------------------------------------


def _returns(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    r = panel.select("ts_code", "industry", "trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("r")).where("r IS NOT NULL")
    return r.join(r.groupBy("trade_date").agg(F.avg("r").alias("b")), "trade_date")


def metrics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calc_metrics(_returns(market_panel(spark, sf_dir)), ["ts_code"], "trade_date", "r", "b", year=52)


def optimal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(market_panel(spark, sf_dir)).groupBy(F.col("industry").alias("asset"), "trade_date").agg(F.avg("r").alias("r"))
    names, mean, cov = moments(r)  # industries are few
    methods = ("equal", "inverse", "max_sharpe", "risk_parity")
    table = np.column_stack([portfolio_weights(mean, cov, m, year=52) for m in methods])
    return spark.createDataFrame([(n, *map(float, row)) for n, row in zip(names, table, strict=True)], "asset string, equal double, inverse double, max_sharpe double, risk_parity double")


def pattern_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_match(market_panel(spark, sf_dir), [1, 2, 3, 2.5, 2, 3, 4, 5, 4, 6, 7, 8])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (metrics_full, optimal_weights, pattern_topn)}


def oracle_sql() -> dict[str, str]:
    return {"metrics_full": handmade.METRICS_FULL}
