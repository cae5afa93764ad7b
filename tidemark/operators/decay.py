"""How long a factor's information lasts: rank correlations with returns over growing horizons and their half-life,
and how robust it is over the folds of a walk forward."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compile import evaluate
from ..sources.panel import PANEL_SQL, market_panel
from .handmade import _MINING, _num
from .mining import BATCH, batch_metrics, rounded

#: Dates from entry to exit.
HORIZONS = (1, 3, 5, 10, 20)
#: Fixed value: securities without which a date has no correlation.
LEAST = 5


def open_returns(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(ts_code, trade_date, r1, r3, ...): the return from the open on the panel's next date to that ``horizon`` dates later; null
    where the security has no bar, or no positive open, on either. A date is found by its number in a frame of that number alone:
    the panel's buckets are enough, no join and no shuffle by security."""
    days = panel.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")))  # a row per date
    w = Window.partitionBy("ts_code").orderBy("i")
    at = lambda k: F.first(F.when(F.col("open") > 0, F.col("open"))).over(w.rangeBetween(k, k))
    numbered = panel.select("ts_code", "trade_date", "open").join(F.broadcast(days), "trade_date")
    return numbered.select("ts_code", "trade_date", *[(at(1 + h) / at(1) - 1).alias(f"r{h}") for h in horizons])


def horizon_ics(panel: DataFrame, expressions: dict[str, str], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(factor, horizon, trade_date, names, ic): Spearman correlation of each expression with each return, on dates
    with ``LEAST`` securities that have both; null where either is constant."""
    wide = evaluate(panel, expressions).join(open_returns(panel, horizons), ["ts_code", "trade_date"])
    factors = ", ".join(f"'{n}', {n}" for n in expressions)
    returns = ", ".join(f"{h}, r{h}" for h in horizons)
    long = wide.selectExpr("trade_date", *[f"r{h}" for h in horizons], f"stack({len(expressions)}, {factors}) AS (factor, value)").where("value IS NOT NULL")
    long = long.selectExpr("trade_date", "factor", "value", f"stack({len(horizons)}, {returns}) AS (horizon, r)").where("r IS NOT NULL")
    keys = ["factor", "horizon", "trade_date"]
    w = Window.partitionBy(*keys)
    place = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    ranked = long.select(*keys, place("value").alias("x"), place("r").alias("y"))
    ic = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"), ic.alias("ic")).where(F.col("names") >= LEAST)


def half_lives(ics: DataFrame, factors: list[str], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(factor, horizon, dates, ic, peak_ic, best_horizon, half_life), a row per factor and horizon. ic: absolute mean, 0 without any;
    best: the first horizon with the peak; half-life: the first with half of it at most, else the last."""
    frame = ics.sparkSession.createDataFrame([(f, h) for f in factors for h in horizons], "factor string, horizon int")
    means = ics.groupBy("factor", "horizon").agg(F.count("ic").alias("dates"), F.round(F.abs(F.avg("ic")), 9).alias("ic"))
    m = frame.join(means, ["factor", "horizon"], "left").fillna({"dates": 0, "ic": 0.0})
    m = rounded(m)
    own = Window.partitionBy("factor")
    m = m.withColumn("peak_ic", F.max("ic").over(own))
    low = F.when((F.col("peak_ic") > 0) & (F.col("ic") <= F.col("peak_ic") / 2), F.col("horizon"))
    return m.withColumn("best_horizon", F.min(F.when(F.col("ic") == F.col("peak_ic"), F.col("horizon"))).over(own)).withColumn("half_life", F.coalesce(F.min(low).over(own), F.lit(max(horizons))))


# The weights of the score.
ROBUSTNESS = "least(100.0D, greatest(0.0D, pass_ratio * 45 + greatest(least(median_ic, 0.05D), -0.05D) * 600 + greatest(least(worst_ic, 0.03D), -0.03D) * 300 - ic_decay * 15 - spread_decay * 15))"


def robustness(metrics: DataFrame) -> DataFrame:
    """(factor, folds, pass_ratio, median_ic, worst_ic, ic_decay, spread_decay, robustness_score) of ``mining.batch_metrics``: test correlations over
    the folds, how much of the valid parts' correlation and spread the test parts lose (1: all, also where there was none), and the score from 0 to 100."""
    at = lambda part, c: F.avg(F.when(F.col("part") == part, F.col(c)))
    test = F.when(F.col("part") == "test", F.coalesce("ic_mean", F.lit(0.0)))
    m = metrics.groupBy("factor").agg(
        F.count(test).alias("folds"), F.coalesce(F.avg((test > 0).cast("double")), F.lit(0.0)).alias("pass_ratio"), F.coalesce(F.median(test), F.lit(0.0)).alias("median_ic"), F.coalesce(F.min(test), F.lit(0.0)).alias("worst_ic"),
        F.abs(at("valid", "ic_mean")).alias("vi"), F.abs(at("test", "ic_mean")).alias("ti"), at("valid", "spread").alias("vs"), at("test", "spread").alias("ts"))
    lost = lambda v, t: F.when(F.col(v) > 0, 1 - F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)) / F.col(v), F.lit(1.0))).otherwise(1.0)
    m = m.withColumn("ic_decay", lost("vi", "ti")).withColumn("spread_decay", lost("vs", "ts")).drop("vi", "ti", "vs", "ts")
    return m.selectExpr("*", f"{ROBUSTNESS} AS robustness_score")


def ic_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return half_lives(horizon_ics(market_panel(spark, sf_dir), BATCH), list(BATCH))


def mining_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness(batch_metrics(market_panel(spark, sf_dir), BATCH)))


_PLACE = "rank() OVER (PARTITION BY factor, horizon, trade_date ORDER BY {0}) + (count(*) OVER (PARTITION BY factor, horizon, trade_date, {0}) - 1) / 2.0::DOUBLE"

_HALF_LIFE = f"""WITH p AS (SELECT ts_code, trade_date, open, volume, row_number() OVER w AS i, close / lag(close, 4) OVER w - 1 AS momentum, -(close / lag(close, 2) OVER w - 1) AS reversal,
    CASE WHEN count(*) OVER (w ROWS 7 PRECEDING) = 8 THEN volume / avg(volume) OVER (w ROWS 7 PRECEDING) END AS activity,
    CASE WHEN count(*) OVER (w ROWS 12 PRECEDING) = 13 THEN skewness(close) OVER (w ROWS 12 PRECEDING) END AS shape, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 8) OVER w) AS way
    FROM ({PANEL_SQL}) WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
  e AS (SELECT *, way / nullif(sum(step) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 7 PRECEDING), 0) AS trend FROM p),
  days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS d FROM (SELECT DISTINCT trade_date FROM p)),
  n AS (SELECT e.*, d FROM e JOIN days USING (trade_date)),
  f AS (SELECT a.ts_code, a.trade_date, h.horizon, c.open / b.open - 1 AS r, a.momentum, a.reversal, a.activity, a.shape, a.trend FROM n a, (VALUES (1), (3), (5), (10), (20)) AS h(horizon), n b, n c
    WHERE b.ts_code = a.ts_code AND b.d = a.d + 1 AND c.ts_code = a.ts_code AND c.d = a.d + 1 + h.horizon AND b.open > 0 AND c.open > 0),
  long AS (UNPIVOT f ON momentum, reversal, activity, shape, trend INTO NAME factor VALUE v),
  ranked AS (SELECT factor, horizon, trade_date, {_PLACE.replace('{0}', 'v')} AS x, {_PLACE.replace('{0}', 'r')} AS y FROM long WHERE v IS NOT NULL),
  ics AS (SELECT factor, horizon, CASE WHEN stddev_pop(x) * stddev_pop(y) <> 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM ranked GROUP BY factor, horizon, trade_date HAVING count(*) >= 5),
  m AS (SELECT factor, horizon, count(ic) AS dates, {_num('abs(avg(ic))', 'ic')} FROM ics GROUP BY 1, 2),
  k AS (SELECT factor, max(ic) AS peak_ic, arg_max(horizon, (ic, -horizon)) AS best FROM m GROUP BY factor)
  SELECT m.factor, m.horizon, dates, ic, peak_ic, best AS best_horizon, coalesce((SELECT min(horizon) FROM m AS o WHERE o.factor = m.factor AND o.ic <= peak_ic / 2), 20) AS half_life FROM m JOIN k ON k.factor = m.factor"""

_ROBUST = f"""{_MINING},
  t AS (SELECT factor, count(*) AS folds, avg((ic > 0)::INT::DOUBLE) AS pass_ratio, median(ic) AS median_ic, min(ic) AS worst_ic, abs(avg(ic)) AS ti, avg(spread) AS ts FROM m WHERE part = 'test' GROUP BY factor),
  v AS (SELECT factor, abs(avg(ic)) AS vi, avg(spread) AS vs FROM m WHERE part = 'valid' GROUP BY factor),
  j AS (SELECT t.*, CASE WHEN vi > 0 THEN greatest(0, 1 - ti / vi) ELSE 1 END::DOUBLE AS ic_decay, CASE WHEN vs > 0 THEN 1 - least(1, greatest(ts, 0) / vs) ELSE 1 END::DOUBLE AS spread_decay FROM t JOIN v USING (factor)),
  s AS (SELECT *, 45 * pass_ratio + 600 * least(0.05::DOUBLE, greatest(-0.05::DOUBLE, median_ic)) + 300 * least(0.03::DOUBLE, greatest(-0.03::DOUBLE, worst_ic)) - 15 * (ic_decay + spread_decay) AS raw FROM j)
  SELECT factor, folds, {_num('pass_ratio', 'pass_ratio')}, {_num('median_ic', 'median_ic')}, {_num('worst_ic', 'worst_ic')}, {_num('ic_decay', 'ic_decay')}, {_num('spread_decay', 'spread_decay')},
    {_num('CASE WHEN raw < 0 THEN 0 WHEN raw > 100 THEN 100 ELSE raw END', 'robustness_score')} FROM s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"ic_half_life": ic_half_life, "mining_robustness": mining_robustness}


def oracle_sql() -> dict[str, str]:
    return {"ic_half_life": _HALF_LIFE, "mining_robustness": _ROBUST}
