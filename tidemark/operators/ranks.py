"""Ranks over all rows of a table without a task that sees them all.

Distinct values are sorted in ranges and written with their counts; how many rows lie in the ranges
before one is a sum over as many rows as there are ranges. Equal values are one row by then, so a
tie across a border of ranges cannot happen, and a value that a third of all rows hold weighs no
more than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compile import significant
from ..sources.panel import PANEL_SQL, market_panel
from ..sources.work import staged


def counted_below(df: DataFrame, column: str) -> DataFrame:
    """(value, below, equal): for each value of a column that is not null, how many rows are less and how many equal it."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("equal"))
    # the number of a sorted row holds its range above bit 33
    held = staged(values.orderBy("value").withColumn("_at", F.monotonically_increasing_id()), "sorted_values")
    part = F.shiftright("_at", 33)
    sums = held.groupBy(part.alias("_part")).agg(F.sum("equal").alias("_rows"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # a row per range
    before = sums.select("_part", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_part", part).withColumn("_upto", F.sum("equal").over(own))
    return held.join(F.broadcast(before), "_part").select("value", (F.col("_before") + F.col("_upto") - F.col("equal")).alias("below"), "equal")


def percent_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a column per entry {name: column}: the share of the column's known values that a row's is not less than,
    ties averaged; null where it is null."""
    out = df
    for name, column in columns.items():
        known = df.agg(F.count(column).alias("_known"))
        ranks = counted_below(df, column).select(F.col("value").alias("_value"), F.col("below").alias("_below"), F.col("equal").alias("_equal"))
        out = out.join(ranks, out[column] == ranks["_value"], "left").crossJoin(F.broadcast(known))
        share = (F.col("_below") + (F.col("_equal") + 1) / F.lit(2.0)) / F.col("_known")
        out = out.withColumn(name, share).drop("_value", "_below", "_equal", "_known")
    return out


def screen(rows: DataFrame, falling: tuple[str, ...], rising: str, top: int | None = None, weights: tuple[float, float] = (0.6, 0.4), code: str = "ts_code", digits: int = 9) -> DataFrame:
    """rows with ``score``: the first weight times the mean of 100 less the percent ranks of ``falling`` (cheap is good), plus the
    second times the percent rank of ``rising``. With ``top``, only so many best rows, numbered ``k`` (ties by code)."""
    names = {f"_rank_{i}": c for i, c in enumerate((*falling, rising))}
    ranked = percent_ranks(rows, names)
    low = sum((F.lit(100) - F.col(f"_rank_{i}") * 100 for i in range(len(falling))), F.lit(0.0)) / len(falling)
    scored = ranked.withColumn("score", weights[0] * low + weights[1] * F.col(f"_rank_{len(falling)}") * 100).drop(*names)
    if top is None:
        return scored
    best = scored.orderBy(F.round("score", digits).desc_nulls_last(), code).limit(top)
    return best.withColumn("k", F.row_number().over(Window.orderBy(F.round("score", digits).desc_nulls_last(), code)))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per security: its last valuation, and its return over all of its dates."""
    p = market_panel(spark, sf_dir)
    return p.groupBy("ts_code").agg(F.max_by("pe", "trade_date").alias("pe"), F.max_by("pb", "trade_date").alias("pb"), (F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1).alias("mom"))


def _number(x: str) -> str:
    return significant(f"round({x}, 9) + 0.0D")


def screener_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(_latest(spark, sf_dir), ("pe", "pb"), "mom", top=20).selectExpr("ts_code", f"{_number('score')} AS score", "k")


def screener_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(_latest(spark, sf_dir), ("pe", "pb"), "mom").selectExpr("ts_code", f"{_number('score')} AS score")


def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by inverse variance of weekly returns: each security's share of a sum over all."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    r = market_panel(spark, sf_dir).select("ts_code", (F.col("close") / F.lag("close", 1).over(w) - 1).alias("r"))
    v = r.groupBy("ts_code").agg((1 / F.when(F.var_samp("r") > 0, F.var_samp("r"))).alias("iv")).where("iv IS NOT NULL")
    return v.crossJoin(F.broadcast(v.agg(F.sum("iv").alias("total")))).selectExpr("ts_code", f"{_number('iv / total')} AS weight")


_SCORES = f"""WITH last_ AS (SELECT ts_code, arg_max(pe, trade_date) AS pe, arg_max(pb, trade_date) AS pb, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS mom FROM ({PANEL_SQL}) GROUP BY ts_code),
  s AS (SELECT a.ts_code,
    (SELECT 100 - (count(*) FILTER (b.pe < a.pe) + (count(*) FILTER (b.pe = a.pe) + 1) / 2.0::DOUBLE) / count(*) * 100 FROM last_ b) AS x,
    (SELECT 100 - (count(*) FILTER (b.pb < a.pb) + (count(*) FILTER (b.pb = a.pb) + 1) / 2.0::DOUBLE) / count(*) * 100 FROM last_ b) AS y,
    (SELECT (count(*) FILTER (b.mom < a.mom) + (count(*) FILTER (b.mom = a.mom) + 1) / 2.0::DOUBLE) / count(*) * 100 FROM last_ b) AS z FROM last_ a),
  t AS (SELECT ts_code, 0.6::DOUBLE * (x + y) / 2 + 0.4::DOUBLE * z AS v FROM s)"""


def _duck(x: str) -> str:
    return _number(x).replace("0.0D", "0.0::DOUBLE")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"screener_topn": screener_topn, "screener_scores": screener_scores, "portfolio_weights": portfolio_weights}


def oracle_sql() -> dict[str, str]:
    return {
        "screener_topn": f"{_SCORES} SELECT ts_code, {_duck('v')} AS score, CAST(row_number() OVER (ORDER BY round(v, 9) DESC, ts_code) AS INT) AS k FROM t ORDER BY k LIMIT 20",
        "screener_scores": f"{_SCORES} SELECT ts_code, {_duck('v')} AS score FROM t",
        "portfolio_weights": f"""WITH r AS (SELECT ts_code, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS r FROM ({PANEL_SQL})),
          v AS (SELECT ts_code, 1 / nullif(var_samp(r), 0) AS iv FROM r GROUP BY ts_code)
          SELECT ts_code, {_duck('iv / (SELECT sum(iv) FROM v)')} AS weight FROM v WHERE iv IS NOT NULL""",
    }
