"""Factor search: candidate identity, walk-forward folds, batch evaluation, scores and
gates, correlation clusters, and a genetic loop.

A whole batch or generation is evaluated in one Spark job: its expressions share layers
(see plans.compile), go long, and metrics are one aggregation by factor, fold and
part. The driver only keeps what has a row per candidate.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.registry import FUNCTIONS, MACROS
from ..plans.ast import Node, parse, walk
from ..plans.compile import evaluate, significant
from ..sources.panel import HISTORY, market_panel
from ..sources.work import staged
from .choice import leaders
from . import handmade, simulate

# --- identity of candidates -----------------------------------------------


def expression_key(expression: str) -> str:
    """SHA-256 of the text without white space."""
    return hashlib.sha256(re.sub(r"\s+", "", expression).encode()).hexdigest()


def equivalence_key(expression: str, direction: str = "top") -> str:
    """Equal for expressions that trade alike: a sign in front turns the direction."""
    node, up = parse(expression), direction != "bottom"
    while node.op == "neg":
        node, up = node.args[0], not up
    return hashlib.sha256(f"{node}|{'top' if up else 'bottom'}".encode()).hexdigest()


def complexity(expression: str) -> int:
    """Functions and operators of the expression."""
    return sum(n.op not in ("num", "var") for n in walk(parse(expression)))


# Functions by which families are told, and window sizes that count as alike.
SHAPE = frozenset("skew kurt downside_std upside_std efficiency_ratio".split())
EVENTS = frozenset("ema macd_dif macd_dea macd_hist rsi cross_up cross_down bars_since count_true vol_zscore gap_pct breakout drawdown_from_high".split()) | SHAPE
BASICS = frozenset("pe pb ps turnover_rate circ_mv total_mv".split())
PLAIN = frozenset("rank cs_rank abs neg clip".split())
BUCKETS = ((0, "none"), (5, "xs"), (15, "s"), (30, "m"), (60, "l"), (10**9, "xl"))


def novelty_key(expression: str) -> str:
    """Family, functions, variables and window sizes: candidates with one key are of one structure."""
    nodes = list(walk(parse(expression)))
    names = {n.op for n in nodes if n.op[0].isalpha() and n.op not in ("num", "var", "neg", "not")}
    variables = {str(n.value) for n in nodes if n.op == "var"}
    windows = {int(n.args[-1].value) for n in nodes if n.args and n.args[-1].op == "num" and (n.op in MACROS or n.op in FUNCTIONS and FUNCTIONS[n.op].axis == "ts")}
    family = "shape" if names & SHAPE else "fundamental" if variables & BASICS else "event" if names & EVENTS else "volume" if variables & {"vol", "volume", "amount"} else "return" if "returns" in variables or "pctchange" in names else "price"
    sizes = {next(b for top, b in BUCKETS if w <= top) for w in windows}
    return "|".join([family, "+".join(sorted(names - PLAIN)) or "raw", "+".join(sorted(variables)) or "none", "+".join(sorted(sizes)) or "none", "event" if names & (EVENTS | {"where", "ternary"}) else "continuous"])


# --- folds ----------------------------------------------------------------


def fold_table(n: int, windows: int = 3, embargo: int = 5) -> pd.DataFrame:
    """Folds over n dates, a row per fold: train is [0, train), then valid and test after an embargo each.

    Cut-offs are columns of the fold's number: train grows from a first part by a step, and each part ends
    where its own share of the dates does. A fold whose valid or test part is empty is left out; without
    any, the dates are halved and the second half is halved again.
    """
    share = {k: max(3, n // (max(2, windows) + k)) for k in (2, 3, 4)}  # fixed values: shares of train's step, valid and test
    t = pd.DataFrame({"fold": range(max(2, windows))})
    t["train"] = (max(20, n // (max(2, windows) + 1)) + t["fold"] * share[2]).clip(upper=n - 3)
    t["valid_from"] = (t["train"] + embargo).clip(upper=n)
    t["valid_to"] = (t["valid_from"] + share[3]).clip(upper=n - 2)
    t["test_from"] = (t["valid_to"] + embargo).clip(upper=n)
    t["test_to"] = (t["test_from"] + share[4]).clip(upper=n)
    t = t[(t["valid_from"] < t["valid_to"]) & (t["test_from"] < t["test_to"])]
    if t.empty:
        half = max(1, n // 2)
        middle = max(half + 1, n * 3 // 4)
        t = pd.DataFrame([(0, half, half, middle, middle, n)], columns=["fold", "train", "valid_from", "valid_to", "test_from", "test_to"])
    return t.reset_index(drop=True)


def walk_forward(n: int, windows: int = 3, embargo: int = 5) -> list[dict[str, tuple[int, int]]]:
    """The fold table as half-open index ranges by part."""
    return [{"train": (0, int(r.train)), "valid": (int(r.valid_from), int(r.valid_to)), "test": (int(r.test_from), int(r.test_to))} for r in fold_table(n, windows, embargo).itertuples()]


# --- batch evaluation -----------------------------------------------------


def parts_by_date(panel: DataFrame, windows: int = 3, embargo: int = 5) -> DataFrame:
    """(trade_date, fold, part): the dates of each fold's parts, by a range join with the fold table."""
    days = panel.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    rows = [(k, part, a, b) for k, f in enumerate(walk_forward(days.count(), windows, embargo)) for part, (a, b) in f.items()]
    folds = F.broadcast(panel.sparkSession.createDataFrame(rows, "fold int, part string, a int, b int"))  # a few rows
    return days.join(folds, (F.col("i") >= F.col("a")) & (F.col("i") < F.col("b"))).select("trade_date", "fold", "part")


def factor_table(panel: DataFrame, expressions: dict[str, str], forward: int = 4, history: int = 1 << 16) -> DataFrame:
    """(ts_code, trade_date, a column per expression, _fwd): values and the forward return on each row of the panel."""
    return evaluate(panel, {**expressions, "_fwd": f"delay(close, {-forward}) / close - 1"}, history=history)


def batch_metrics(panel: DataFrame, expressions: dict[str, str], forward: int = 4, windows: int = 3, embargo: int = 5, history: int = 1 << 16, wide: DataFrame | None = None) -> DataFrame:
    """(factor, fold, part, dates, ic_mean, ic_ir, t_stat, spread, win_rate) of each
    expression on each fold: rank IC and quintile spread against the forward return. ``history``: most rows of a security. Rows are dealt once, by
    factor and date; a value's ties are counted in the order of its rank. ``wide``: ``factor_table`` of the expressions, if there is one."""
    wide = factor_table(panel, expressions, forward, history) if wide is None else wide
    pairs = ", ".join(f"'{n}', {n}" for n in expressions)
    long = wide.selectExpr("ts_code", "trade_date", "_fwd", f"stack({len(expressions)}, {pairs}) AS (factor, value)").where("value IS NOT NULL AND _fwd IS NOT NULL")
    w = Window.partitionBy("factor", "trade_date")
    ties = lambda c: F.count(F.lit(1)).over(w.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow))
    pct = lambda c: (F.rank().over(w.orderBy(c)) + (ties(c) - 1) / 2) / F.count(F.lit(1)).over(w)
    ranked = long.select("factor", "trade_date", F.col("_fwd").alias("fwd"), pct("value").alias("rv"), pct("_fwd").alias("rf"), F.row_number().over(w.orderBy("value", "ts_code")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    edge = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    corr = F.try_divide(F.covar_pop("rv", "rf"), F.stddev_pop("rv") * F.stddev_pop("rf"))
    daily = ranked.where("n >= 5").groupBy("factor", "trade_date").agg(corr.alias("ic"), (F.avg(F.when(F.col("rn") > F.col("n") - edge, F.col("fwd"))) - F.avg(F.when(F.col("rn") <= edge, F.col("fwd")))).alias("spread"))
    parts = daily.join(parts_by_date(panel, windows, embargo), "trade_date")
    sd = F.nullif(F.stddev_samp("ic"), F.lit(0.0))
    return parts.groupBy("factor", "fold", "part").agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic_mean"), (F.avg("ic") / sd).alias("ic_ir"), (F.avg("ic") / sd * F.sqrt(F.count("ic"))).alias("t_stat"), F.avg("spread").alias("spread"), F.avg((F.col("spread") > 0).cast("double")).alias("win_rate"))


def _stacked(panel: DataFrame, expressions: dict[str, str], wide: DataFrame | None = None) -> DataFrame:
    """(ts_code, trade_date, factor, value) of each expression on each row of the panel; ``wide`` as in ``batch_metrics``."""
    pairs = ", ".join(f"'{n}', {n}" for n in expressions)
    return (evaluate(panel, expressions) if wide is None else wide).selectExpr("ts_code", "trade_date", f"stack({len(expressions)}, {pairs}) AS (factor, value)")


def coverage(values: DataFrame, parts: DataFrame) -> DataFrame:
    """(factor, fold, part, coverage, names): percent of rows with a value, and securities that have one."""
    known = F.col("value").isNotNull()
    return values.join(parts, "trade_date").groupBy("factor", "fold", "part").agg((100.0 * F.count("value") / F.count(F.lit(1))).alias("coverage"), F.count_distinct(F.when(known, F.col("ts_code"))).alias("names"))


#: Dates of a year: the panel is weekly.
PERIODS = 52


def backtests(panel: DataFrame, values: DataFrame, parts: DataFrame, s: simulate.Settings) -> DataFrame:
    """(factor, fold, part, excess, drawdown, turnover, sharpe, trades): each factor's best names
    bought from full cash on the part's first date on. Excess over the mean close, drawdown and mean
    turnover by date are in percent."""
    parts = parts.select("fold", "part", "trade_date", F.concat_ws("|", "fold", "part").alias("segment"))
    days = simulate.daily(simulate.events(panel, values, ("top",), s, segments=parts))
    w = Window.partitionBy("factor", "segment").orderBy("trade_date")
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("r", F.col("value") / F.coalesce(F.lag("value").over(w), F.lit(s.cash)) - 1).withColumn("dd", (peak - F.col("value")) / peak)
    n, sd = F.count(F.lit(1)), F.stddev_samp("r")
    runs = days.groupBy("factor", "segment").agg((100 * (F.max_by("value", "trade_date") / s.cash - 1)).alias("total"), (100 * F.max("dd")).alias("drawdown"), F.avg(100 * F.col("traded") / F.col("value")).alias("turnover"), F.when((n > 2) & (sd > 0), F.avg("r") / sd * math.sqrt(PERIODS)).otherwise(0.0).alias("sharpe"), F.sum(F.col("buys") + F.col("sells")).alias("trades"))
    market = panel.groupBy("trade_date").agg(F.avg("close").alias("m")).join(parts, "trade_date").groupBy("fold", "part", "segment").agg((100 * (F.max_by("m", "trade_date") / F.min_by("m", "trade_date") - 1)).alias("market"))
    return runs.join(market, "segment").select("factor", "fold", "part", (F.col("total") - F.col("market")).alias("excess"), "drawdown", "turnover", "sharpe", "trades")


def p_value(t: pd.Series) -> pd.Series:
    """Two-sided, of a normal statistic; without one it is 1."""
    return t.fillna(0.0).map(lambda x: math.erfc(abs(x) / math.sqrt(2)))


# Scores and gates over the columns valid_ic, valid_ir, valid_spread (in percent), valid_excess, test_ic, test_ir,
# test_p, test_excess (in percent), valid_drawdown, drawdown, turnover, sharpe, trades (of the test part), coverage, names (of the valid part), valid_dates, test_dates, complexity, tested.
PENALTY = "least(greatest(complexity, 0) / 120.0D, 0.35D) + least(ln(1 + greatest(tested, 0)) / 18.0D, 0.45D)"
SCORES = {
    "discovery_score": f"abs(valid_ic) * 4 + least(abs(valid_ir), 3.0D) * 0.35D + greatest(valid_spread, 0.0D) / 80 + greatest(valid_excess, 0.0D) / 100 - greatest(valid_drawdown, 0.0D) / 300 - ({PENALTY})",
    "oos_score": "greatest(test_excess, -30.0D) / 60 + abs(test_ic) * 3 + least(abs(test_ir), 3.0D) * 0.25D - greatest(drawdown, 0.0D) / 250 - least(greatest(turnover, 0.0D) / 600, 0.25D) - least(greatest(complexity, 0) / 160.0D, 0.25D)",
    "deflated_sharpe": "sharpe - 0.15D * sqrt(ln(greatest(tested, 2)))",
    "bonferroni_p": "least(1.0D, test_p * greatest(tested, 1))",
    "capacity_score": "greatest(0.0D, 100 - least(greatest(turnover, 0.0D), 500.0D) / 5)",
    "pbo_risk": "CASE WHEN test_excess <= 0 OR test_ic = 0 THEN 'high' WHEN valid_excess > 0 AND test_excess < valid_excess * 0.25D THEN 'high' WHEN abs(valid_ic) > 0 AND abs(test_ic) < abs(valid_ic) * 0.35D THEN 'medium' ELSE 'low' END",
}
GATES = {
    "coverage_below_45pct": "coverage < 45", "valid_stock_count_below_5": "names < 5", "valid_ic_count_below_3": "valid_dates < 3", "test_ic_count_below_3": "test_dates < 3",
    "validation_directional_ic_too_weak": "valid_ic < 0.005D", "test_directional_ic_negative": "test_ic < 0", "test_ic_statistically_weak": "test_p > 0.35D", "validation_excess_return_too_low": "valid_excess < -2",
    "test_excess_return_not_positive": "test_excess <= 0", "no_real_trades": "trades <= 0", "test_max_drawdown_above_35pct": "drawdown > 35", "turnover_too_high": "turnover > 350",
}


def judged(metrics: DataFrame) -> DataFrame:
    """metrics with a column per score and ``reasons``: the gates that reject the candidate."""
    gates = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in GATES.items())
    return metrics.selectExpr("*", *[f"{e} AS {n}" for n, e in SCORES.items()], f"filter(array({gates}), x -> x IS NOT NULL) AS reasons")


def leader_clusters(curves: DataFrame, scores: DataFrame, least: float = 0.85, days: int = 20) -> DataFrame:
    """(factor, leader): in order of score (ties by name), a factor joins the first leader whose curve correlates by ``least`` with its
    own, either way, over ``days`` common dates. curves: (factor, trade_date, value); scores: (factor, score), a row per factor."""
    nodes = scores.select(F.col("factor").alias("id"), F.struct((-F.col("score")).alias("less"), F.col("factor")).alias("place"))
    c = curves.join(nodes.select(F.col("id").alias("factor"), "place"), "factor")
    a = c.select("trade_date", F.col("factor").alias("earlier"), F.col("place").alias("p"), F.col("value").alias("u"))
    b = c.select("trade_date", F.col("factor").alias("later"), F.col("place").alias("q"), F.col("value").alias("v"))
    corr = F.abs(F.try_divide(F.covar_pop("u", "v"), F.stddev_pop("u") * F.stddev_pop("v")))
    met = a.join(b, "trade_date").where("p < q").groupBy("earlier", "later").agg(F.count(F.lit(1)).alias("n"), corr.alias("corr"))
    edges = staged(met.where((F.col("n") >= days) & (F.col("corr") >= least)).select("earlier", "later"), "alike_curves")
    return leaders(nodes, edges).select(F.col("id").alias("factor"), "leader")


def clusters(curves: DataFrame, scores: list[tuple[str, float]], least: float = 0.85, days: int = 20) -> dict[str, str]:
    """``leader_clusters`` of the few candidates that the driver holds."""
    table = curves.sparkSession.createDataFrame([(n, float(x)) for n, x in scores], "factor string, score double")
    return {r["factor"]: r["leader"] for r in leader_clusters(curves, table, least, days).collect()}


# --- genetic loop ---------------------------------------------------------

LEAVES = ("close", "open", "high", "low", "volume", "amount", "returns", "vwap")
UNARY = ("rank", "abs", "neg", "sign", "signed_log")
WINDOWED = ("mean", "std", "ts_max", "ts_min", "delta", "pctchange", "ts_decay", "zscore")
BINARY = ("+", "-", "*", "/")
FIBONACCI = (3, 5, 8, 13, 21, 34, 55)


def random_tree(rng: random.Random, depth: int = 3) -> Node:
    if depth == 0 or rng.random() < 0.22:
        return Node("var", value=rng.choice(LEAVES))
    kind = rng.random()
    if kind < 0.2:
        return Node(rng.choice(UNARY), (random_tree(rng, depth - 1),))
    if kind < 0.7:
        return Node(rng.choice(WINDOWED), (random_tree(rng, depth - 1), Node("num", value=float(rng.choice(FIBONACCI)))))
    return Node(rng.choice(BINARY), (random_tree(rng, depth - 1), random_tree(rng, depth - 1)))


def mutate(rng: random.Random, tree: Node, depth: int = 3) -> Node:
    if tree.op in ("num", "var") or rng.random() < 0.3:
        return random_tree(rng, max(1, depth - 1)) if tree.op != "num" else Node("num", value=float(rng.choice(FIBONACCI)))
    i = rng.randrange(len(tree.args))
    return Node(tree.op, tuple(mutate(rng, a, depth - 1) if k == i else a for k, a in enumerate(tree.args)), tree.value)


def crossover(rng: random.Random, a: Node, b: Node) -> Node:
    parts = [n for n in walk(b) if n.op != "num"]
    if a.op in ("num", "var"):
        return rng.choice(parts)
    i = rng.choice([k for k, x in enumerate(a.args) if x.op != "num"])
    return Node(a.op, tuple(rng.choice(parts) if k == i else x for k, x in enumerate(a.args)), a.value)


def evolve(panel: DataFrame, population: int = 12, generations: int = 3, top: int = 5, seed: int = 7, history: int = 1 << 16) -> list[tuple[str, float]]:
    """The best expressions and their fitness 0.6 |IC| + 0.4 min(IR, 2) / 2: a third of each
    generation stays, the rest is new, crossed or mutated; a generation is one job."""
    rng, known = random.Random(seed), {}
    trees = [random_tree(rng) for _ in range(population)]
    for _ in range(generations):
        new = {f"f{i}": t for i, t in enumerate({t: None for t in trees if t not in known})}
        if new:
            for r in batch_metrics(panel, new, windows=2, history=history).where("part = 'train'").groupBy("factor").agg(F.avg(F.abs("ic_mean")).alias("ic"), F.avg(F.abs("ic_ir")).alias("ir")).collect():  # one row each
                known[new[r["factor"]]] = 0.6 * (r["ic"] or 0.0) + 0.4 * min(r["ir"] or 0.0, 2.0) / 2
            for t in new.values():
                known.setdefault(t, 0.0)
        best = sorted(set(trees), key=lambda t: (-known[t], str(t)))[: max(2, population // 3)]
        trees = list(best)
        while len(trees) < population:
            k = rng.random()
            trees.append(random_tree(rng) if k < 0.3 else crossover(rng, rng.choice(best), rng.choice(best)) if k < 0.65 else mutate(rng, rng.choice(best)))
    return [(str(t), known[t]) for t in sorted(known, key=lambda t: (-known[t], str(t)))[:top]]


BATCH = {"momentum": "pctchange(close, 4)", "reversal": "-pctchange(close, 2)", "activity": "volume / mean(volume, 8)", "shape": "skew(close, 13)", "trend": "efficiency_ratio(close, 8)"}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles with nine decimals and twenty significant bits: equal in all engines."""
    return df.selectExpr(*[f"{significant(f'round({c}, 9) + 0.0D')} AS {c}" if t == "double" else c for c, t in df.dtypes])


def mining_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(batch_metrics(market_panel(spark, sf_dir), BATCH))


def candidates(panel: DataFrame, prices: DataFrame, expressions: dict[str, str], forward: int = 4, windows: int = 3, embargo: int = 5) -> DataFrame:
    """One row per factor and fold with the columns that scores and gates read, measured on the
    fold's valid and test parts; ``prices`` is the panel at the prices that are traded.
    A part without measurements has zeros and the p value 1. Expressions are evaluated once."""
    parts = parts_by_date(panel, windows, embargo).where("part <> 'train'")
    wide = staged(factor_table(panel, expressions, forward), "factors")
    values = _stacked(panel, expressions, wide)
    keys = ["factor", "fold", "part"]
    m = coverage(values, parts).join(batch_metrics(panel, expressions, forward, windows, embargo, wide=wide), keys, "left").join(backtests(prices, values, parts, simulate.Settings(rebalance=forward)), keys, "left")
    m = m.withColumn("p", F.pandas_udf(p_value, "double")("t_stat")).fillna(0.0).withColumn("spread", F.col("spread") * 100)
    taken = ["ic_mean", "ic_ir", "spread", "dates", "p", "excess", "drawdown", "turnover", "sharpe", "trades", "coverage", "names"]
    m = m.groupBy("factor", "fold").pivot("part", ["valid", "test"]).agg(*[F.first(c).alias(c) for c in taken])
    sizes = ", ".join(f"'{n}', {complexity(e)}" for n, e in expressions.items())
    return m.selectExpr(
        "factor", "fold", "valid_ic_mean AS valid_ic", "valid_ic_ir AS valid_ir", "valid_spread", "valid_excess", "valid_drawdown", "test_ic_mean AS test_ic", "test_ic_ir AS test_ir", "test_p", "test_spread", "test_excess",
        "test_drawdown AS drawdown", "test_turnover AS turnover", "test_sharpe AS sharpe", "test_trades AS trades", "valid_coverage AS coverage", "valid_names AS names", "valid_dates", "test_dates", f"map({sizes})[factor] AS complexity", f"{len(expressions)} AS tested")


def mining_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = market_panel(spark, sf_dir)
    m = candidates(panel, simulate._cents(panel), BATCH).drop("test_spread")
    return judged(m).withColumn("reasons", F.array_join("reasons", ","))


def mining_gp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(evolve(market_panel(spark, sf_dir), 8, 2, history=HISTORY), "expression string, fitness double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (mining_batch, mining_scores, mining_gp)}


def oracle_sql() -> dict[str, str]:
    return {"mining_batch": handmade.MINING_BATCH}
