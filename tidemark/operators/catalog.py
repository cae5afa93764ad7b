"""Scans and joins around the panel, catalogues, and news: as DataFrame functions.

The oracles are written by hand from what each operator is to return and share no text
with the plans. Dates, snapshots and industries are dimensions of at most some thousands of rows; windows
over them alone have no partition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import lexicon
from ..plans.compile import significant
from ..sources.panel import PANEL_SQL, market_panel
from ..sources.tables import adjust
from .news import sentiment

SO_FAR = (Window.unboundedPreceding, Window.currentRow)
FROM_HERE = (Window.currentRow, Window.unboundedFollowing)


def _by_date() -> WindowSpec:
    return Window.partitionBy("ts_code").orderBy("trade_date")


# --- bars ------------------------------------------------------------------


def adjusted(bars: DataFrame, factors: DataFrame, how: str | None = None) -> DataFrame:
    """bars as they are, forward (``qfq``: in terms of the newest factor) or backward (``hfq``: times the factor)
    adjusted; missing factors are those before, else those after, else 1."""
    if how is None:
        return bars
    if how == "qfq":
        return adjust(bars, factors)
    if how != "hfq":
        raise ValueError(f"unknown adjustment {how!r}")
    df = bars.join(factors.select("ts_code", "trade_date", F.col("adj_factor").alias("_a")), ["ts_code", "trade_date"], "left")
    near = F.coalesce(F.last("_a", True).over(_by_date().rowsBetween(*SO_FAR)), F.first("_a", True).over(_by_date().rowsBetween(*FROM_HERE)), F.lit(1.0))
    return df.withColumn("_a", near).select(*[F.round(F.col(c) * F.col("_a"), 2).alias(c) if c in ("open", "high", "low", "close") else c for c in bars.columns])


def checked(bars: DataFrame, most: float = 0.22) -> DataFrame:
    """bars without rows whose prices are all zero, and ``suspicious``: a move of more than ``most`` against the row before."""
    kept = bars.where("NOT (open = 0 AND high = 0 AND low = 0 AND close = 0)")
    move = F.abs(F.try_divide(F.col("close"), F.lag("close").over(_by_date())) - 1)
    return kept.withColumn("suspicious", F.coalesce(move > most, F.lit(False)))


def reindexed(bars: DataFrame, dates: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (ts_code, trade_date) of ``dates``, with the last known value of each column."""
    rows = dates.select("ts_code", "trade_date").join(bars.select("ts_code", "trade_date", *columns), ["ts_code", "trade_date"], "left")
    return rows.select("ts_code", "trade_date", *[F.last(c, True).over(_by_date().rowsBetween(*SO_FAR)).alias(c) for c in columns])


def aligned(benchmark: DataFrame, dates: DataFrame, value: str) -> DataFrame:
    """The benchmark at each date: the value before it, or else the first one after it."""
    w = Window.orderBy("trade_date")
    rows = dates.select("trade_date").distinct().join(benchmark.select("trade_date", value), "trade_date", "left")
    return rows.select("trade_date", F.coalesce(F.last(value, True).over(w.rowsBetween(*SO_FAR)), F.first(value, True).over(w.rowsBetween(*FROM_HERE))).alias(value))


def split_covered(wanted: DataFrame, bars: DataFrame, first: str, last: str) -> DataFrame:
    """(ts_code, first_day, last_day, state): ``cached`` where bars reach over both days, else ``pending``."""
    have = bars.groupBy("ts_code").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    whole = (F.col("first_day") <= F.lit(first).cast("date")) & (F.col("last_day") >= F.lit(last).cast("date"))
    return wanted.select("ts_code").distinct().join(have, "ts_code", "left").withColumn("state", F.when(whole, "cached").otherwise("pending"))


def members_on(weights: DataFrame, day: str) -> DataFrame:
    """(ts_code, weight, place) of the last snapshot up to a day, heaviest first, then by code."""
    upto = weights.where(F.col("snap") <= F.lit(day).cast("date"))
    last = upto.agg(F.max("snap").alias("snap"))
    return upto.join(F.broadcast(last), "snap").select("ts_code", "weight", F.row_number().over(Window.orderBy(F.desc("weight"), "ts_code")).alias("place"))


def delisted(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Codes with bars that the master doesn't have, and their last day."""
    return bars.join(master.select("ts_code"), "ts_code", "left_anti").groupBy("ts_code").agg(F.max("trade_date").alias("last_day"))


def entry_exit(panel: DataFrame, value: Column, members: DataFrame, hold: int = 4) -> DataFrame:
    """Value on a date, return from the next date's open to the open ``hold`` dates later, of members
    (ts_code, first_day, end_day exclusive or null) on that date; all four must be known."""
    at = lambda k: F.lead("open", k).over(_by_date())
    x = panel.select("ts_code", "trade_date", value.alias("value"), at(1).alias("entry"), at(1 + hold).alias("exit")).where("value IS NOT NULL AND entry > 0 AND exit > 0")
    m = members.select(F.col("ts_code").alias("_c"), "first_day", "end_day")
    inside = (F.col("_c") == F.col("ts_code")) & (F.col("trade_date") >= F.col("first_day")) & (F.col("end_day").isNull() | (F.col("trade_date") < F.col("end_day")))
    return x.join(m, inside, "left_semi").withColumn("ret", F.col("exit") / F.col("entry") - 1)


# --- curves ----------------------------------------------------------------


def rolling_pairs(returns: DataFrame, name: str, dates: int = 60) -> DataFrame:
    """(x, y, trade_date, corr) of each pair of series over their last common dates; 0 where one doesn't move. Rows are pairs times
    dates: for series that are few (industries, strategies, factors)."""
    a = returns.select(F.col(name).alias("x"), "trade_date", F.col("r").alias("u"))
    b = returns.select(F.col(name).alias("y"), "trade_date", F.col("r").alias("v"))
    w = Window.partitionBy("x", "y").orderBy("trade_date").rowsBetween(1 - dates, 0)
    both = a.join(b, "trade_date").where("x < y AND u IS NOT NULL AND v IS NOT NULL")
    spread = F.stddev_pop("u").over(w) * F.stddev_pop("v").over(w)
    rolled = both.select("x", "y", "trade_date", F.count(F.lit(1)).over(w).alias("n"), F.covar_pop("u", "v").over(w).alias("c"), spread.alias("s"))
    return rolled.where(F.col("n") == dates).select("x", "y", "trade_date", F.when(F.col("s") > 1e-12, F.col("c") / F.col("s")).otherwise(0.0).alias("corr"))


def extremes(contributions: DataFrame, key: str, value: str, names: int = 5) -> DataFrame:
    """The best and the worst keys by summed value; ties by key. Both orders are limits, which Spark takes per partition first."""
    s = contributions.groupBy(key).agg(F.sum(value).alias(value))
    best = s.orderBy(F.desc(value), key).limit(names).withColumn("side", F.lit("best"))
    return best.unionByName(s.orderBy(value, key).limit(names).withColumn("side", F.lit("worst")))


# --- catalogues ------------------------------------------------------------


def union_unnamed(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, and the rows of second whose key first doesn't name."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(*second.columns), allowMissingColumns=True)


def board_order(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc_nulls_last("max_quantile_excess"), F.desc_nulls_last("ic_mean"), "name")


def latest_batch(df: DataFrame, batch: str) -> DataFrame:
    """The rows of the greatest batch."""
    return df.join(F.broadcast(df.agg(F.max(batch).alias(batch))), batch).select(*df.columns)


def quota(candidates: DataFrame, key: str, score: str, name: str, most: int = 3) -> DataFrame:
    """At most so many candidates of one structure: the best by score, then by name."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(score), name)
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def search(df: DataFrame, columns: list[str], words: str, order: str, most: int = 20) -> DataFrame:
    """Rows with the words in one of the columns, whatever their case; the first by order."""
    hit = reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(words.lower()) for c in columns))
    return df.where(hit).orderBy(order).limit(most)


def catalog(df: DataFrame, keyword: str | None = None, category: str | None = None, columns: tuple[str, ...] = ("name", "description")) -> DataFrame:
    """Entries of a category that have the keyword in one of the columns; null filters let all pass."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if keyword:
        df = df.where(reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(keyword.lower()) for c in columns)))
    return df


# --- news ------------------------------------------------------------------


def sectors(text: Column, words: dict[str, list[str]] = lexicon.SECTORS) -> Column:
    """Names of the sectors with a word in the text, in the order of the table."""
    table = F.array(*[F.struct(F.lit(s).alias("sector"), F.array(*map(F.lit, ws)).alias("words")) for s, ws in words.items()])
    return F.transform(F.filter(table, lambda s: _has(text, s["words"])), lambda s: s["sector"])


def _has(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def impact(text: Column, score: Column, high: list[str] = lexicon.HIGH_IMPACT, medium: list[str] = lexicon.MEDIUM_IMPACT) -> Column:
    """``high`` for a high word or a score of 0.5 either way, else ``medium`` for a medium word or 0.25, else ``low``."""
    some = lambda ws: _has(text, F.array(*map(F.lit, ws)))
    return F.when(some(high) | (F.abs(score) >= 0.5), "high").when(some(medium) | (F.abs(score) >= 0.25), "medium").otherwise("low")


def analyzed(news: DataFrame, title: str = "title", summary: str = "summary") -> DataFrame:
    """news with score, label, hits, sectors and impact by the default word lists."""
    text = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    s = sentiment(text, lexicon.POSITIVE | lexicon.NEGATIVE, lexicon.NEGATIONS)
    df = news.withColumn("_t", text).withColumn("_s", s)
    return df.select(*news.columns, "_s.score", "_s.label", "_s.hits", sectors(F.col("_t")).alias("sectors"), impact(F.col("_t"), F.col("_s.score")).alias("impact"))


def unseen(news: DataFrame, stored: DataFrame, title: str, order: str) -> DataFrame:
    """News whose title isn't stored, each title once: the first by order."""
    w = Window.partitionBy(title).orderBy(order)
    return news.join(stored.select(title).distinct(), title, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").select(*news.columns)


def filtered(news: DataFrame, source: str | None = None, label: str | None = None, since: object = None, time: str = "publish_time", most: int = 50) -> DataFrame:
    """The newest news of a source and label since a time; null filters let all pass."""
    for c, v in (("source", source), ("label", label)):
        if v is not None:
            news = news.where(F.col(c) == v)
    if since is not None:
        news = news.where(F.col(time) >= F.lit(since))
    return news.orderBy(F.desc(time)).limit(most)


# --- registered queries ----------------------------------------------------


def _day() -> Column:
    return F.col("trade_date").cast("string").alias("trade_date")


def _kept(x: str) -> str:
    """Nine decimals and twenty significant bits: equal in all engines."""
    return significant(f"round({x}, 9) + CAST(0 AS DOUBLE)")


def _cents(c: str) -> Column:
    return F.expr(_kept(c)).alias(c)


def _factors(panel: DataFrame) -> DataFrame:
    """Test input: a factor in weeks whose volume is divisible by three."""
    return panel.where("volume % 3 = 0").select("ts_code", "trade_date", (1 + F.floor(F.col("volume")) / 100).alias("adj_factor"))


def bars_qfq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return adjusted(p, _factors(p), "qfq").select("ts_code", _day(), F.round("close", 1).alias("close"))


def bars_hfq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return adjusted(p, _factors(p), "hfq").select("ts_code", _day(), F.round("close", 1).alias("close"))


def bars_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(market_panel(spark, sf_dir)).select("ts_code", _day(), "close", "suspicious")


def bars_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return reindexed(p.where("volume > 20"), p, ["open", "close"]).select("ts_code", _day(), "open", "close")


def bars_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    basics = p.where("volume > 20").select("ts_code", "trade_date", "turnover_rate", "total_mv")
    return p.select("ts_code", "trade_date", "close").join(basics, ["ts_code", "trade_date"], "left").select("ts_code", _day(), "close", _cents("turnover_rate"), "total_mv")


def benchmark_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    bench = p.groupBy("trade_date").agg(F.max("high").alias("level")).where("dayofyear(trade_date) % 3 = 0")
    return aligned(bench, p, "level").select(_day(), "level")


def coverage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"))
    return split_covered(master, market_panel(spark, sf_dir), "1995-01-20", "2001-08-01").select("ts_code", F.col("first_day").cast("string"), F.col("last_day").cast("string"), "state")


def universe_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    snaps = p.groupBy("ts_code", F.date_trunc("quarter", "trade_date").cast("date").alias("snap")).agg(F.sum("amount").alias("weight"))
    return members_on(snaps, "1997-05-15")


def delisted_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"))
    return delisted(market_panel(spark, sf_dir), master).select("ts_code", F.col("last_day").cast("string"))


def entry_exit_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    snaps = p.select("ts_code", F.date_trunc("year", "trade_date").cast("date").alias("first_day"), "volume").where("volume > 40").select("ts_code", "first_day").distinct()
    members = snaps.withColumn("end_day", F.add_months("first_day", 12))
    return entry_exit(p, F.col("close") / F.lag("close", 4).over(_by_date()) - 1, members).select("ts_code", _day(), _cents("value"), "entry", "exit", _cents("ret"))


def industry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(_by_date()) - 1)
    means = p.where("r IS NOT NULL").groupBy("industry", "trade_date").agg(F.avg("r").alias("r"))
    return rolling_pairs(means, "industry").select("x", "y", _day(), F.round("corr", 6).alias("corr"))


def attribution_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    return extremes(p.select("ts_code", (F.col("volume") * (F.col("close") - F.col("open"))).alias("pnl")), "ts_code", "pnl")


def trades_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.col("l_shipdate").cast("date").cast("string").alias("trade_date"), side.alias("side")).agg(F.count(F.lit(1)).alias("trades"), F.sum("l_quantity").alias("shares"), F.sum(F.round(F.col("l_extendedprice") * 100)).alias("cents"))


def top_by_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest of each fifth of the securities of a date by turnover."""
    p = market_panel(spark, sf_dir)
    fifth = F.ntile(5).over(Window.partitionBy("trade_date").orderBy("turnover_rate", "ts_code"))
    place = F.row_number().over(Window.partitionBy("trade_date", "fifth").orderBy(F.desc("turnover_rate"), "ts_code"))
    return p.withColumn("fifth", fifth).withColumn("place", place).where("place <= 10").select(_day(), "fifth", "place", "ts_code")


def board_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries by best gain and mean gain; the place is that in the board's order."""
    p = market_panel(spark, sf_dir)
    gain = F.round(F.col("close") / F.col("open") - 1, 6)
    board = p.groupBy(F.col("industry").alias("name")).agg(F.max(gain).alias("max_quantile_excess"), F.round(F.avg(gain), 6).alias("ic_mean"))
    w = Window.orderBy(F.desc_nulls_last("max_quantile_excess"), F.desc_nulls_last("ic_mean"), "name")
    return board_order(board).withColumn("place", F.row_number().over(w))


def newest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), "o_totalprice")
    return latest_batch(o, "o_orderdate")


def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("key"), F.lit("stored").alias("origin")).distinct()
    return union_unnamed(stored, spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("key"), F.lit("built in").alias("origin")), "key")


def structure_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_retailprice"), "p_type", "p_retailprice", "p_partkey")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), ["text", "source"], "License", "doc_id").select("doc_id", "source")


def unseen_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return unseen(d.where("lang = 'en'"), d.where("lang <> 'en'"), "title", "doc_id").select("doc_id", F.sha2("title", 256).alias("title"))


def news_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("").alias("summary"))
    return analyzed(d, "text").select("doc_id", F.array_join("sectors", ",").alias("sectors"), "impact", F.round("score", 3).alias("score"))


def _weighted_sql() -> str:
    words = lexicon.POSITIVE | lexicon.NEGATIVE
    negated = " OR ".join(f"contains(before, '{n}')" for n in lexicon.NEGATIONS)
    table = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in words.items())
    return f"""sums AS (SELECT doc_id, sum(CASE WHEN pos > 1 AND ({negated}) THEN -0.5::DOUBLE * w ELSE w END) AS x FROM (
      SELECT doc_id, w, pos, substr(t, greatest(pos - 3, 1), least(pos - 1, 3)) AS before FROM (SELECT doc_id, t, w, instr(t, word) AS pos FROM d, (VALUES {table}) AS v(word, w)) AS a WHERE pos > 0) AS b GROUP BY doc_id)"""


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_ADJ = f"""WITH p AS ({PANEL_SQL}), f AS (SELECT ts_code, trade_date, 1 + floor(volume) / 100 AS a FROM p WHERE volume % 3 = 0),
  j AS (SELECT p.ts_code, p.trade_date, p.close, coalesce(b.a, (SELECT arg_min(f.a, f.trade_date) FROM f WHERE f.ts_code = p.ts_code), 1) AS a FROM p ASOF LEFT JOIN f AS b ON b.ts_code = p.ts_code AND b.trade_date <= p.trade_date)"""

SQL: dict[str, str] = {
    "bars_qfq": f"{_ADJ} SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, round(round(close * a / arg_max(a, trade_date) OVER (PARTITION BY ts_code), 2), 1) AS close FROM j",
    "bars_hfq": f"{_ADJ} SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, round(round(close * a, 2), 1) AS close FROM j",
    "bars_checked": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS i FROM ({PANEL_SQL}) AS q WHERE open <> 0 OR high <> 0 OR low <> 0 OR close <> 0)
      SELECT p.ts_code, CAST(p.trade_date AS VARCHAR) AS trade_date, p.close, coalesce(abs(p.close / b.close - 1) > 0.22::DOUBLE, false) AS suspicious FROM p LEFT JOIN p AS b ON b.ts_code = p.ts_code AND b.i = p.i - 1""",
    "bars_reindexed": f"""WITH p AS ({PANEL_SQL}) SELECT p.ts_code, CAST(p.trade_date AS VARCHAR) AS trade_date, b.open, b.close
      FROM p ASOF LEFT JOIN (SELECT * FROM p WHERE volume > 20) AS b ON b.ts_code = p.ts_code AND b.trade_date <= p.trade_date""",
    "bars_fundamentals": f"SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, close, CASE WHEN volume > 20 THEN {_kept('turnover_rate')} END AS turnover_rate, CASE WHEN volume > 20 THEN total_mv END AS total_mv FROM ({PANEL_SQL}) AS p",
    "benchmark_aligned": f"""WITH d AS (SELECT trade_date, max(high) AS level FROM ({PANEL_SQL}) AS p GROUP BY 1), b AS (SELECT * FROM d WHERE dayofyear(trade_date) % 3 = 0)
      SELECT CAST(d.trade_date AS VARCHAR) AS trade_date, coalesce(b.level, (SELECT arg_min(level, trade_date) FROM b)) AS level FROM d ASOF LEFT JOIN b ON b.trade_date <= d.trade_date""",
    "coverage_split": f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS ts_code, CAST(lo AS VARCHAR) AS first_day, CAST(hi AS VARCHAR) AS last_day, CASE WHEN lo <= DATE '1995-01-20' AND hi >= DATE '2001-08-01' THEN 'cached' ELSE 'pending' END AS state
      FROM supplier LEFT JOIN (SELECT ts_code, min(trade_date) AS lo, max(trade_date) AS hi FROM ({PANEL_SQL}) AS p GROUP BY 1) AS h ON h.ts_code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ'""",
    "universe_on_date": f"""SELECT ts_code, weight, CAST(row_number() OVER (ORDER BY weight DESC, ts_code) AS INT) AS place FROM (SELECT ts_code, sum(amount) AS weight FROM ({PANEL_SQL}) AS p
      WHERE trade_date >= DATE '1997-04-01' AND trade_date < DATE '1997-07-01' GROUP BY 1) AS w""",
    "delisted_codes": f"SELECT ts_code, CAST(max(trade_date) AS VARCHAR) AS last_day FROM ({PANEL_SQL}) AS p WHERE CAST(substr(ts_code, 1, 6) AS INT) NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    "entry_exit_returns": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS i FROM ({PANEL_SQL}) AS q), m AS (SELECT DISTINCT ts_code, year(trade_date) AS y FROM p WHERE volume > 40)
      SELECT p.ts_code, CAST(p.trade_date AS VARCHAR) AS trade_date, {_kept('p.close / b.close - 1')} AS value, e.open AS entry, x.open AS exit, {_kept('x.open / e.open - 1')} AS ret
      FROM p JOIN p AS b ON b.ts_code = p.ts_code AND b.i = p.i - 4 JOIN p AS e ON e.ts_code = p.ts_code AND e.i = p.i + 1 JOIN p AS x ON x.ts_code = p.ts_code AND x.i = p.i + 5 JOIN m ON m.ts_code = p.ts_code AND m.y = year(p.trade_date)
      WHERE b.close > 0 AND e.open > 0 AND x.open > 0""",
    "industry_pairs": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS i FROM ({PANEL_SQL}) AS q),
      r AS (SELECT a.industry, a.trade_date, avg(a.close / b.close - 1) AS r FROM p AS a JOIN p AS b ON b.ts_code = a.ts_code AND b.i = a.i - 1 GROUP BY 1, 2),
      j AS (SELECT a.industry AS x, b.industry AS y, a.trade_date, a.r AS u, b.r AS v, row_number() OVER (PARTITION BY a.industry, b.industry ORDER BY a.trade_date) AS k FROM r AS a JOIN r AS b ON a.trade_date = b.trade_date AND a.industry < b.industry)
      SELECT x, y, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN su * sv > 1e-12::DOUBLE THEN round(c / (su * sv), 6) ELSE 0::DOUBLE END AS corr FROM (
        SELECT x, y, trade_date, k, covar_pop(u, v) OVER w AS c, stddev_pop(u) OVER w AS su, stddev_pop(v) OVER w AS sv FROM j WINDOW w AS (PARTITION BY x, y ORDER BY k ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS z WHERE k >= 60""",
    "attribution_extremes": f"""WITH s AS (SELECT ts_code, sum(volume * (close - open)) AS pnl FROM ({PANEL_SQL}) AS p GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY pnl DESC, ts_code) AS a, row_number() OVER (ORDER BY pnl, ts_code) AS b FROM s)
      SELECT ts_code, pnl, 'best' AS side FROM k WHERE a <= 5 UNION ALL SELECT ts_code, pnl, 'worst' FROM k WHERE b <= 5""",
    "trades_by_date": "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS trade_date, if(l_returnflag = 'R', 'sell', 'buy') AS side, count(*) AS trades, sum(l_quantity) AS shares, sum(round(l_extendedprice * 100)) AS cents FROM lineitem GROUP BY 1, 2",
    "top_by_quantile": f"""WITH k AS (SELECT trade_date, ts_code, turnover_rate, row_number() OVER (PARTITION BY trade_date ORDER BY turnover_rate, ts_code) - 1 AS i, count(*) OVER (PARTITION BY trade_date) AS n FROM ({PANEL_SQL}) AS p),
      g AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END + 1 AS fifth FROM k)
      SELECT CAST(trade_date AS VARCHAR) AS trade_date, CAST(fifth AS INT) AS fifth, CAST(place AS INT) AS place, ts_code FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, fifth ORDER BY turnover_rate DESC, ts_code) AS place FROM g) AS h WHERE place <= 10""",
    "board_ranking": f"""WITH b AS (SELECT industry AS name, max(g) AS max_quantile_excess, round(avg(g), 6) AS ic_mean FROM (SELECT industry, round(close / open - 1, 6) AS g FROM ({PANEL_SQL}) AS p) AS x GROUP BY 1)
      SELECT *, CAST(row_number() OVER (ORDER BY max_quantile_excess DESC, ic_mean DESC, name) AS INT) AS place FROM b""",
    "newest_batch": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)",
    "catalog_union": "SELECT n_nationkey AS key, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500) THEN 'stored' ELSE 'built in' END AS origin FROM nation",
    "structure_quota": "SELECT p_partkey, p_type, p_retailprice FROM part AS p WHERE (SELECT count(*) FROM part AS q WHERE q.p_type = p.p_type AND (q.p_retailprice > p.p_retailprice OR q.p_retailprice = p.p_retailprice AND q.p_partkey < p.p_partkey)) < 3",
    "text_search": "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%license%' ORDER BY doc_id LIMIT 20",
    "unseen_titles": """WITH d AS (SELECT doc_id, lang, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents)
      SELECT min(doc_id) AS doc_id, sha256(title) AS title FROM d WHERE lang = 'en' AND title NOT IN (SELECT title FROM d WHERE lang <> 'en') GROUP BY d.title""",
    "news_analyzed": f"""WITH d AS (SELECT doc_id, trim(coalesce(text, '') || ' ') AS t FROM documents), {_weighted_sql()},
      s AS (SELECT d.doc_id, t, round(greatest(-1::DOUBLE, least(1::DOUBLE, coalesce(x, 0::DOUBLE))), 3) AS score FROM d LEFT JOIN sums USING (doc_id))
      SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_any(ws)} THEN '{s}' END" for s, ws in lexicon.SECTORS.items())}], lambda z: z IS NOT NULL), ',') AS sectors,
        CASE WHEN {_any(lexicon.HIGH_IMPACT)} OR abs(score) >= 0.5::DOUBLE THEN 'high' WHEN {_any(lexicon.MEDIUM_IMPACT)} OR abs(score) >= 0.25::DOUBLE THEN 'medium' ELSE 'low' END AS impact, score FROM s""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (bars_qfq, bars_hfq, bars_checked, bars_reindexed, bars_fundamentals, benchmark_aligned, coverage_split, universe_on_date, delisted_codes, entry_exit_returns, industry_pairs, attribution_extremes,
                                    trades_by_date, top_by_quantile, board_ranking, newest_batch, catalog_union, structure_quota, text_search, unseen_titles, news_analyzed)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
