"""The market panel: one row per security and trading date.

``weekly_bars`` derives a deterministic panel from order lines (security: supplier,
date: ship week, price: cents per unit), so that every operator can be checked on
the test tables; ``market_panel`` keeps it as a table, built once; ``normalize`` brings any bars to the same columns. ``PANEL_SQL`` is the same
panel for an ANSI engine. Prices and amounts are whole cents: sums are exact in any
order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import FIRST, LAST, PanelStore, fingerprint
from .work import work_dir

#: Most rows of a security in ``market_panel``: its bars are weekly.
HISTORY = 4096
#: Order lines of a bucket of the panel's table, about: a task holds a bucket, so its memory does not follow the input.
LINES = 100_000

#: Names under which bars may come.
ALIASES = {"vol": "volume", "code": "ts_code", "symbol": "ts_code", "date": "trade_date"}


_STORES: dict[tuple[str, str], PanelStore] = {}


def market_panel(spark: SparkSession, sf_dir: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The bars of ``weekly_bars`` from first to last, or all, from a table bucketed by security; days that it does not cover yet are
    built. The table is the input files': others, or changed ones, have another. Without a shared folder bars are built anew."""
    store = _store(spark, sf_dir)
    return store.read(first, last) if store else weekly_bars(spark, sf_dir, first, last)


def market_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many tasks rows of ``market_panel`` are dealt: its buckets, if there is a table."""
    store = _store(spark, sf_dir)
    return store.buckets if store else None


def _store(spark: SparkSession, sf_dir: str) -> PanelStore | None:
    try:
        folder = work_dir(spark)
    except ValueError:
        return None
    key = fingerprint(spark, [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet"])
    app = spark.sparkContext.applicationId
    if (app, key) not in _STORES:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # from the files' footers
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // LINES))
        _STORES[app, key] = PanelStore(spark, f"{folder}/panel-{app}-{key}", lambda a, b, n: weekly_bars(spark, sf_dir, a, b, n), buckets, dealt=True)
    return _STORES[app, key]


def weekly_bars(spark: SparkSession, sf_dir: str, first: dt.date | None = None, last: dt.date | None = None, parts: int | None = None) -> DataFrame:
    """Bars of the weeks that begin from first to last: only their order lines are read. With ``parts`` order lines are dealt into so many tasks by
    ts_code, once and as they are: bars are made where their lines are, by sorts of a task's share, and stay there."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    if first and first > FIRST:
        li = li.where(F.col("l_shipdate") >= F.lit(first))
    if last and last < LAST - dt.timedelta(7):
        li = li.where(F.col("l_shipdate") < F.lit(last + dt.timedelta(7)))
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    code = lambda key: F.concat(F.lpad(F.col(key).cast("string"), 6, "0"), F.lit(".SZ"))
    li = li.withColumn("ts_code", code("l_suppkey"))
    if parts:
        li = li.repartition(parts, "ts_code")
    bars = li.groupBy("ts_code", "l_suppkey", F.date_trunc("week", "l_shipdate").cast("date").alias("trade_date")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum(F.round(F.col("l_extendedprice") * 100)).alias("amount"))
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    # securities are a dimension that follows the scale: the join is left to the planner
    sup = sup.withColumn("s_code", code("s_suppkey"))
    b = bars.join(sup, (bars["ts_code"] == sup["s_code"]) & (bars["l_suppkey"] == sup["s_suppkey"]))
    key = F.col("s_suppkey")
    if last and last < LAST:
        b = b.where(F.col("trade_date") <= F.lit(last))
    if first and first > FIRST:
        b = b.where(F.col("trade_date") >= F.lit(first))
    return b.select(
        "ts_code", "trade_date", "open", "high", "low", "close", "volume", "amount",
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("industry"), (F.abs("s_acctbal") + 1000).alias("total_mv"), ((F.abs("s_acctbal") + 1000) * 0.8).alias("circ_mv"),
        (F.col("close") / (1000 + key % 7)).alias("pe"), (F.col("close") / (9000 + key % 11)).alias("pb"), (F.col("close") / (3000 + key % 5)).alias("ps"), (F.col("volume") / (1 + key % 13)).alias("turnover_rate"))


PANEL_SQL = """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS ts_code, trade_date, open, high, low, close, volume, amount,
       'N' || CAST(s_nationkey AS VARCHAR) AS industry, abs(s_acctbal) + 1000 AS total_mv, (abs(s_acctbal) + 1000) * CAST(0.8 AS DOUBLE) AS circ_mv,
       close / (1000 + s_suppkey % 7) AS pe, close / (9000 + s_suppkey % 11) AS pb, close / (3000 + s_suppkey % 5) AS ps, volume / (1 + s_suppkey % 13) AS turnover_rate
FROM (
  SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
         first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS volume, sum(round(l_extendedprice * 100)) AS amount
  FROM (SELECT *, floor(l_extendedprice * 100 / l_quantity) AS p FROM lineitem) AS x
  GROUP BY 1, 2) AS bars JOIN supplier ON l_suppkey = s_suppkey
"""
COLUMNS = frozenset("ts_code trade_date open high low close volume amount industry total_mv circ_mv pe pb ps turnover_rate".split())


def normalize(bars: DataFrame) -> DataFrame:
    """Bars with the panel's column names, dates as DATE, one row per key (the last
    of repeated ones by close), NaN and infinities as NULL; a missing open is the previous close
    and a missing amount volume times close."""
    df = bars
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if dict(df.dtypes)["trade_date"] == "string":
        df = df.withColumn("trade_date", F.to_date(F.regexp_replace(F.substring("trade_date", 1, 10), "-", ""), "yyyyMMdd"))
    df = df.withColumn("trade_date", F.col("trade_date").cast("date"))
    for c, t in df.dtypes:
        if t in ("double", "float"):
            df = df.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))
    from pyspark.sql import Window

    w = Window.partitionBy("ts_code").orderBy("trade_date")
    newest = Window.partitionBy("ts_code", "trade_date").orderBy(F.col("close").desc_nulls_last())
    df = df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    if "open" not in df.columns:
        df = df.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    if "amount" not in df.columns:
        df = df.withColumn("amount", F.col("volume") * F.col("close"))
    return df
