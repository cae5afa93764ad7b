"""Registered queries of table maintenance: range scans, upserts, gaps, marks, texts and codes, pages, fees.

The oracles are written by hand and share no text with the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.panel import PANEL_SQL, market_panel
from . import analysis, catalog

# Commission rate, least commission, slippage and stamp tax of each kind of account.
BROKERS = {
    "散户": (0.0003, 5.0, 0.002, 0.001),
    "折扣券商": (0.00015, 5.0, 0.001, 0.001),
    "机构": (0.00008, 0.0, 0.0005, 0.001),
    "ETF": (0.00005, 0.1, 0.0003, 0.0),
}


def with_fees(trades: DataFrame, amount: Column, sells: Column, presets: dict[str, tuple[float, float, float, float]] = BROKERS) -> DataFrame:
    """A row per trade and preset: commission, slippage and (for sales) stamp tax on the amount."""
    table = F.array(*[F.struct(F.lit(n).alias("preset"), *[F.lit(v).alias(k) for k, v in zip(("rate", "least", "slip", "tax"), row, strict=True)]) for n, row in presets.items()])
    df = trades.withColumn("_a", amount).withColumn("_s", sells).withColumn("_b", F.explode(table))
    fees = [F.greatest(F.col("_a") * F.col("_b.rate"), F.col("_b.least")).alias("commission"), (F.col("_a") * F.col("_b.slip")).alias("slippage"), F.when(F.col("_s"), F.col("_a") * F.col("_b.tax")).otherwise(0.0).alias("stamp_tax")]
    return df.select(*trades.columns, "_b.preset", *fees)


def _day(c: str = "trade_date") -> Column:
    return F.col(c).cast("string").alias(c)


def _code(key: str) -> Column:
    return F.concat(F.lpad(F.col(key).cast("string"), 6, "0"), F.lit(".SZ"))


def bars_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each security's bars of its own two years."""
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 1500).cast("int"))
    requests = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(_code("s_suppkey").alias("ts_code"), start.alias("start")).withColumn("end", F.date_add("start", 730))
    return tables.scan_ranges(market_panel(spark, sf_dir), requests).select("ts_code", _day(), "close")


def bars_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin weeks come anew, with twice the close and four weeks that weren't there."""
    p = market_panel(spark, sf_dir).select("ts_code", "trade_date", "close", "volume")
    thin = p.where("volume <= 10")
    later = p.groupBy("ts_code").agg(F.date_add(F.max("trade_date"), 28).alias("trade_date")).withColumn("close", F.lit(1.0))
    new = thin.select("ts_code", "trade_date", (F.col("close") * 2).alias("close")).unionByName(later)
    return tables.upsert(p.drop("volume"), new, ["ts_code", "trade_date"]).select("ts_code", _day(), "close")


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.latest(o, ["o_custkey"], "o_orderkey")


def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir)
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(_code("s_suppkey").alias("ts_code"))
    return tables.missing_segments(p.where("volume > 20"), p, codes).select("ts_code", _day("first_day"), _day("last_day"), "days")


def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market_panel(spark, sf_dir).select("ts_code", "trade_date", "close", "volume")
    stored, source = p.where("volume > 20").withColumn("origin", F.lit("stored")), p.withColumn("origin", F.lit("fetched"))
    return tables.fill_gaps(stored, source, ["ts_code", "trade_date"]).select("ts_code", _day(), "close", "origin")


def pinned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.marked(o, o.where("o_totalprice > 300000"), ["o_orderkey"], "pinned").select("o_orderkey", "pinned")


def newest_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty English documents; the id stands for the time."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.col("lang").alias("label"))
    return catalog.filtered(d, label="en", time="doc_id")


def parts_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"))
    return catalog.catalog(p, "RING", "ECONOMY").select("p_partkey", "name")


def orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a hundred orders by key."""
    return analysis.page_after(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey", 99, 100)


def texts_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2(analysis.clean_text(F.coalesce("text", F.lit(""))), 256).alias("text"))


def codes_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")).alias("code"), "p_partkey")
    return analysis.clean_codes(p, "code", "p_partkey")


def warm_up_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_day"))
    return o.select("o_custkey", analysis.warm_up_start(F.col("first_day")).cast("string").alias("start"))


def broker_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    f = with_fees(o, F.col("o_totalprice"), F.col("o_orderstatus") == "F")
    return f.select("o_orderkey", "preset", "commission", "slippage", "stamp_tax")


_PRESETS = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for n, (a, b, c, d) in BROKERS.items())

SQL: dict[str, str] = {
    "bars_ranges": f"SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, close FROM ({PANEL_SQL}) AS p WHERE date_diff('day', DATE '1995-01-01', trade_date) - CAST(substr(ts_code, 1, 6) AS INT) % 1500 BETWEEN 0 AND 730",
    "bars_upsert": f"""WITH p AS ({PANEL_SQL}) SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN volume <= 10 THEN 2 * close ELSE close END AS close FROM p
      UNION ALL SELECT ts_code, CAST(max(trade_date) + 28 AS VARCHAR), 1 FROM p GROUP BY 1""",
    "newest_orders": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "missing_runs": f"""WITH p AS ({PANEL_SQL}), c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM p) AS d),
      g AS (SELECT s.ts_code, c.trade_date, c.i - row_number() OVER (PARTITION BY s.ts_code ORDER BY c.i) AS k FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS ts_code FROM supplier) AS s, c
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts_code = s.ts_code AND p.trade_date = c.trade_date AND volume > 20))
      SELECT ts_code, CAST(min(trade_date) AS VARCHAR) AS first_day, CAST(max(trade_date) AS VARCHAR) AS last_day, count(*) AS days FROM g GROUP BY ts_code, k""",
    "gaps_filled": f"SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, close, if(volume > 20, 'stored', 'fetched') AS origin FROM ({PANEL_SQL}) AS p",
    "pinned_orders": "SELECT o_orderkey, o_totalprice > 300000 AS pinned FROM orders",
    "newest_news": "SELECT doc_id, source, lang AS label FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 50",
    "parts_by_keyword": "SELECT p_partkey, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%')",
    "orders_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 100",
    "texts_cleaned": r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\x00-\x20\x7F]+', ' ', 'g'))) AS text FROM documents",
    "codes_cleaned": "SELECT upper(p_brand) AS code, min(p_partkey) AS p_partkey FROM part WHERE p_brand <> '' GROUP BY 1",
    "warm_up_days": "SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) - 540 AS VARCHAR) AS start FROM orders GROUP BY 1",
    "broker_fees": f"""SELECT o_orderkey, preset, greatest(o_totalprice * rate, least_fee) AS commission, o_totalprice * slip AS slippage,
      CASE WHEN o_orderstatus = 'F' THEN o_totalprice * tax ELSE 0::DOUBLE END AS stamp_tax FROM orders, (VALUES {_PRESETS}) AS v(preset, rate, least_fee, slip, tax)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (bars_ranges, bars_upsert, newest_orders, missing_runs, gaps_filled, pinned_orders, newest_news, parts_by_keyword, orders_page, texts_cleaned, codes_cleaned, warm_up_days, broker_fees)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
