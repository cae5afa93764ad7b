"""Which bought shares each sale sells: first in, first out, as one sweep.

A security's shares are numbered in the order in which they are bought; a lot ends at the sum of all
purchases so far, a sale at the sum of all shares sold so far. Both kinds of ends are sorted
together, and each stretch between neighbours belongs to the lot and to the sale that end next: going
down, that is the last one seen. So nothing is joined by ranges, and a security's trades are read
once in order.

A sale of more than is held sells what is held; the rest is matched with nothing. How much was
refused by then is the greatest lead of sales over purchases so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compile import significant
from ..sources.panel import PANEL_SQL, market_panel

_KEY = "ts_code"


def _ordered(trades: DataFrame) -> DataFrame:
    """Trades with a code, shares and a price, numbered within their security: by date, purchases first, then by ``trade_no``."""
    order = [F.col("trade_date"), F.when(F.col("side") == "buy", 0).otherwise(1), F.col("trade_no")]
    known = trades.where((F.trim(_KEY) != "") & (F.col("shares") > 0) & (F.col("price") > 0))
    return known.withColumn("no", F.row_number().over(Window.partitionBy(_KEY).orderBy(*order)))


def match_lots(trades: DataFrame, refuse: bool = True) -> DataFrame:
    """(ts_code, buy_no, sell_no, shares): shares of a purchase that a sale sold; sell_no is null for shares still held, buy_no for
    shares that were sold but not held. ``trades`` has ts_code, no (1, 2, ... in order), side ('buy', else a sale) and shares
    (whole, positive). With ``refuse`` false, sales may be met by later purchases."""
    w = Window.partitionBy(_KEY).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "buy"
    sums = trades.select(_KEY, "no", buy.alias("buy"), F.col("shares").cast("long").alias("shares"))
    sums = sums.withColumn("bought", F.sum(F.when(F.col("buy"), F.col("shares")).otherwise(0)).over(w)).withColumn("sold", F.sum(F.when(F.col("buy"), 0).otherwise(F.col("shares"))).over(w))
    lead = F.greatest(F.lit(0), F.max(F.col("sold") - F.col("bought")).over(w)) if refuse else F.lit(0)
    sums = sums.withColumn("refused", lead.cast("long"))
    gone = F.col("refused") - F.coalesce(F.lag("refused", 1).over(Window.partitionBy(_KEY).orderBy("no")), F.lit(0))
    sums = sums.withColumn("gone", gone)
    end = F.when(F.col("buy"), F.col("bought")).otherwise(F.col("sold") - F.col("refused"))
    ends = sums.where(F.col("buy") | (F.col("shares") > F.col("gone"))).select(_KEY, end.alias("end"), F.when(F.col("buy"), F.col("no")).alias("lot"), F.when(~F.col("buy"), F.col("no")).alias("sale"))
    down = Window.partitionBy(_KEY).orderBy(F.col("end").desc(), "lot", "sale")
    seen = down.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select(_KEY, F.last("lot", ignorenulls=True).over(seen).alias("buy_no"), F.last("sale", ignorenulls=True).over(seen).alias("sell_no"), (F.col("end") - F.lead("end", 1, 0).over(down)).alias("shares"))
    refused = sums.where(F.col("gone") > 0).select(_KEY, F.lit(None).cast("int").alias("buy_no"), F.col("no").alias("sell_no"), F.col("gone").alias("shares"))
    return pieces.where("shares > 0").unionByName(refused)


def stock_pnl(trades: DataFrame, last_prices: DataFrame, initial_cash: float) -> DataFrame:
    """Profit and loss per security of trades (ts_code, trade_date, trade_no, side, shares, price, fees): buy_cost and sell_income with fees, realized_pnl
    against the cost of the lots sold (shares that were not held cost their own price), unrealized_pnl of open lots at
    ``last_prices`` (ts_code, last_price; 0 where there is none), total_pnl, contribution_pct of the cash at the start, counts of trades,
    and the position, its cost and its price at the end. Trades without code, shares or price are left out."""
    t = _ordered(trades)
    gross = F.col("shares") * F.col("price")
    buy = F.col("side") == "buy"
    cash = F.when(buy, gross + F.col("fees")).otherwise(gross - F.col("fees"))
    sums = t.groupBy(_KEY).agg(
        F.sum(F.when(buy, cash).otherwise(0.0)).alias("buy_cost"), F.sum(F.when(~buy, cash).otherwise(0.0)).alias("sell_income"),
        F.count_if(buy).alias("buy_count"), F.count_if(~buy).alias("sell_count"))
    lots = t.where(buy).select(_KEY, F.col("no").alias("buy_no"), (cash / F.col("shares")).alias("unit"))
    sales = t.where(~buy).select(_KEY, F.col("no").alias("sell_no"), F.col("price").alias("own"))
    pieces = match_lots(t).join(lots, [_KEY, "buy_no"], "left").join(sales, [_KEY, "sell_no"], "left")
    sold = F.col("sell_no").isNotNull()
    cost = F.col("shares") * F.coalesce("unit", "own")
    held = pieces.groupBy(_KEY).agg(
        F.sum(F.when(sold, cost).otherwise(0.0)).alias("matched"), F.sum(F.when(sold, 0).otherwise(F.col("shares"))).alias("ending_position"), F.sum(F.when(sold, 0.0).otherwise(cost)).alias("ending_cost"))
    out = sums.join(held, _KEY).join(last_prices.select(_KEY, "last_price"), _KEY, "left")
    price = F.when(F.col("last_price") > 0, F.col("last_price")).otherwise(0.0)
    realized = F.col("sell_income") - F.col("matched")
    unrealized = F.when((F.col("ending_position") > 0) & (price > 0), F.col("ending_position") * price - F.col("ending_cost")).otherwise(0.0)
    total = realized + unrealized
    share = total / initial_cash * 100 if initial_cash > 0 else F.lit(0.0)
    return out.select(
        _KEY, "buy_cost", "sell_income", realized.alias("realized_pnl"), unrealized.alias("unrealized_pnl"), total.alias("total_pnl"), share.alias("contribution_pct"),
        (F.col("buy_count") + F.col("sell_count")).alias("trade_count"), "buy_count", "sell_count", "ending_position", "ending_cost", price.alias("ending_price"))


def fifo_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares sold and their profit, every third bar being a sale, by totals alone: sales may be met by later purchases."""
    w = Window.partitionBy(_KEY).orderBy("trade_date")
    t = market_panel(spark, sf_dir).select(_KEY, F.col("volume").cast("long").alias("shares"), "close", F.row_number().over(w).alias("no"))
    t = t.withColumn("side", F.when(F.col("no") % 3 == 0, "sell").otherwise("buy"))
    price = t.select(_KEY, "no", "close")
    met = match_lots(t, refuse=False).where("buy_no IS NOT NULL AND sell_no IS NOT NULL")
    met = met.join(price.select(_KEY, F.col("no").alias("buy_no"), F.col("close").alias("paid")), [_KEY, "buy_no"]).join(price.select(_KEY, F.col("no").alias("sell_no"), F.col("close").alias("got")), [_KEY, "sell_no"])
    return met.groupBy(_KEY).agg(F.sum("shares").alias("matched"), F.sum(F.col("shares") * (F.col("got") - F.col("paid"))).alias("pnl"))


def stock_pnl_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third bar sells twice its volume, which is more than is held at times."""
    w = Window.partitionBy(_KEY).orderBy("trade_date")
    p = market_panel(spark, sf_dir).withColumn("trade_no", F.row_number().over(w))
    sale = F.col("trade_no") % 3 == 0
    shares = F.col("volume").cast("long") * F.when(sale, 2).otherwise(1)
    fees = F.floor(F.col("close") * shares / 1000) + F.when(sale, F.floor(F.col("close") * shares / 500)).otherwise(0)
    trades = p.select(_KEY, "trade_date", "trade_no", F.when(sale, "sell").otherwise("buy").alias("side"), shares.alias("shares"), F.col("close").alias("price"), fees.cast("double").alias("fees"))
    last = p.groupBy(_KEY).agg(F.max_by("close", "trade_date").alias("last_price"))
    out = stock_pnl(trades, last, 1e9)
    exact = {_KEY, "trade_count", "buy_count", "sell_count", "ending_position"}
    return out.selectExpr(*[c if c in exact else f"{significant(f'round({c}, 2)', 24)} AS {c}" for c in out.columns])


def _stock_pnl_sql() -> str:
    """The same by joins of ranges; refused shares by a sum over all earlier trades' greatest lead."""
    num = lambda x, name: f"{significant(f'round({x}, 2)', 24)} AS {name}"
    return f"""WITH t AS (
      SELECT ts_code, trade_date, CAST(volume AS BIGINT) * CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END AS q, close, i, i % 3 = 0 AS sale
      FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS i FROM ({PANEL_SQL})) AS p),
    f AS (SELECT *, floor(close * q / 1000) + CASE WHEN sale THEN floor(close * q / 500) ELSE 0 END AS fee,
      sum(CASE WHEN sale THEN 0 ELSE q END) OVER w AS b, sum(CASE WHEN sale THEN q ELSE 0 END) OVER w AS s FROM t WINDOW w AS (PARTITION BY ts_code ORDER BY i)),
    g AS (SELECT *, greatest(0, max(s - b) OVER (PARTITION BY ts_code ORDER BY i)) AS refused FROM f),
    h AS (SELECT *, s - refused AS hi, q - (refused - coalesce(lag(refused) OVER (PARTITION BY ts_code ORDER BY i), 0)) AS real_ FROM g),
    met AS (
      SELECT x.ts_code, x.i, sum((least(x.hi, y.b) - greatest(x.hi - x.real_, y.b - y.q)) * ((y.q * y.close + y.fee) / y.q)) AS cost
      FROM h x JOIN h y ON x.ts_code = y.ts_code AND x.sale AND NOT y.sale AND y.b - y.q < x.hi AND x.hi - x.real_ < y.b GROUP BY 1, 2),
    sells AS (SELECT h.ts_code, sum(q * close - fee) AS income, sum(coalesce(m.cost, 0) + (q - real_) * close) AS cost, count(*) AS n, max(hi) AS gone FROM h LEFT JOIN met m ON m.ts_code = h.ts_code AND m.i = h.i WHERE sale GROUP BY 1),
    buys AS (SELECT ts_code, sum(q * close + fee) AS cost, count(*) AS n FROM h WHERE NOT sale GROUP BY 1),
    open_ AS (SELECT h.ts_code, sum(least(q, b - coalesce(s.gone, 0))) AS n, sum(least(q, b - coalesce(s.gone, 0)) * ((q * close + fee) / q)) AS cost FROM h LEFT JOIN sells s ON s.ts_code = h.ts_code WHERE NOT sale AND b > coalesce(s.gone, 0) GROUP BY 1),
    last_ AS (SELECT ts_code, arg_max(close, trade_date) AS price FROM t GROUP BY 1),
    r AS (SELECT b.ts_code, b.cost AS buy_cost, coalesce(s.income, 0) AS income, coalesce(s.income, 0) - coalesce(s.cost, 0) AS realized, coalesce(o.n, 0) AS n, coalesce(o.cost, 0) AS held, l.price, b.n AS bs, coalesce(s.n, 0) AS ss
      FROM buys b LEFT JOIN sells s ON s.ts_code = b.ts_code LEFT JOIN open_ o ON o.ts_code = b.ts_code JOIN last_ l ON l.ts_code = b.ts_code)
    SELECT ts_code, {num('buy_cost', 'buy_cost')}, {num('income', 'sell_income')}, {num('realized', 'realized_pnl')}, {num('CASE WHEN n > 0 THEN n * price - held ELSE 0 END', 'unrealized_pnl')},
      {num('realized + CASE WHEN n > 0 THEN n * price - held ELSE 0 END', 'total_pnl')}, {num('(realized + CASE WHEN n > 0 THEN n * price - held ELSE 0 END) / 1000000000 * 100', 'contribution_pct')},
      CAST(bs + ss AS BIGINT) AS trade_count, CAST(bs AS BIGINT) AS buy_count, CAST(ss AS BIGINT) AS sell_count, CAST(n AS BIGINT) AS ending_position, {num('held', 'ending_cost')}, {num('price', 'ending_price')} FROM r"""


FIFO_SQL = f"""WITH t AS (SELECT ts_code, CAST(volume AS BIGINT) AS q, close, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS i FROM ({PANEL_SQL}) AS p),
  buys AS (SELECT ts_code, q, close, sum(q) OVER (PARTITION BY ts_code ORDER BY i) AS hi FROM t WHERE i % 3 <> 0),
  sells AS (SELECT ts_code, q, close, sum(q) OVER (PARTITION BY ts_code ORDER BY i) AS hi FROM t WHERE i % 3 = 0)
  SELECT s.ts_code, CAST(sum(least(s.hi, b.hi) - greatest(s.hi - s.q, b.hi - b.q)) AS BIGINT) AS matched, sum((least(s.hi, b.hi) - greatest(s.hi - s.q, b.hi - b.q)) * (s.close - b.close)) AS pnl
  FROM sells s JOIN buys b ON b.ts_code = s.ts_code AND b.hi - b.q < s.hi AND s.hi - s.q < b.hi GROUP BY s.ts_code"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"fifo_pnl": fifo_pnl, "stock_pnl": stock_pnl_full}


def oracle_sql() -> dict[str, str]:
    return {"fifo_pnl": FIFO_SQL, "stock_pnl": _stock_pnl_sql()}
