"""Positions of a stream of trades under next-day settlement, a state per key.

What is bought today can be sold from tomorrow on; a sale of more than is sellable is cut to that. Events wait in
the state until the watermark has passed them and then take effect in order of time and id, so that neither lateness within the
watermark nor the cut into micro-batches shows in the result; an event that comes again while it waits is the same event, and one that comes
after the watermark is dropped. ``settled`` is the same on a table, with window functions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of the result; ``since`` counts the key's events since the last one whose price jumped (0: it was this one).
RESULT = "code string, time timestamp, event_id bigint, side string, shares bigint, accepted bigint, held bigint, sellable bigint, since bigint"
#: A price jumps where it is so many times the one before, at least.
JUMP = 1.2


class Positions(StatefulProcessor):
    """Account: shares held and sellable, the day they are of, events since a jump, the last price. Waiting: events by time and id."""

    def __init__(self, jump: float = JUMP):
        self.jump = jump

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "held bigint, sellable bigint, day bigint, since bigint, price double")
        self.waiting = handle.getMapState("waiting", "micros bigint, event_id bigint", "side string, shares bigint, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            micros = pdf["time"].astype("datetime64[us]").astype("int64")
            for t, e, side, n, price in zip(micros, pdf["event_id"], pdf["side"], pdf["shares"], pdf["price"], strict=True):
                at = (int(t), int(e))
                if t > mark and not self.waiting.containsKey(at):
                    self.waiting.updateValue(at, (side, int(n), None if pd.isna(price) else float(price)))
                    self.handle.registerTimer(-(-int(t) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= mark)
        if not due:
            return
        held, sellable, day, since, last = self.account.get() if self.account.exists() else (0, 0, None, None, None)
        out = []
        for (t, e), (side, n, price) in due:
            if day is None or t // 86_400_000_000 > day:
                day, sellable = t // 86_400_000_000, held
            accepted = n if side == "buy" else min(n, sellable)
            held += accepted if side == "buy" else -accepted
            sellable -= 0 if side == "buy" else accepted
            jumped = price is not None and last is not None and price >= self.jump * last
            since = 0 if jumped else None if since is None else since + 1
            last = price if price is not None else last
            out.append((key[0], pd.Timestamp(t, unit="us"), e, side, n, accepted, held, sellable, since))
            self.waiting.removeKey((t, e))
        self.account.update((held, sellable, day, since, last))
        frame = pd.DataFrame(out, columns=["code", "time", "event_id", "side", "shares", "accepted", "held", "sellable", "since"])
        yield frame.astype({"since": "Int64"})

    def close(self) -> None:
        pass


def positions(events: DataFrame, late: str = "1 hour", jump: float = JUMP) -> DataFrame:
    """``RESULT`` rows of a stream of events (code, time, event_id, side, shares, price), each once the watermark has passed it. The session
    needs the RocksDB state store (``STORE``); state is an account per key and what waits for the watermark."""
    marked = events.withWatermark("time", late)
    return marked.groupBy("code").transformWithStateInPandas(Positions(jump), RESULT, "Append", "EventTime")


#: Session setting that ``positions`` needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def settled(events: DataFrame, jump: float = JUMP) -> DataFrame:
    """``RESULT`` rows of a table of events. Over days, what stays of a position is a sum that is held at zero from below: the sum of changes
    less its least value so far. Within a day, sales share what was held at its start in order. Events that repeat code, time and id are one."""
    e = events.dropDuplicates(["code", "time", "event_id"])
    buy = F.col("side") == "buy"
    e = e.withColumn("day", F.to_date("time")).withColumn("b", F.when(buy, F.col("shares")).otherwise(0)).withColumn("s", F.when(buy, 0).otherwise(F.col("shares")))
    days = e.groupBy("code", "day").agg(F.sum("b").alias("bought"), F.sum("s").alias("sold"))
    w = Window.partitionBy("code").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce(F.lag("bought", 1).over(w), F.lit(0)) - F.col("sold")
    days = days.withColumn("change", change).withColumn("path", F.sum("change").over(upto))
    days = days.withColumn("rest", F.col("path") - F.least(F.lit(0), F.min("path").over(upto)))
    start = F.coalesce(F.lag("rest", 1).over(w) + F.lag("bought", 1).over(w), F.lit(0))
    days = days.select(F.col("code").alias("_code"), F.col("day").alias("_day"), start.alias("start"))
    own = Window.partitionBy("code", "day").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("b_upto", F.sum("b").over(own)).withColumn("s_upto", F.sum("s").over(own))
    e = e.join(days, (F.col("code") == F.col("_code")) & (F.col("day") == F.col("_day")))
    gone, before = F.least("s_upto", "start"), F.least(F.col("s_upto") - F.col("s"), F.col("start"))
    order = Window.partitionBy("code").orderBy("time", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("no", F.row_number().over(order)).withColumn("last", F.last("price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("jumped", F.when(F.col("price") >= jump * F.col("last"), F.col("no")))
    since = F.col("no") - F.max("jumped").over(so_far)
    return e.select(
        "code", "time", "event_id", "side", "shares", F.when(buy, F.col("shares")).otherwise(gone - before).alias("accepted"), (F.col("start") - gone + F.col("b_upto")).alias("held"),
        (F.col("start") - gone).alias("sellable"), since.cast("long").alias("since"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of their user: every third sells."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = F.when(F.col("event_id") % 3 == 0, "sell").otherwise("buy")
    return e.select((F.col("user_id") % 97).alias("code"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").cast("long").alias("event_id"), side.alias("side"), (F.col("event_id") % 9 + F.when(side == "sell", 12).otherwise(1)).cast("long").alias("shares"), F.col("value").cast("double").alias("price"))


def settled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(_trades(spark, sf_dir)).select("code", "event_id", "side", "accepted", "held", "sellable", "since")


#: The rule itself, an event a step.
SETTLED_SQL = f"""WITH RECURSIVE t AS (
  SELECT user_id % 97 AS code, ts, CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side,
         CAST(event_id % 9 + CASE WHEN event_id % 3 = 0 THEN 12 ELSE 1 END AS BIGINT) AS shares, CAST(value AS DOUBLE) AS price FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, event_id) AS i, CAST(ts AS DATE) AS day,
         last_value(price IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ FROM t),
walk AS (
  SELECT code, i, day, event_id, side, CASE WHEN side = 'buy' THEN shares ELSE 0 END AS accepted, CASE WHEN side = 'buy' THEN shares ELSE 0 END AS held, CAST(0 AS BIGINT) AS sellable, CAST(NULL AS BIGINT) AS since
  FROM n WHERE i = 1
  UNION ALL
  SELECT code, i, day, event_id, side, CASE WHEN side = 'buy' THEN shares ELSE least(shares, can) END, held + CASE WHEN side = 'buy' THEN shares ELSE -least(shares, can) END, can - CASE WHEN side = 'buy' THEN 0 ELSE least(shares, can) END,
         CASE WHEN jumped THEN 0 ELSE since + 1 END
  FROM (SELECT n.code, n.i, n.day, n.event_id, n.side, n.shares, w.held, w.since, CASE WHEN n.day > w.day THEN w.held ELSE w.sellable END AS can, coalesce(n.price >= {JUMP}::DOUBLE * n.last_, false) AS jumped
        FROM walk w JOIN n ON n.code = w.code AND n.i = w.i + 1))
SELECT code, event_id, side, accepted, held, sellable, since FROM walk"""


def queries():
    return {"settled_positions": settled_positions}


def oracle_sql():
    return {"settled_positions": SETTLED_SQL}
