"""Table maintenance: upserts, gaps against a calendar, range scans, adjusted prices, result logs, sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_segments(bars: DataFrame, calendar: DataFrame, codes: DataFrame) -> DataFrame:
    """(ts_code, first_day, last_day, days): runs of calendar dates without bars, for each of ``codes``. Neighbouring
    bars are compared by their places in the calendar, so no missing date becomes a row."""
    days = calendar.select("trade_date").distinct()
    days = F.broadcast(days.select("trade_date", F.row_number().over(Window.orderBy("trade_date")).alias("i")))  # a few thousand dates
    codes = codes.select("ts_code").distinct()
    have = bars.select("ts_code", "trade_date").distinct().join(days, "trade_date").join(codes, "ts_code", "left_semi").select("ts_code", "i")
    w = Window.partitionBy("ts_code").orderBy("i")
    gaps = codes.withColumn("i", F.lit(0)).unionByName(have).select("ts_code", (F.col("i") + 1).alias("a"), (F.lead("i").over(w) - 1).alias("b")).where("b IS NULL OR b >= a")
    last = F.broadcast(days.agg(F.max("i").alias("n"), F.max("trade_date").alias("end")))
    gaps = gaps.join(last, F.col("a") <= F.col("n")).join(days.select(F.col("i").alias("a"), F.col("trade_date").alias("first_day")), "a")
    gaps = gaps.join(days.select(F.col("i").alias("b"), F.col("trade_date").alias("_b")), "b", "left")
    return gaps.select("ts_code", "first_day", F.coalesce("_b", "end").alias("last_day"), (F.coalesce("b", "n") - F.col("a") + 1).cast("long").alias("days"))


def fill_gaps(stored: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """stored, and the rows of source whose key it lacks."""
    return stored.unionByName(source.join(stored.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def scan_ranges(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Bars of each request (ts_code, start, end; both days inside), once each."""
    r = requests.select(F.col("ts_code").alias("_c"), "start", "end")
    return bars.join(r, (F.col("_c") == F.col("ts_code")) & F.col("trade_date").between(F.col("start"), F.col("end")), "left_semi")


def marked(table: DataFrame, chosen: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """table with ``flag`` (pinned, deleted) true on the chosen keys and as it was, or else false, on the others."""
    hit = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    was = F.col(flag) if flag in table.columns else F.lit(False)
    return table.join(hit, keys, "left").withColumn(flag, F.coalesce("_hit", was, F.lit(False))).drop("_hit")


def append_results(results: DataFrame, path: str, order: str) -> None:
    """Append a batch of results (bounded: candidates that passed) to a log, with ids that go on from its greatest."""
    spark = results.sparkSession
    try:
        top = spark.read.parquet(path).agg(F.max("id").alias("id")).first()["id"] or 0
    except AnalysisException as e:  # no log yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        top = 0
    results.withColumn("id", F.row_number().over(Window.orderBy(order)).cast("long") + top).write.mode("append").parquet(path)


def results_after(log: DataFrame, after: int, most: int = 100) -> DataFrame:
    """The next results of a log after an id that was seen."""
    return log.where(F.col("id") > after).orderBy("id").limit(most)


def export_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of CSV files with headings per section."""
    for name, df in sections.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def adjust(bars: DataFrame, factors: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices in terms of the newest adjustment factor, rounded to cents; gaps take the factor before, or
    else the one after."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    df = bars.join(factors.select("ts_code", "trade_date", F.col("adj_factor").alias("_a")), ["ts_code", "trade_date"], "left")
    before = F.last("_a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_a", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_a", F.coalesce(before, after, F.lit(1.0)))
    df = df.withColumn("_newest", F.last("_a").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.select(*[F.round(F.col(c) * F.col("_a") / F.col("_newest"), 2).alias(c) if c in columns else F.col(c) for c in bars.columns])


def valid_bars(bars: DataFrame) -> DataFrame:
    """bars without rows whose four prices are all zero."""
    return bars.where(~((F.col("open") == 0) & (F.col("high") == 0) & (F.col("low") == 0) & (F.col("close") == 0)))


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions of ``keys`` that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
