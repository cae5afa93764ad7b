"""Streaming: bars from ticks with watermarks, and news inserted once per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, key: str, time: str, price: str, every: str = "1 hour", late: str = "2 hours", order: str | None = None) -> DataFrame:
    """open, high, low, close and ticks of each key and window; works on streams (late
    rows are dropped after the watermark) and on tables."""
    ticks = ticks.withColumn(time, F.col(time).cast("timestamp"))
    df = ticks.withWatermark(time, late) if ticks.isStreaming else ticks
    by: Column = F.struct(F.col(time), F.col(order)) if order else F.col(time)
    bars = df.groupBy(F.window(time, every), key).agg(F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return bars.select(F.col("window.start").alias("start"), key, "open", "high", "low", "close", "ticks")


def new_titles(news: DataFrame, title: str = "title", time: str = "publish_time", keep: str = "7 days") -> DataFrame:
    """News whose title was not seen within ``keep``: state is bounded by the watermark."""
    if news.isStreaming:
        return news.withWatermark(time, keep).dropDuplicatesWithinWatermark([title])
    return news.dropDuplicates([title])
