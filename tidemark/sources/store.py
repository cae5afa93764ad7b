"""A panel that is built once: a table bucketed and sorted by security, and the dates it covers.

Whoever asks for dates gets them from the table; the ranges that it lacks are built from the source
first, and only those. Windows and joins along securities read buckets as they are, without a
shuffle. The table and its coverage live in one folder, so that another application finds both.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = dt.date(1000, 1, 1), dt.date(9999, 12, 31)
_DAY = dt.timedelta(1)


def without(asked: tuple[dt.date, dt.date], covered: list[tuple[dt.date, dt.date]]) -> list[tuple[dt.date, dt.date]]:
    """The parts of a range of days that no covered range holds, in order."""
    out, at = [], asked[0]
    for a, b in sorted(covered):
        if b < at or a > asked[1]:
            continue
        if a > at:
            out.append((at, a - _DAY))
        if b >= asked[1]:
            return out
        at = b + _DAY
    return [*out, (at, asked[1])]


class PanelStore:
    """Rows of ``source(first, last)`` by (ts_code, trade_date), kept at ``path``. A source that is ``dealt`` gets the number of buckets as well, and
    its rows lie in as many tasks by ts_code."""

    def __init__(self, spark: SparkSession, path: str, source: Callable[..., DataFrame], buckets: int | None = None, dealt: bool = False):
        self.spark, self.path, self.source, self.dealt = spark, path, source, dealt
        self.table = "tidemark_" + hashlib.sha256(path.encode()).hexdigest()[:20]
        try:
            rows = self.coverage().collect()  # a row per range that was filled
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.covered = [(r["first_day"], r["last_day"]) for r in rows]
        self.buckets = rows[0]["buckets"] if rows else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def coverage(self) -> DataFrame:
        """(first_day, last_day, buckets, rows, codes, first_bar, last_bar): what has been filled, and what was found there."""
        return self.spark.read.parquet(f"{self.path}/coverage")

    def fill(self, first: dt.date = FIRST, last: dt.date = LAST) -> None:
        """Builds the days from first to last that are not covered."""
        for a, b in without((first, last), self.covered):
            rows = self._rows(a, b).where(F.col("trade_date").between(F.lit(a), F.lit(b)))
            self._register(rows)
            # one file a bucket
            (rows if self.dealt else rows.repartition(self.buckets, "ts_code")).write.insertInto(self.table)
            own = self.spark.table(self.table).where(F.col("trade_date").between(F.lit(a), F.lit(b)))
            found = own.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("ts_code").alias("codes"), F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"))
            found.select(F.lit(a).alias("first_day"), F.lit(b).alias("last_day"), F.lit(self.buckets).alias("buckets"), "*").write.mode("append").parquet(f"{self.path}/coverage")
            self.covered.append((a, b))

    def _rows(self, first: dt.date, last: dt.date) -> DataFrame:
        return self.source(first, last, self.buckets) if self.dealt else self.source(first, last)

    def _register(self, like: DataFrame) -> None:
        if not self.spark.catalog.tableExists(self.table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
            self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (ts_code) SORTED BY (ts_code, trade_date) INTO {self.buckets} BUCKETS LOCATION '{self.path}/bars'")

    def read(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """The bars from first to last, or all; what is missing of them is built."""
        self.fill(first or FIRST, last or LAST)
        if not self.spark.catalog.tableExists(self.table):  # another application's
            self._register(self._rows(FIRST, FIRST))
        df = self.spark.table(self.table)
        if first:
            df = df.where(F.col("trade_date") >= F.lit(first))
        return df.where(F.col("trade_date") <= F.lit(last)) if last else df


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes with the names, sizes and times of the files at ``paths``."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs.Path, hashlib.sha256()
    for p in paths:
        at = hadoop(p)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status = files.listStatus(at)
        for s in sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in status):
            out.update(s.encode())
    return out.hexdigest()[:24]
