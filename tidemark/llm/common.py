"""What the training-data operators share: the shared work folder, Arrow-batch
mapping, and joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, A-Z and a-z.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows per Arrow batch; documents may be long, so batches hold few of them.
BATCH_ROWS = 1000
#: Bytes per Arrow batch (and the row that exceeds them): each batch is held several times, by the JVM and by Python.
BATCH_BYTES = 8 << 20

_STAGED: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is
    unset (local tests), a temporary one that goes at exit."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/tidemark"


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the work folder and read it back: lineage ends here, so a
    lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this process; call it when results have been written."""
    jvm = spark._jvm
    for path in _STAGED:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STAGED.clear()


def tune(spark: SparkSession) -> None:
    """Small Arrow batches unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def id_field(df: DataFrame, name: str = "doc_id") -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def struct(*fields: T.StructField | tuple[str, str]) -> T.StructType:
    """Fields as they are, or (name, type) pairs."""
    out = []
    for f in fields:
        if isinstance(f, T.StructField):
            out.append(f)
        else:
            out.append(T.StructField(f[0], T._parse_datatype_string(f[1]), True))
    return T.StructType(out)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, bytes of text); null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


#: Column of a row's own key, where ids do not tell rows apart.
ROW = "_tidemark_row"


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(rows, key): docs and a column of theirs that no two rows share and none lacks. It is the id if it
    is so; else the rows are staged with a number in order of id, null ids last."""
    bad = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > 1) | F.col(id_col).isNull())
    if bad.isEmpty():
        return docs, id_col
    # the last key parts equal rows; numbers are fixed once they are written
    order = docs.withColumn(ROW, F.monotonically_increasing_id()).orderBy(F.col(id_col).asc_nulls_last(), text_col, ROW)
    return staged(order.withColumn(ROW, F.monotonically_increasing_id()), "rows"), ROW


def without(rows: DataFrame, key: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose key is not in the only column of ``gone``; neither has null or repeated keys."""
    gone = gone.toDF("_gone")
    return rows.join(gone.hint("shuffle_hash"), rows[key] == gone["_gone"], "left_anti").select(*columns)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Hot keys at most, or as many as the session has shuffle partitions.
HOT_KEYS = 1000


def hot_limit(total: int, least: int = 500) -> int:
    """A key with more rows than this is hot: more than a task's fair share of ``total``, or a thousandth of it. No more
    than ``HOT_KEYS`` keys, or than there are partitions, can be: what is broadcast for them is bounded."""
    spark = SparkSession.getActiveSession()
    return max(least, total // max(HOT_KEYS, partitions(spark) if spark else 0))


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], rows: str, total: int, salt: list[str]) -> DataFrame:
    """left LEFT JOIN right on keys, where right is unique on keys and its
    column ``rows`` has how many left rows carry the key.

    Hot keys (``hot_limit``) are broadcast, of which there are few as long as ``total`` is the number of left rows; the rest is a
    shuffled join in which a hot row travels under a hash of its ``salt``
    columns, so no task gets a hot key's rows.
    """
    limit = hot_limit(total)
    hot = right.where(F.col(rows) > limit).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values], F.lit(True).alias("_hot"))
    cold = right.where(F.col(rows) <= limit).select(F.xxhash64(*keys).alias("_route"), *[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_cv_{v}") for v in values])
    out = left.join(F.broadcast(hot), [left[k].eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left")
    out = out.withColumn("_route", F.when(F.col("_hot"), F.xxhash64(*salt)).otherwise(F.xxhash64(*keys)))
    same = [out["_route"] == cold["_route"], F.col("_hot").isNull()] + [out[k].eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    out = out.join(cold, same, "left")
    return out.select(*[out[c] for c in left.columns], *[F.coalesce(F.col(f"_hv_{v}"), F.col(f"_cv_{v}")).alias(v) for v in values])


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``rank``, each row's number from 0 in ``order``, without a window over all rows: sorted rows are
    written, and what each sorted partition holds is counted."""
    held = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    counts = held.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row per sorted partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    met = held.join(F.broadcast(before), F.shiftright("_at", 33) == before["_part"])
    return met.select(*df.columns, (F.col("_before") + F.expr("_at & 8589934591")).alias("rank"))
