"""Tables of intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []
_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is
    unset (local tests), a temporary one that goes at exit."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/tidemark"


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the work folder, in a folder for each value of ``by``, and read it back: lineage ends here, so a
    lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this process; call it when results have been written."""
    jvm = spark._jvm
    for path in _STAGED:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STAGED.clear()
