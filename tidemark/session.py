"""Session settings the engine expects, and where its own tables go."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results or plans depend on. Sizes of partitions are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "tidemark", master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
