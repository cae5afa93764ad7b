"""Candidate identity, folds, batch metrics, gates, clusters, table maintenance."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import mining
from tidemark.sources import tables
from tidemark.sources.panel import market_panel

SF = "/root/testdata/sf0.001"


def test_identity():
    assert mining.expression_key("mean(close, 5)") == mining.expression_key(" mean( close,5 )")
    assert mining.equivalence_key("-(mean(close, 5))", "top") == mining.equivalence_key("mean(close, 5)", "bottom")
    assert mining.equivalence_key("neg(-close)") == mining.equivalence_key("close")
    assert mining.equivalence_key("close", "top") != mining.equivalence_key("close", "bottom")
    assert mining.complexity("mean(close, 5) - open * 2") == 3
    assert mining.novelty_key("skew(close, 10)") == mining.novelty_key("skew(close, 12)") != mining.novelty_key("skew(close, 40)")


def test_folds():
    for n in (30, 100, 350):
        for f in mining.walk_forward(n):
            (a, b), (c, d), (e, g) = f["train"], f["valid"], f["test"]
            assert 0 == a < b <= c < d <= e < g <= n


def test_batch_and_judgement(spark):
    rows = mining.mining_scores(spark, SF).collect()
    assert {r["factor"] for r in rows} == set(mining.BATCH)
    for r in rows:
        assert ("validation_directional_ic_too_weak" in r["reasons"].split(",")) == (r["valid_ic"] < 0.005)
        assert abs(r["capacity_score"] - max(0.0, 100 - min(r["turnover"], 500) / 5)) < 1e-9
        assert abs(r["bonferroni_p"] - min(1.0, r["test_p"] * len(mining.BATCH))) < 1e-12


def test_evolve_is_repeatable(spark):
    p = market_panel(spark, SF).cache()
    a = mining.evolve(p, 5, 2, 3)
    assert a == mining.evolve(p, 5, 2, 3) and a[0][1] >= a[-1][1] > 0


def test_clusters(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(30)]
    rows = [(n, d, v(i)) for n, v in (("a", lambda i: i * 1.0), ("b", lambda i: i * 2.0 + 1), ("c", lambda i: (-1.0) ** i)) for i, d in enumerate(days)]
    got = mining.clusters(spark.createDataFrame(rows, "factor string, trade_date date, value double"), [("a", 1.0), ("b", 2.0), ("c", 0.5)])
    assert got == {"b": "b", "a": "b", "c": "c"}


def test_tables(spark, tmp_path):
    d = [dt.date(2024, 1, i) for i in range(1, 7)]
    old = spark.createDataFrame([("A", d[0], 10.0), ("A", d[2], 20.0)], "ts_code string, trade_date date, close double")
    new = spark.createDataFrame([("A", d[2], 30.0), ("B", d[5], 1.0)], old.schema)
    up = tables.upsert(old, new, ["ts_code", "trade_date"])
    assert sorted(map(tuple, up.collect())) == [("A", d[0], 10.0), ("A", d[2], 30.0), ("B", d[5], 1.0)]
    cal = spark.createDataFrame([(x,) for x in d], "trade_date date")
    gaps = tables.missing_segments(old, cal, old).orderBy("first_day")
    assert [(r["first_day"], r["last_day"], r["days"]) for r in gaps.collect()] == [(d[1], d[1], 1), (d[3], d[5], 3)]
    adj = spark.createDataFrame([("A", d[0], 1.0), ("A", d[2], 2.0)], "ts_code string, trade_date date, adj_factor double")
    assert [r["close"] for r in tables.adjust(old, adj, ("close",)).orderBy("trade_date").collect()] == [5.0, 20.0]
    tables.replace_partitions(old.withColumn("b", F.lit(1)), f"{tmp_path}/t", ["b"])
    tables.replace_partitions(new.withColumn("b", F.lit(2)), f"{tmp_path}/t", ["b"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
