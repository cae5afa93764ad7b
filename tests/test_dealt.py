"""The panel's build: order lines are dealt once, and bars are written where they are made."""

import glob
import re

from tidemark.sources import panel, store

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_once(spark, tmp_path):
    bars = panel.weekly_bars(spark, SF, parts=7)
    plan = bars.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and re.search(r"Exchange hashpartitioning\(ts_code#\d+, 7\)", plan)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(panel.weekly_bars(spark, SF))
    assert rows(bars) == want
    # dealt by a join of both sides as well, and one file a bucket
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = store.PanelStore(spark, f"{tmp_path}/p", lambda a, b, n: panel.weekly_bars(spark, SF, a, b, n), buckets=3, dealt=True)
        assert rows(s.read()) == want and len(glob.glob(f"{tmp_path}/p/bars/*.parquet")) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql(f"DROP TABLE IF EXISTS {s.table}")
