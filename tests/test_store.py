"""The staged panel: what is covered is not built again, and securities are not shuffled."""

import datetime as dt
import random

import pytest

from tidemark.operators import alphas, relational
from tidemark.plans.compile import evaluate
from tidemark.sources import panel, store

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.mark.parametrize("seed", range(4))
def test_ranges(seed):
    rng = random.Random(seed)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(k)
    for _ in range(200):
        covered = [(day(a), day(a + rng.randint(0, 5))) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 5)))]
        a = rng.randint(0, 30)
        asked = (day(a), day(a + rng.randint(0, 10)))
        want = {k for k in range(60) if asked[0] <= day(k) <= asked[1] and not any(x <= day(k) <= y for x, y in covered)}
        got = [k for x, y in store.without(asked, covered) for k in range(60) if x <= day(k) <= y]
        assert len(got) == len(set(got)) and set(got) == want and all(x <= y for x, y in store.without(asked, covered))


def test_only_missing_days_are_built(spark, tmp_path):
    built = []

    def source(a, b):
        built.append((a, b))
        return panel.weekly_bars(spark, SF, a, b)

    s = store.PanelStore(spark, f"{tmp_path}/p", source, buckets=3)
    whole = panel.weekly_bars(spark, SF)
    rows = lambda df: sorted(map(str, df.collect()))
    a, b, c = D(1994, 3, 1), D(1995, 6, 30), D(1996, 2, 2)
    assert rows(s.read(a, b)) == rows(whole.where(f"trade_date BETWEEN '{a}' AND '{b}'")) and built == [(a, b)]
    assert s.read(a, b).count() and len(built) == 1
    assert rows(s.read(D(1995, 1, 1), c)) == rows(whole.where(f"trade_date BETWEEN '1995-01-01' AND '{c}'")) and built[1:] == [(D(1995, 7, 1), c)]
    # another application finds the table and its coverage
    spark.sql(f"DROP TABLE {s.table}")
    again = store.PanelStore(spark, f"{tmp_path}/p", source)
    assert again.buckets == 3 and rows(again.read(a, c)) == rows(whole.where(f"trade_date BETWEEN '{a}' AND '{c}'"))
    assert rows(again.read()) == rows(whole)
    found = again.coverage().agg({"rows": "sum"}).first()[0]
    assert found == whole.count()
    spark.sql(f"DROP TABLE {s.table}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_by_security(spark):
    bars = panel.market_panel(spark, SF)
    text = plan_of(evaluate(bars, {"a": "mean(close, 5) + rank(volume)"}))
    assert "Exchange" not in text and "Bucketed: true" in text
    ranked = plan_of(relational.run(spark, SF, relational.QUERIES["rank_ic"]))
    assert "hashpartitioning(ts_code" not in ranked and "lineitem" not in ranked
    text = plan_of(alphas.alphas(bars, [1, 2, 3]))
    scan = text.index("FileScan")
    before = text[:scan].rindex("Window")
    assert "Exchange" not in text[before:scan]
    dated = panel.market_panel(spark, SF, D(1995, 1, 1), D(1995, 12, 31))
    dated = spark._jvm.PythonSQLUtils.explainString(dated._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(trade_date,1995-01-01)" in dated and "LessThanOrEqual(trade_date,1995-12-31)" in dated


def test_changed_files_have_another_panel(spark, tmp_path):
    for t in ("lineitem", "supplier"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    n = panel.market_panel(spark, str(tmp_path)).count()
    assert n == panel.weekly_bars(spark, str(tmp_path)).count()
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey > 3").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert panel.market_panel(spark, str(tmp_path)).count() == panel.weekly_bars(spark, str(tmp_path)).count() < n
