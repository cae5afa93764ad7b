"""Correlations of short windows are made by doubling, as a frame would give them."""

import numpy as np
import pytest

from tidemark.functions import registry
from tidemark.plans.compile import evaluate


@pytest.mark.parametrize("n", [5, 7, 20])
def test_no_frames_of_moments(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    rows = [(f"c{k}", d, *(None if rng.random() < 0.03 else float(x) for x in (rng.normal(), 1e6 + (rng.integers(0, 3) if k < 3 else d // 9)))) for k in range(6) for d in range(90)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, a double, b double")
    ex = {"r": f"corr(a, b, {n})", "v": f"cov(a, b, {n})"}
    doubled = evaluate(df, ex)
    plan = doubled._jdf.queryExecution().executedPlan().toString()
    assert "covar" not in plan and "stddev" not in plan
    monkeypatch.setattr(registry, "SHORT", 60)
    framed = evaluate(df, ex)
    assert "covar_pop" in framed._jdf.queryExecution().executedPlan().toString()
    x, y = (f.toPandas().sort_values(["ts_code", "trade_date"]) for f in (doubled, framed))
    for c, near in (("r", 2e-9), ("v", 1e-9)):
        np.testing.assert_allclose(x[c].to_numpy(float), y[c].to_numpy(float), rtol=0, atol=near)
        assert x[c].notna().sum() > 20
