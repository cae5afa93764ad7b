"""Windows by doubling against the windows themselves."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import registry
from tidemark.plans.compile import evaluate


@pytest.mark.parametrize("n", [2, 7, 20, 61, 64])
def test_doubling_against_windows(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    rows = []
    for k in range(4):
        x, y = rng.normal(1000, 1, 200), rng.normal(0, 1, 200)
        x[rng.random(200) < 0.01], y[rng.random(200) < 0.01] = np.nan, np.nan
        if k == 3:
            x[:100], y[50:] = 7.1, 0.1  # constant stretches
        rows += [(f"s{k}", i, *(None if np.isnan(v) else float(v) for v in (x[i], y[i]))) for i in range(200)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, close double, volume double")
    ex = {"a": f"sum(close, {n})", "b": f"mean(close, {n})", "c": f"std(close, {n})", "d": f"ts_max(close, {n})", "e": f"ts_min(volume, {n})", "f": f"corr(close, volume, {n})", "g": f"cov(close, volume, {n})"}
    plain = evaluate(df, ex).toPandas().sort_values(["ts_code", "trade_date"]) if n <= registry.LONG else None
    monkeypatch.setattr(registry, "LONG", 1)
    got = evaluate(df, ex).toPandas().sort_values(["ts_code", "trade_date"])
    pdf = pd.DataFrame(rows, columns=["ts_code", "trade_date", "close", "volume"]).astype({"close": float, "volume": float})
    g = pdf.groupby("ts_code")
    roll = lambda c, f: getattr(g[c].rolling(n), f)().to_numpy()
    for name, want in (("a", roll("close", "sum")), ("b", roll("close", "mean")), ("d", roll("close", "max")), ("e", roll("volume", "min"))):
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9)
    np.testing.assert_allclose(got["c"].astype(float), roll("close", "std"), rtol=1e-6, atol=1e-5)
    for code in ("s0", "s1", "s2"):
        own, part = got[got.ts_code == code], pdf[pdf.ts_code == code]
        x, y = part.close.to_numpy(), part.volume.to_numpy()
        spans = [(x[i - n + 1 : i + 1], y[i - n + 1 : i + 1]) for i in range(n - 1, 200)]
        whole = [not np.isnan(u + v).any() for u, v in spans]
        assert own["f"].notna().tolist() == [False] * (n - 1) + whole == own["g"].notna().tolist()
        kept = [s for s, w in zip(spans, whole, strict=True) if w]
        np.testing.assert_allclose(own["f"].dropna().astype(float), [np.corrcoef(u, v)[0, 1] for u, v in kept], atol=1e-8)
        np.testing.assert_allclose(own["g"].dropna().astype(float), [np.cov(u, v)[0, 1] for u, v in kept], rtol=1e-6, atol=1e-9)
    # a constant block has no spread at all, hence no correlation and no covariance
    flat = got[(got.ts_code == "s3") & (got.trade_date.between(n, 99))]
    assert (flat["c"].dropna() == 0).all() and flat["f"].isna().all() and (flat["g"].dropna() == 0).all()
    if plain is not None:
        for c in ex:
            np.testing.assert_allclose(got[c].astype(float), plain[c].astype(float), rtol=1e-6, atol=1e-9)
