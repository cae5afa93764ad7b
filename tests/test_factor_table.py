"""What candidates are measured by is evaluated once for all their measures."""

from tidemark.operators import mining, simulate
from tidemark.sources.panel import market_panel


def test_candidates_evaluate_once(spark, monkeypatch):
    seen, evaluate = [], mining.evaluate
    monkeypatch.setattr(mining, "evaluate", lambda panel, expressions, **more: seen.append(set(expressions)) or evaluate(panel, expressions, **more))
    panel = market_panel(spark, "/root/testdata/sf0.001")
    batch = {"momentum": "pctchange(close, 4)", "activity": "volume / mean(volume, 8)"}
    got = mining.candidates(panel, simulate._cents(panel), batch)
    assert seen == [{"momentum", "activity", "_fwd"}] and got.count() == 2 * 3
