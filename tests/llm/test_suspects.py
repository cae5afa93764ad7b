"""Exact dedup: the filter that tells which texts are read again."""

import hashlib
import random

from tidemark.llm import exact_dedup


def shas(spark, texts):
    return spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(),) for t in texts], "sha string")


def test_filter_holds_all_and_little_else(spark):
    bits = exact_dedup.suspect_filter(shas(spark, [f"in {i}" for i in range(20_000)]))
    assert len(bits) * 8 == 1 << 19
    assert all(exact_dedup.may_hold(bits, hashlib.sha256(f"in {i}".encode()).digest()) for i in range(20_000))
    assert sum(exact_dedup.may_hold(bits, hashlib.sha256(f"out {i}".encode()).digest()) for i in range(20_000)) < 400


def test_filter_of_nothing(spark):
    bits = exact_dedup.suspect_filter(shas(spark, []))
    assert len(bits) == 1 << 12 and not bits.any()


def test_full_filter_changes_no_result(spark, monkeypatch):
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choice("ab") for _ in range(pick.randint(0, 7)))) for i in range(400)] + [(None, "a b"), (7, None), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted(exact_dedup.exact_groups(docs).collect(), key=str)
    made = exact_dedup.suspect_filter
    monkeypatch.setattr(exact_dedup, "suspect_filter", lambda s: made(s, most=15) | 255)
    assert sorted(exact_dedup.exact_groups(docs).collect(), key=str) == want
    first = {}
    for d, t in sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(" ".join(t.split()), d)
    assert {r["text_sha256"]: r["keep_id"] for r in want} == {hashlib.sha256(t.encode()).hexdigest(): d for t, d in first.items()}
