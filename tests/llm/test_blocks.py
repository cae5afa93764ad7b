"""A benchmark in several blocks gives what one block gives."""

from collections import Counter

from tidemark.llm import decontaminate

COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def test_blocks_with_null_and_repeated_ids(spark):
    a, b = ("w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "v1 v2 v3 v4")
    rows = [(None, a), (None, "u1 u2 u3 u4 u5 u6 u7 u8 u9 u10 u11"), (None, b), (None, "x1 x2 x3 x4"), (7, b), (7, "x1 x2 x3 x4"), (7, b), (1, a + " " + b), (None, a), (2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(1, a), (2, b), (3, "y1 y2"), (None, b)], "item_id bigint, text string")
    got = [Counter(str(tuple(r[c] for c in COLS)) for r in decontaminate.find_leaks(docs, bench, most=most).collect()) for most in (3, 10**6)]
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)


def test_items_by_number(spark):
    bench = spark.createDataFrame([(None, "a b"), ("", "a b"), ("long", " ".join(f"k{i}" for i in range(40))), ("long", "c d e"), ("x", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x a b y"), (2, " ".join(f"k{i}" for i in range(12, 25)) + " c d e"), (3, "k1 k2")], "doc_id bigint, text string")
    seen = []
    for most in (1, 2, 3, 10**6):
        found = decontaminate.find_leaks(docs, bench, most=most)
        seen.append(sorted(str(tuple(r[c] for c in COLS)) for r in found.collect()))
        assert [r["n_items"] for r in found.orderBy("doc_id").collect()] == [2, 1, 0]
        assert [r["n_hit"] for r in found.orderBy("doc_id").collect()] == [2, 16, 0]
    assert all(s == seen[0] for s in seen)


def test_blocks_are_bounded(spark):
    text = " ".join(f"k{i}" for i in range(1000))
    bench = spark.createDataFrame([(1, text), (2, "short one"), (3, None), (4, text)], "item_id bigint, text string")
    tables = list(decontaminate.blocks(bench, 10, 100))
    assert all(sum(len(t) for _, t in b.by_size.values()) <= 100 for b in tables)
    assert len({w for b in tables for _, t in b.by_size.values() for w in ((tuple(sorted(b.vocab, key=b.vocab.get)[i - 1] for i in x)) for x in t)}) == 992
