"""The pipeline on empty tables, nulls in every column, and callers' columns that bear the stages' own names."""

import random
from collections import Counter

import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ["component_id", "kept", "keep_id", "score", "n_hit", "n_words", "bucket", "piece", "length", "start", "row", "key", "_gone", "_rows", "_route", "text_sha256", "group_size", "toxic", "word", "label"]


def write(spark, path, docs, schema=SCHEMA, labels=(), bench=()):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("docs", [[], [(None, None, None, None, None)] * 3 + [(1, "", None, "s", 0), (None, " \n", None, None, None), (2, None, None, None, None)]])
def test_nothing_to_learn_from(spark, tmp_path, docs):
    write(spark, tmp_path, docs, labels=[(None, None, None), (1, None, None)] if docs else (), bench=[(None, None), (1, "")] if docs else ())
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    kept = left.collect()
    assert len(kept) <= len(docs) and (bool(kept) == bool(docs))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)


def test_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    fresh = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    copy, leak = fresh(60), fresh(20)
    texts = [fresh(40), copy, copy.replace(" ", "  ", 3), fresh(50), "x " + leak, fresh(30)] + [fresh(12) + " scum " + fresh(12) if i % 4 == 0 else fresh(25) for i in range(200)]
    rows = [(i, t, "en", "s", len(t), *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    write(spark, tmp_path, rows, SCHEMA + "".join(f", `{n}` string" for n in NAMES), [(i, 1, int("scum" in t.split())) for i, t in enumerate(texts)], [(1, leak)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), *NAMES]
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {i for i, t in enumerate(texts) if "scum" not in t.split()} - {2, 4}
    assert all(r[n] == f"{n}{i}" for i, r in got.items() for n in NAMES)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(got.keys())
