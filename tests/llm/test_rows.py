"""Filter stages decide by row: null and repeated ids in each stage and the whole pipeline."""

import random
from collections import Counter

import corpus_pipeline
from tidemark.llm import decontaminate, exact_dedup, ngram_join

PLAIN = ["the", "of", "and", "thing", "est", "ndre", "Über", "ñandú", "erly", "onha", "shion", "tible"]


def texts(rng):
    return lambda k: " ".join(rng.choice(PLAIN) + str(rng.randrange(9999)) for _ in range(k))


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_exact_dedup_by_row(spark):
    rows = [(1, "a b"), (None, "a  b"), (None, "alone"), (None, "twice"), (None, "twice"), (7, "same"), (7, "same"), (7, "other"), (2, "a b"), (8, None), (None, "")]
    assert kept(exact_dedup.dedup(frame(spark, rows))) == Counter([(1, "a b"), (None, "alone"), (None, "twice"), (7, "same"), (7, "other"), (8, None)])


def test_ngram_dedup_by_row(spark):
    fresh = texts(random.Random(2))
    a, b, c, d = (fresh(200) for _ in range(4))
    near = lambda t: " ".join("other" if i == 100 else w for i, w in enumerate(t.split()))
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (7, near(c)), (7, d), (None, "short"), (None, None), (None, "")]
    got = kept(ngram_join.dedup_similar(frame(spark, rows)))
    assert sum(got[(None, t)] for t in (b, near(b))) == 1 and sum(got[(7, t)] for t in (c, near(c))) == 1
    assert got[(1, a)] == got[(7, d)] == got[(None, "short")] == got[(None, None)] == got[(None, "")] == 1 and sum(got.values()) == 7


def test_leaks_by_row(spark):
    fresh = texts(random.Random(3))
    leak = fresh(15)
    rows = [(None, leak), (None, "clean"), (5, "x " + leak), (5, "clean too"), (6, None)]
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    assert kept(decontaminate.remove_leaks(frame(spark, rows), bench)) == Counter([(None, "clean"), (5, "clean too"), (6, None)])


def test_pipeline_by_row(spark, tmp_path):
    rng = random.Random(21)
    fresh = texts(rng)
    rows, labels = [], []
    for i in range(300):
        t = fresh(30)
        rows.append((i, t.replace(t.split()[3], "scum") if i % 5 == 0 else t))
        labels.append((i, 1, int(i % 5 == 0)))
    leak, copy = fresh(25), fresh(200)
    edited = " ".join("other" if i == 100 else w for i, w in enumerate(copy.split()))
    good = [(None, fresh(40)), (None, fresh(41)), (500, fresh(42)), (500, fresh(43)), (400, copy), (501, fresh(44)), (None, fresh(45))]
    bad = [(None, "what a scum " + fresh(10)), (500, "scum of the thing " + fresh(10)), (None, copy), (None, edited), (None, fresh(5) + " " + leak), (500, leak), good[5], good[6]]
    rows += good + bad
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = Counter([(i, t) for i, t in rows[:300] if i % 5] + good)
    assert kept(docs) == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(i for i, _ in want.elements())
