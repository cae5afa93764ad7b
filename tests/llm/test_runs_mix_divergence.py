"""Periodic runs, mixing and divergence against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence, mixing, periodic_runs


def brute_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s:
                found.setdefault((s, i - s + q), q)  # the smallest period comes first
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, 2 * q)), key=lambda x: (x[0], x[2]))


def some_words(rng, most=60):
    n, k = rng.randint(0, most), rng.choice([1, 2, 3, 5, 40])
    words = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [some_words(rng) for _ in range(rng.randint(1, 5))]
        for least in (2, 5, 12):
            assert periodic_runs.runs_of_batch([np.array(d, np.int64) for d in docs], least) == [brute_runs(d, least) for d in docs]


def test_suffix_array_and_repeats():
    rng = random.Random(9)
    for _ in range(200):
        t = some_words(rng, 40)
        if not t:
            continue
        sa, rank, lcp = periodic_runs.suffix_array(np.array(t))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == order and all(rank[i] == k for k, i in enumerate(order))
        for a, b, k in zip(order, order[1:], lcp[1:], strict=False):
            assert t[a : a + k] == t[b : b + k] and t[a + k : a + k + 1] != t[b + k : b + k + 1]
        repeats = {(i, q) for q in range(1, len(t)) for i in range(len(t) - 2 * q + 1) if t[i : i + q] == t[i + q : i + 2 * q] and t[i : i + 1] != t[i + 2 * q : i + 2 * q + 1]}
        assert {tuple(x) for x in periodic_runs.branching_repeats(np.array(t)).tolist()} == repeats


def test_long_runs_are_fast():
    assert periodic_runs.runs_of_batch([np.zeros(200_000, np.int64)], 12) == [[(0, 200_000, 1)]]
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2, 60_000)
    assert len(periodic_runs.runs_of_batch([words], 12)[0]) > 500


def test_runs_of_documents(spark):
    block = " ".join(f"w{i}" for i in range(7))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "a b c", "y"), (5, f"start {block}\n{block}  {block} w0 end", "y"), (5, f"start {block}\n{block}  {block} w0 end", "y"), (None, "Ä " * 12, "z"), (6, "z" * 300_000, "z"), (7, "q " * 11, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.find_runs(docs).collect())
    five = (5, 24, ((1, 22, 7),), f"start {block} end")
    assert got == Counter([(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 3, (), "a b c"), five, five, (None, 12, ((0, 12, 1),), "Ä"), (6, 1, (), "z" * 300_000), (7, 11, (), " ".join("q" * 11))])
    cut = periodic_runs.collapse_runs(docs)
    assert cut.columns == docs.columns
    assert Counter(tuple(r) for r in cut.collect()) == Counter([*rows[:4], (5, f"start {block} end", "y"), (5, f"start {block} end", "y"), (None, "Ä", "z"), rows[7], rows[8]])
    empty = docs.limit(0)
    assert periodic_runs.find_runs(empty).count() == periodic_runs.collapse_runs(empty).count() == periodic_runs.digests(periodic_runs.find_runs(periodic_runs.plant(empty))).count() == 0


def test_digests(spark):
    docs = spark.createDataFrame([(1, "a b " * 8 + "c " * 16), (2, "plain")], "doc_id bigint, text string")
    got = {r["doc_id"]: r.asDict() for r in periodic_runs.digests(periodic_runs.find_runs(docs)).collect()}
    assert got[1] == {"doc_id": 1, "n_runs": 2, "start": 0, "length": 16, "period": 2, "exponent_milli": 8000, "runs_sha256": hashlib.sha256(b"0,16,2\n16,16,1\n").hexdigest(), "collapsed_sha256": hashlib.sha256(b"a b c").hexdigest()}
    assert got[2]["n_runs"] == 0 and got[2]["start"] is got[2]["length"] is got[2]["period"] is got[2]["exponent_milli"] is None and got[2]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, passes=2):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    capped, total = set(), sum(sizes.values()) * budget
    while True:
        free = [k for k in names if k not in capped]
        rest = total - sum(passes * sizes[k] for k in capped)
        share = {k: rest * w[k] / sum(w[j] for j in free) for k in free}
        over = {k for k in free if share[k] > passes * sizes[k]}
        if not over:
            return {k: passes * sizes[k] if k in capped else share[k] for k in names}
        capped |= over


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    goal, taken = brute_targets(sizes), [0] * len(rows)
    for s in sizes:
        left = math.floor(goal[s])
        for turn in (0, 1):
            mine = [i for i, r in enumerate(rows) if r[2] == s]
            for i in sorted(mine, key=lambda i: (int(hashlib.md5(f"{turn}:{rows[i][0]}".encode()).hexdigest()[:15], 16), rows[i][0])):
                n = min(size[i], left)
                taken[i] += n
                left -= n
    return {r[0]: (n, sizes[r[2]], goal[r[2]], t) for r, n, t in zip(rows, size, taken, strict=True)}


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Ω", "é", "", None, "hot"]
    rows = [(i, rng.choice([None, "", "  ", "w " * rng.randint(1, 9), "w\x0bv\n" * rng.randint(10, 200)]), rng.choice(names) if rng.random() < 0.5 else "hot") for i in range(400)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, size int").repartition(5)
    documents, pieces = mixing.mix(docs)
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in documents.collect()}
    want = brute_mix(rows)
    assert got.keys() == want.keys()
    for k, (size, source, goal, taken) in want.items():
        assert got[k][:2] == (size, source) and got[k][3] == taken <= 2 * size and got[k][2] == pytest.approx(goal)
    # the mix has no gaps, and its order is that of virtual time
    at = 0
    ordered = sorted(pieces.collect(), key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at
        at += r["length"]
    assert [r["finish"] for r in ordered] == sorted(r["finish"] for r in ordered) and at == sum(x[3] for x in want.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2, "text"))[0].collect()}
    assert again == {k: x[3] for k, x in want.items()}


def test_mix_edges(spark):
    schema = "doc_id bigint, text string, source string"
    empty = spark.createDataFrame([], schema)
    documents, pieces = mixing.mix(empty)
    assert documents.count() == pieces.count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], schema)
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(blank)[0].collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    same = spark.createDataFrame([(7, "a b", "s")] * 3 + [(None, "c d e f", "s")] * 2, schema)
    got = mixing.mix(same)[0].collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == 21 and all(r["target"] == 21.0 and r["taken"] <= 2 * r["size"] for r in got)
    docs = spark.createDataFrame([(i, f" a{i}  b{i}\nc{i} d{i} ", "st"[i % 2]) for i in range(9)], schema)
    texts = mixing.mixed_texts(docs).orderBy("start").collect()
    used = Counter(w for r in texts for w in r["text"].split())
    documents = mixing.mix(docs)[0].collect()
    assert sum(used.values()) == sum(r["taken"] for r in documents)
    for r in documents:
        assert sum(n for w, n in used.items() if w[1:] == str(r["doc_id"])) == r["taken"]
    with pytest.raises(ValueError):
        mixing.mixed_texts(same)


def brute_audit(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall((text or "").translate(low))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in docs.items()}
    share = lambda c, lang: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept[lang]) + 5 * len(kept[lang])) for t in kept[lang]}
    whole = {lang: share(sum((c for (k, _), c in counts.items() if k == lang), Counter()), lang) for lang in kept}
    p = {k: share(c, k[0]) for k, c in counts.items()}
    out = []
    for lang, source in counts:
        other = [("pair", b, sum(abs(p[lang, source][t] - p[lang, b][t]) for t in kept[lang])) for k, b in counts if k == lang and b != source]
        own = [("term", t, p[lang, source][t] - whole[lang][t]) for t in kept[lang] if counts[lang, source][t] and p[lang, source][t] > whole[lang][t]]
        for part, most in ((other, None), (own, top)):
            ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most]
            out += [(lang, source, kind, item, value, i + 1) for i, (kind, item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("tile", [512, 2])
def test_audit_against_brute_force(spark, tile):
    rng = random.Random(tile)
    words = ["the", "The", "été", "Ünï", "zz9top", "x", "日本", *[f"w{'abcdefghij'[i]}" for i in range(10)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))) if rng.random() < 0.9 else rng.choice([None, "12 34", ""]), rng.choice(["en", "de", None, "lone"]), rng.choice(["s1", "s2", "s3", "", None, "Ω"])) for _ in range(200)]
    rows = [(t, lang, "only" if lang == "lone" else s) for t, lang, s in rows] + [("rare", "few", "a"), (None, "few", "b")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(docs, min_docs=8, top=3, tile=tile).collect()) == brute_audit(rows, 8, 3)


def test_audit_edges(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    assert divergence.audit(spark.createDataFrame([(None, None, None)] * 2, schema)).count() == 0
    long = spark.createDataFrame([("ab " * 100_000 + "é" * 100_000, "en", "s"), ("cd", "en", "t")], schema)
    assert sorted(tuple(r) for r in divergence.audit(long, min_docs=1).collect()) == brute_audit([("ab " * 100_000 + "é" * 100_000, "en", "s"), ("cd", "en", "t")], 1, 50)
