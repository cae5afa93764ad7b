"""Each operator against a brute-force version on small rows with nulls, empty and
long texts, ties, repeats, clashing column names, and on empty tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, exact_dedup, exchange, html_text, lattice_lm, line_dedup, ngram_join, packing, pii, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, n int, sender string, rows double"
RNG = random.Random(11)
VOCAB = ["the", "of", "and", "thing", "est", "ndre", "Über", "ñandú", "erly", "onha", "shion", "tible", "idiot", "scum"]


def sentence(k, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(k))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = sentence(120, rng)
    near = base.split()
    near[60] = "changed"
    line = "A line that very many documents share."
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   "), (7, "one two"), (8, "One\ttwo"),
        (9, line + "\n" + sentence(9, rng)), (10, sentence(5, rng) + "\n " + line.upper() + " \n" + line), (11, line), (12, line + "\n" + base),
        (13, sentence(4000, rng)), (14, base + "  " + base), (None, base), (None, None), (7, "one two"),
        (20, "Write to anna.b@mail.example.com or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.255 and 1.2.3.999"),
    ]
    return [(d, t, 1, "x", 2.0) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 3000):
        for top in (10_000, 2**40, 2**63):
            v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            assert (exchange.rice_decode(exchange.rice_encode(v), len(v)) == v).all()


def test_exact_groups(docs, rows, empty):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    want = Counter()
    for d, t, *_ in rows:
        g = groups[norm(t)]
        known = [x for x in g if x is not None]
        keep = min(known) if known else None
        want[(d, keep, len(g), d == keep, sha(norm(t)))] += 1
    assert bag(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    white = " \t\n\x0b\x0c\r"
    held = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = lowered(line.strip(white))
            if len(k) >= 20:
                held.setdefault(k, set()).add(d)
    want = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            h = held.get(lowered(line.strip(white)), ())
            last = max((x for x in h if x is not None), default=None)
            if len(h) < 3 or d == last:
                kept.append(line)
        want[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert bag(line_dedup.dedup_lines(docs.select("doc_id", "text")), "doc_id", "n_lines", "n_dropped", "text") == want
    assert line_dedup.dedup_lines(empty).count() == 0
    plan = line_dedup.dedup_lines(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ngram_components(docs, rows, empty):
    def grams(t, k):
        w = lowered(t).split()
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    for k, num in ((3, 90), (5, 80)):
        sets = {}
        for d, t, *_ in rows:
            if d is not None:
                sets[d] = grams(t, k)
        comp = {d: d for d in sets}
        change = True
        while change:
            change = False
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                        comp[a] = comp[b] = min(comp[a], comp[b])
                        change = True
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, k, num, 100).collect() if r["doc_id"] is not None}
        assert got == {d: (len(sets[d]), comp[d]) for d in sets}
    assert ngram_join.similar_components(empty).count() == 0


def test_ngram_components_of_random_edits(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(148)} for i, t in texts}
    comp = dict.fromkeys(sets, None)
    for i in sets:
        if comp[i] is None:
            stack, comp[i] = [i], i
            while stack:
                a = stack.pop()
                for b in sets:
                    if comp[b] is None and len(sets[a] & sets[b]) * 100 >= 90 * len(sets[a] | sets[b]):
                        comp[b] = i
                        stack.append(b)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(spark.createDataFrame(texts, "doc_id bigint, text string"), 3, 90, 100).collect()}
    assert got == comp


def test_decontamination(spark, docs, rows, empty):
    items = [(1, " ".join((rows[0][1]).split()[30:50])), (2, "one TWO"), (3, None), (4, ""), (None, "nothing like it here"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for d, t, *_ in rows:
        w = pat.findall(lowered(t))
        hit, found = set(), set()
        for item, x in items:
            v = pat.findall(lowered(x))
            k = min(10, len(v))
            for i in range(len(v) - k + 1 if v else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add("" if item is None else str(item))
        want[(d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))] += 1
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(decontaminate.find_leaks(docs, bench), *cols) == want
    assert decontaminate.find_leaks(empty, bench).count() == 0
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert bag(decontaminate.find_leaks(distinct, bench, most=3), *cols) == bag(decontaminate.find_leaks(distinct, bench), *cols)
    assert bag(decontaminate.find_leaks(distinct, bench.limit(0)), "contaminated") == {(False,): distinct.count()}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_leaks(distinct, bench).collect()}
    assert cut[7] == "" and cut[1] != rows[0][1]


def test_packing(spark, docs, rows, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    odd = ["", " ", "  a", "a  b", "a\n b", "x  y", "don't  <|endoftext|> 12 ab\n\nc", "é ü\tñ"]
    enc = packing.Encoder()
    for t in odd + [r[1] for r in rows if r[1]]:
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    got = packing.pack(docs, capacity=256).collect()
    pieces = Counter()
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at, k, p = 0, len(ids) % 256 or 256, 0
        while at < len(ids):
            pieces[(d, p, at, k, zlib.crc32(np.array(ids[at : at + k], "<u4").tobytes()))] += 1
            at, k, p = at + k, 256, p + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 256
    assert packing.pack(empty).count() == 0


def test_packing_plan_is_near_the_bound():
    rng = random.Random(2)
    for _ in range(30):
        sizes = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 400)))
        bins = packing.plan(dict(sizes), 100)
        used = Counter()
        for b, k in bins:
            assert sum(b) <= 100
            for s in b:
                used[s] += k
        assert used == sizes
        bound = -(-sum(s * n for s, n in sizes.items()) // 100)
        assert sum(k for _, k in bins) <= 11 / 9 * max(bound, sum(n for s, n in sizes.items() if s > 50)) + 1


def brute_windows(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        c = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                c[i : i + length] = True
        out.append(c)
    return out


def test_suffix_dedup(docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    for length in (200, 40):
        want = Counter()
        for (d, *_), t, c in zip(rows, texts, brute_windows(texts, length), strict=True):
            spans = int((np.diff(c.astype(int), prepend=0) == 1).sum())
            want[(d, len(t), int(c.sum()), spans, sha(np.frombuffer(t, np.uint8)[~c].tobytes()))] += 1
        for batch in (6000, 1):  # 1: every anchor goes through the exchange
            got = suffix_dedup.repeated_bytes(docs, length, batch)
            assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_fragments_in_bounded_memory():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 120, 500_000, dtype=np.uint8).tobytes() for _ in range(6)]
    suffix_dedup.fragments(texts[:1], 200)  # powers are kept
    tracemalloc.start()
    try:
        suffix_dedup.fragments(texts, 200)
        assert tracemalloc.get_traced_memory()[1] < 60e6  # with chunks of 1 MB: over 110e6
    finally:
        tracemalloc.stop()


def test_fragments_across_chunks(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abcd", k=k)) for k in (0, 39, 40, 900, 41, 0, 5000, 300)]
    anchors = []
    for chunk in (1 << 18, 64, 1):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        doc, first, last, at, m, _ = suffix_dedup.fragments(texts, 40)
        anchors.append(sorted((d, w, a + r, h) for d, a, b, r, h in zip(doc, first, last, at, m, strict=True) for w in range(a, b + 1)))
    assert [(d, w) for d, w, *_ in anchors[0]] == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 39)]
    assert anchors[0] == anchors[1] == anchors[2]


def test_batches_of_long_texts(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        docs = spark.range(0, 150, 1, 1).select(F.expr("repeat('0123456789', 20000)").alias("text"))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

        got = common.map_batches(docs, sizes, common.struct(("n", "bigint"), ("size", "bigint"))).collect()
        assert sum(r["n"] for r in got) == 150
        assert max(r["size"] for r in got) < 9e6  # was 30 MB in one batch
    finally:
        spark.conf.set(key, held)


def test_aligned_windows():
    rng = random.Random(5)
    for _ in range(100):
        length, n = rng.randint(2, 6), rng.randint(2, 30)
        at = [rng.randint(0, 4) for _ in range(n)]
        texts = [bytes(rng.choices(b"ab", k=a + length + rng.randint(0, 6))) for a in at]
        group = [rng.randint(0, 2) for _ in range(n)]
        seen = Counter((g, w - a, t[w : w + length]) for g, a, t in zip(group, at, texts, strict=True) for w in range(len(t) - length + 1))
        got = suffix_dedup.repeated_windows(texts, np.array(at), np.array(group), length)
        for g, a, t, flags in zip(group, at, texts, got, strict=True):
            assert [seen[(g, w - a, t[w : w + length])] > 1 for w in range(len(t) - length + 1)] == flags.tolist()


def luhn_ok(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def test_pii(docs, rows, empty):
    pats = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn_ok(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    }

    def base(t):
        return [(k, m.start(), m.end()) for k, (p, ok) in pats.items() for m in re.finditer(p, t) if ok(m[0])]

    for t in ["a@b@c.de.f", "x@@y.z a.b@c-d.e-f.", "+1 234 567 8901+44 20 7946 0958", "1.2.3.4.5.6.7.8 01.002.003.004", "4111-1111-1111-1111 4111111111111112", "@a.b é@ü.de a@b.c"]:
        names = pii.BASE_KINDS
        assert [(names[k], a, b) for k, a, b in pii.base_spans(t)] == base(t)
    got = pii.find_pii(docs).collect()
    want = Counter((d, sha(",".join(f"{k}:{a}:{b}" for k, a, b in base(t or "")))) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    r = next(r for r in got if r["doc_id"] == 20)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert set(filter(None, r["spans"].split(","))) >= {f"{k}:{a}:{b}" for k, a, b in base(rows[-1][1])}
    assert pii.find_pii(empty).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "[EMAIL]" in red[20] and "@" not in red[20] and red[4] is None


def test_lattice(spark, docs, rows, empty):
    strings = [bytes([i]) for i in range(256)] + [b"\n\n", b" a", b"ab", b"b", b"abc", b" ab", b"c"]
    strings = list(dict.fromkeys(strings))
    pieces = lattice_lm.Pieces(strings, np.linspace(1, 3, len(strings)))
    p = dict(zip(strings, np.exp(pieces.log), strict=True))

    def total(w):
        return 1.0 if not w else sum(p[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    words = [b"abc", b"a", b"abcab", b"zz", "é".encode()]
    assert np.allclose(pieces.scores(words), [np.log10(total(b" " + w)) for w in words])
    got = lattice_lm.score(docs).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    toks = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(t))] + ["\n"] for _, t, *_ in rows]
    c = Counter(w for (d, *_), ws in zip(rows, toks, strict=True) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (d, *_), ws in zip(rows, toks, strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice_lm.score(empty).count() == 0


def test_rare_words_meet_the_table(docs, monkeypatch):
    a = {(r["doc_id"], r["n_tokens"]): r for r in lattice_lm.score(docs).collect()}
    monkeypatch.setattr(lattice_lm, "FREQUENT", 2)
    for r in lattice_lm.score(docs).collect():
        o = a[(r["doc_id"], r["n_tokens"])]
        assert r["n_known"] == o["n_known"] and abs(r["score"] - o["score"]) < 1e-6 and abs(r["base_score"] - o["base_score"]) < 1e-6


def test_toxicity(spark, empty):
    rng = random.Random(4)
    plain = [w for w in VOCAB if w not in ("idiot", "scum")]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            words[5] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 4 == 0)))
    hidden = ["an 1d10t you are", "what a s.c.u.m thing", "i d i o t of the", "sccccum and the"]
    rows += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000, None), (2001, ""), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, lab).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[i]["predicted"] != y for i, _, y in labels if got[i]["held_out"])
    assert wrong == 0 and sum(r["held_out"] for r in got.values()) > 40
    assert all(got[1000 + i]["predicted"] == 1 for i in range(len(hidden)))
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0 and got[None]["held_out"] is False
    assert toxicity.score(empty, lab).count() == 0
    assert set(r["score"] for r in toxicity.score(docs, lab.limit(0)).collect()) == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home and the rest of it</a></li></ul></nav><div class="ad">Buy the thing that you have always wanted to have.</div>
<article><h1>Of the thing</h1><p><b>The thing is not what it was &amp; that is   all there is to say of it.<br><p>Short one.</p>
<div class="comments"><p>I think that the thing is not what you say it is at all.</p></div><p>And the last of the things that were said on that day.</p></article>
<aside>See also</aside><footer>&copy; me and the others of the house</footer></body></html>"""


def test_html(spark):
    want = "Of the thing\nThe thing is not what it was & that is all there is to say of it.\nShort one.\nAnd the last of the things that were said on that day."
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", PAGE[: PAGE.index("<aside")] + "<asi"), (3, "w", "plain")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in out.collect()]
    assert (1, want, len(want)) in got and (2, "", 0) in got and (None, "", 0) in got and (3, want, len(want)) in got
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    """Against the stages done one after the other in plain Python."""
    rng = random.Random(21)
    plain = [w for w in VOCAB if w not in ("idiot", "scum")]
    fresh = lambda k: " ".join(rng.choice(plain) + str(rng.randrange(9999)) for _ in range(k))
    rows, labels = [], []
    for i in range(300):
        t = fresh(30)
        if i % 5 == 0:
            t = t.replace(t.split()[3], "scum")
        rows.append((i, t))
        labels.append((i, 1, int(i % 5 == 0)))
    bench = fresh(25)
    copy = fresh(200)
    edited = copy.split()
    edited[100] = "other"
    rows += [(400, copy), (401, copy + " "), (402, copy.replace(" ", "  ")), (403, " ".join(edited)), (410, fresh(5) + " " + bench), (411, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stay = {d for d, t in rows if "scum" not in (t or "").split()} - {402, 403, 410}
    # 401 differs from 400 by a space at its end: no exact copy, but a near one
    stay -= {401}
    assert {r["doc_id"] for r in got} == stay
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "packing"]
