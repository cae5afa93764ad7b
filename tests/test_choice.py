"""Choice in order by rounds against the walk itself."""

import difflib
import random

import pytest

from tidemark.operators import choice, mining, news


@pytest.mark.parametrize("seed", range(3))
def test_rounds_against_the_walk(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.choice([0, 20, 90, 300]) if seed else 80)}
    if seed == 2:
        edges |= {(i, i + 1) for i in range(20)}  # a chain
    kept, leader = [], {}
    for i in range(n):
        near = [k for k in kept if (k, i) in edges]
        leader[i] = near[0] if near else i
        if not near:
            kept.append(i)
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "id bigint, place bigint")
    table = spark.createDataFrame(list(edges) * 2, "earlier bigint, later bigint")
    assert sorted(r["id"] for r in choice.kept_in_order(nodes.select("id"), table).collect()) == kept
    assert {r["id"]: r["leader"] for r in choice.leaders(nodes, table).collect()} == leader


def test_nothing_to_choose(spark):
    nodes = spark.createDataFrame([], "id bigint, place bigint")
    edges = spark.createDataFrame([], "earlier bigint, later bigint")
    assert choice.kept_in_order(nodes.select("id"), edges).count() == choice.leaders(nodes, edges).count() == 0


def some_titles(rng, n):
    words = ["rates", "rise", "falls", "bank", "central", "the", "oil", "market", "profit", "at", "deutsche", "上证", "指数"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            t = list(rng.choice(out) or "x")
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = [rng.choice("abc e")] * rng.randint(0, 1)
            out.append("".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(0, 7))))
    return out


@pytest.mark.parametrize("most", [0.75, 0.6, 0.9])
def test_titles_against_the_walk(spark, most):
    rng = random.Random(int(most * 100))
    titles = some_titles(rng, 90)
    rows = [(i, rng.choice(["s", "t", None]), t) for i, t in enumerate(titles)] + [(90, "s", None), (91, "s", "")]
    df = spark.createDataFrame(rows, "i int, src string, title string").repartition(3)

    def walk(mine):
        kept = []
        for i, _, t in mine:
            if all(difflib.SequenceMatcher(None, t or "", k or "").ratio() <= most for _, k in kept):
                kept.append((i, t))
        return [i for i, _ in kept]

    assert sorted(r["i"] for r in news.fuzzy_titles(df, None, "i", most=most).collect()) == walk(rows)
    want = sorted(i for s in ("s", "t", None) for i in walk([r for r in rows if r[1] == s]))
    assert sorted(r["i"] for r in news.fuzzy_titles(df, "src", "i", most=most).collect()) == want


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert news._length_of_common(a, b) == table[-1][-1]


def test_clusters_by_score(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(30)] for _ in range(3)]
    rows, scores = [], []
    for k in range(12):
        b, sign = base[k % 3], rng.choice([1, -1])
        rows += [(f"f{k}", f"d{i:02d}", sign * x + rng.gauss(0, 0.3)) for i, x in enumerate(b)]
        scores.append((f"f{k}", round(rng.random(), 1)))
    table = spark.createDataFrame(rows, "factor string, trade_date string, value double")
    import numpy as np

    curve = {n: np.array([v for f, _, v in rows if f == n]) for n, _ in scores}
    want = {}
    for n, _ in sorted(scores, key=lambda s: (-s[1], s[0])):
        want[n] = next((k for k in want if want[k] == k and abs(np.corrcoef(curve[k], curve[n])[0, 1]) >= 0.85), n)
    assert mining.clusters(table, scores) == want


@pytest.mark.parametrize("most", [0.75, 0.4])
def test_titles_in_tiles(spark, monkeypatch, most):
    """Many small tiles and tables, titles of several words of bits, signs beyond the first plane: the same pairs."""
    monkeypatch.setattr(news, "SMALL", 9)
    monkeypatch.setattr(news, "CELLS", 3000)
    rng = random.Random(8)
    titles = sorted(set(some_titles(rng, 60) + [t * 9 for t in some_titles(rng, 12)] + ["\U0001f600 oil", "\U0001f600 oil up", "x" * 250, "x" * 249 + "y"]))
    df = spark.createDataFrame([(i, i, None, t) for i, t in enumerate(titles)], "id bigint, place bigint, block string, title string")
    pairs = news.alike_titles(df, most)
    # no pairs are joined to be compared: what is joined is titles with their block's tiles
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "FlatMapGroupsInPandas" in plan
    want = sorted((i, k) for k, t in enumerate(titles) for i in range(k) if difflib.SequenceMatcher(None, t, titles[i]).ratio() > most)
    assert sorted(map(tuple, pairs.collect())) == want
