"""Numbers of expressions, budgets, and the schedule's quotas at every prefix and after restarts."""

from collections import Counter

import pytest

from tidemark.operators import grammar as G
from tidemark.operators import mining
from tidemark.plans.ast import parse, walk

TINY = G.Grammar(("close", "volume"), ("abs",), ("mean",), ("+",), (3, 5), 3, 8)


def listed(g, n, w):
    """All expressions with n operators and windows of w, made the long way."""
    if n == 0:
        return list(g.leaves) if w == 0 else []
    out = [f"{f}({x})" for f in g.unary for x in listed(g, n - 1, w)]
    out += [f"{f}({x}, {k})" for k in g.windows if k <= w for f in g.windowed for x in listed(g, n - 1, w - k)]
    return out + [f"({x} {f} {y})" for f in g.binary for a in range(n) for u in range(w + 1) for x in listed(g, a, u) for y in listed(g, n - 1 - a, w - u)]


def test_each_number_is_one_expression():
    want = Counter(str(parse(x)) for n in range(4) for w in range(9) for x in listed(TINY, n, w))
    got = Counter(str(TINY.expression(i)) for i in range(TINY.total))
    assert got == want and max(got.values()) == 1 and TINY.total == sum(want.values())
    with pytest.raises(ValueError):
        TINY.expression(TINY.total)


def test_a_walk_meets_each_number_once():
    for seed in range(3):
        step = TINY.walk(seed)
        assert sorted(map(step, range(TINY.total))) == list(range(TINY.total))
    assert [TINY.walk(1)(i) for i in range(5)] != [TINY.walk(2)(i) for i in range(5)]


def test_budgets_of_the_full_grammar():
    g = G.Grammar()
    step = g.walk(5)
    sizes = set()
    for i in range(60):
        e = g.expression(step(i))
        nodes = list(walk(e))
        ops = [n for n in nodes if n.op not in ("num", "var")]
        windows = sum(n.args[-1].value for n in ops if n.op in g.windowed)
        assert len(ops) <= 26 and windows <= 160 and str(parse(str(e))) == str(e)
        sizes.add(len(ops))
    assert max(sizes) > 20


def test_schedule(spark, tmp_path):
    g = G.Grammar(("close", "volume"), ("abs", "neg"), ("mean", "std"), ("+",), (3, 5, 8), 3, 16)
    whole = G.Schedule(spark, f"{tmp_path}/a", g, quota=2, batch=150, seed=1)
    for _ in range(3):
        whole.advance()
    rows = whole.accepted().orderBy("id").collect()
    seen, used = set(), Counter()
    expected = []
    step = g.walk(1)
    for i in range(450):
        t = str(g.expression(step(i)))
        f, s = mining.equivalence_key(t), mining.novelty_key(t)
        # within a batch, only the first of a fingerprint is looked at; one that the quota refused may come again later
        if f not in seen and used[s] < 2:
            expected.append(i)
            used[s] += 1
            seen.add(f)
    ids = [r["id"] for r in rows]
    assert len({r["fingerprint"] for r in rows}) == len(rows) == len(set(r["expression"] for r in rows))
    prefix = Counter()
    for r in rows:
        prefix[r["structure"]] += 1
        assert prefix[r["structure"]] <= 2
    assert ids == expected

    # another process goes on; a batch that was cut off before its mark is written anew
    again = G.Schedule(spark, f"{tmp_path}/b", g, quota=2, batch=150, seed=1)
    again.advance()
    G.candidates(spark, g, 150, 160, 1).write.parquet(f"{tmp_path}/b/accepted/batch=1")
    assert {r["batch"] for r in again.accepted().select("batch").distinct().collect()} == {0}
    for _ in range(2):
        G.Schedule(spark, f"{tmp_path}/b", g, quota=2, batch=150, seed=1).advance()
    assert [r["id"] for r in again.accepted().orderBy("id").collect()] == ids
