"""The lattice decoder against all readings, and scores against a plain recomputation."""

import itertools
import math
import random

import numpy as np
import pytest

from tidemark.llm import toxicity as T

TEXTS = ["you are an idiot and a moron", "the thing is in the house of the others", "what a scum that is", "all of it is trash and nothing else"] * 5


def every_reading(restore, token, edges):
    """(score, text) of all ways through the lattice, one by one."""
    options = restore.lattice(token)
    cuts = [(False, True) if edges and i else (False,) for i in range(len(options))]
    for letters in itertools.product(*options):
        for ends in itertools.product(*cuts):
            a = b = 0
            score, text = 0.0, []
            for (letter, cost), end in zip(letters, ends, strict=True):
                if end:
                    if not b:
                        break  # a word has a letter
                    score += float(restore.log[a, b, 0]) + T.COST_EDGE
                    a = b = 0
                    text.append(" ")
                score += cost
                if letter:
                    k = T._CODE[letter]
                    score += float(restore.log[a, b, k]) + T.BONUS
                    a, b = b, k
                    text.append(letter)
            else:
                yield score + float(restore.log[a, b, 0]), "".join(text)


@pytest.mark.parametrize("edges", [False, True])
def test_viterbi_against_all_readings(edges):
    rng = random.Random(3)
    restore = T.Restorer(T.trigram_counts(TEXTS))
    signs = "idotscumar10$@!3.*--aab"
    tokens = ["1d10t", "i.d.i.o", "sccum", "tra$h", "mooo", "s*um", "aaa", "1", "..", "m0r0n"]
    tokens += ["".join(rng.choices(signs, k=rng.randint(1, 5 if edges else 7))) for _ in range(60)]
    for token in tokens:
        best: dict[str, float] = {}
        for score, text in every_reading(restore, token, edges):
            best[text] = max(score, best.get(text, -math.inf))
        got = restore(token, edges)
        assert got in best and best[got] == pytest.approx(max(best.values()), abs=1e-4), (token, got)


def test_scores_again():
    """Evidence and score from the lattice's words, without the model's caches."""
    restore = T.Restorer(T.trigram_counts(TEXTS))
    weights = {"w:idiot": 5.0, "w:scum": 4.0, "p:idio": 3.0, "p:mor": 0.0, "w:moron": 2.5}
    model = T.Model(restore, weights)
    model.logit = np.array([1.0, 0.25, -0.5, -2.0])
    rng = random.Random(4)
    words = ["idiot", "1d10t", "scum", "s.c.u.m", "moron", "thing", "the", "house", "idiotic", "m o r o n", "..."]
    for _ in range(40):
        text = " ".join(rng.choices(words, k=rng.randint(0, 9))).upper()
        found = []
        for token in set(text.lower().split()):
            found.append(max((mean_weight(w, weights) for w in T.readings(token, restore)), default=0.0))
        for run in T.spaced(text.lower()):
            found += [mean_weight(w, weights) for w in T.run_words(run, restore)]
        found = sorted((w for w in found if w > 0), reverse=True)
        z = (found[0] if found else 0.0) + 0.25 * sum(found[:3]) - 0.5 * math.log1p(len(found)) - 2.0
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z))) and model.score(text) == model.score(text)


def mean_weight(word, weights):
    own = [f"w:{word}", *(f"p:{word[:k]}" for k in (4, 5, 6) if len(word) > k)] if len(word) > 2 else []
    return sum(weights.get(f, 0.0) for f in own) / len(own) if own else 0.0
