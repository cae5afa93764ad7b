"""Toxicity with noisy-channel deobfuscation.

Tokens that may be disguised (leetspeak, stretched letters, letters set apart by
signs or spaces) become character lattices: what each written sign may stand for
and at which cost. A Viterbi search under a character trigram model of the corpus
restores the likeliest word, and the restored text is scored by word and stem
weights learned from labels, combined by a logistic model.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled training rows of which texts are read to fit the model.
MAX_LABELLED = 20_000
#: Log-likelihood gain a feature needs.
MIN_GAIN = 12.0
#: Words whose weight a worker remembers; the memory starts anew beyond it.
CACHE = 300_000

#: What a written sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "µ": "u"}
#: Signs that set letters apart and may be left out.
FILLERS = "*.-_~^'`,#%&:;/\\=\"<>[]{})?·•"
#: log10 costs of reading a sign as a letter, of leaving out a filler, of leaving out a repeated letter, and of any letter for a starred one.
COST_LEET, COST_FILLER, COST_REPEAT, COST_ANY = -0.6, -0.3, -0.4, -1.8
#: log10 cost of a word's edge between signs that stand alone.
COST_EDGE = 0.6
#: Added for each letter, so that short readings aren't preferred.
BONUS = 0.9

#: Symbols of the character model: 0 is a word's edge, then a-z, then other letters of Latin-1.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SYMBOLS = len(_LETTERS) + 1
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_TABLE = bytes(_CODE.get(bytes([i]).decode("latin-1"), 0) for i in range(256))

_EDGE = re.compile(r"^[^\w@$!|+€£(¡µ]+|[^\w@$]+$")
_STRETCH = re.compile(r"(.)\1\1")
_SINGLES = re.compile(r"(?<![^\s])(?:\S[.,]?[ \t]+){2,}\S(?![^\s])")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of character trigrams within words, with one edge on each side."""
    joined = "  ".join(t.lower() for t in texts)
    x = np.frombuffer(f" {joined} ".encode("latin-1", "replace").translate(_TABLE), np.uint8).astype(np.int32)
    codes = (x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:]
    return np.bincount(codes[x[1:-1] > 0], minlength=SYMBOLS**3)


class Restorer:
    """Viterbi decoding of character lattices under trigram log10 probabilities."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pairs = c.sum(axis=2, keepdims=True)
        low = (c.sum(axis=0) + 0.5) / (c.sum(axis=(0, 2))[:, None] + 0.5 * SYMBOLS)
        self.log = np.log10((c + 5.0 * low[None]) / (pairs + 5.0)).astype(np.float32)

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each written sign its readings (letter or nothing) and their costs."""
        out = []
        for i, ch in enumerate(token):
            options = []
            again = i > 0 and token[i - 1] == ch
            if again and i > 1 and token[i - 2] == ch:
                out.append([("", 0.0)])  # no word has a letter three times in a row
                continue
            if ch in _CODE:
                options.append((ch, -BONUS if again else 0.0))
                if again:
                    options.append(("", COST_REPEAT))
            for r in LEET.get(ch, ""):
                options.append((r, COST_LEET))
            if ch in FILLERS:
                options.append(("", COST_FILLER))
                if ch in "*#?":
                    options += [(v, COST_ANY) for v in "aeiouc"]
            if not options:
                options.append(("", COST_FILLER * 2))
            out.append(options)
        return out

    def __call__(self, token: str, edges: bool = False) -> str:
        """The likeliest reading; with ``edges`` it may be several words, apart by spaces."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two symbols: score, letters so far as a chain
        log = self.log
        for options in self.lattice(token):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            if edges:  # the word so far may end before this sign
                start = max(((s + float(log[a, b, 0]) + COST_EDGE, t) for (a, b), (s, t) in best.items() if b), key=lambda x: x[0], default=None)
                if start and ((0, 0) not in best or best[0, 0][0] < start[0]):
                    best[0, 0] = (start[0], (start[1], " "))
            for (a, b), (score, text) in best.items():
                for letter, cost in options:
                    if letter:
                        k = _CODE[letter]
                        key, s, t = (b, k), score + cost + float(log[a, b, k]) + BONUS, (text, letter)
                    else:
                        key, s, t = (a, b), score + cost, text
                    if key not in step or step[key][0] < s:
                        step[key] = (s, t)
            best = step
        chain = max(((s + float(log[a, b, 0]), t) for (a, b), (s, t) in best.items()), key=lambda x: x[0])[1]
        out = []
        while chain:
            chain, letter = chain
            out.append(letter)
        return "".join(reversed(out))


def disguised(token: str) -> bool:
    """Whether a token without its outer punctuation may hide a word: letters with
    signs or digits among them, or a letter three times in a row."""
    if token.isalpha():
        return bool(_STRETCH.search(token))
    letters = sum(c.isalpha() for c in token)
    return 0 < letters and letters + sum(c in LEET or c in FILLERS for c in token) == len(token)


def readings(token: str, restore: Restorer) -> tuple[str, ...]:
    """The words that a lower-case token may be: restored ones, its plain parts."""
    core = _EDGE.sub("", token)
    plain = "".join(c for c in core if c.isalpha()) if not core.isalpha() else core
    if not disguised(core):
        return (plain,) if core else ()
    again = restore(core)
    return (again,) if again == plain else (again, plain)


def spaced(text: str) -> list[str]:
    """Runs of three signs or more that stand alone, put together."""
    return ["".join(m[0].split()) for m in _SINGLES.finditer(text)]


def run_words(run: str, restore: Restorer) -> tuple[str, ...]:
    """The words in a run of signs: as the lattice with edges divides it, and as one word."""
    return tuple(dict.fromkeys([*restore(run, True).split(), restore(run)]))


def features(words: tuple[str, ...]) -> list[str]:
    out = []
    for w in words:
        if len(w) > 2:
            out.append("w:" + w)
            out += [f"p:{w[:k]}" for k in (4, 5, 6) if len(w) > k]
    return out


def document_features(text: str, restore: Restorer) -> set[str]:
    low = text.lower()
    found: set[str] = set()
    for token in set(low.split()):
        found.update(features(readings(token, restore)))
    for run in spaced(low):
        found.update(features(run_words(run, restore)))
    return found


def feature_weights(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least: int = 3) -> dict[str, float]:
    """Smoothed log odds of documents with a feature; only clear signs of toxicity: a
    large ratio, and a log-likelihood gain that chance does not reach among many features."""
    out = {}
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    for f, a in toxic.items():
        if a >= least:
            b = clean.get(f, 0)
            w = math.log((a + 0.1) / (n_toxic + 1)) - math.log((b + 0.6) / (n_clean + 1))
            gain = a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)
            if w > 2.0 and gain > MIN_GAIN:
                out[f] = w
    return out


class Model:
    def __init__(self, restore: Restorer, weights: dict[str, float]):
        self.restore, self.weights = restore, weights
        self.logit = np.zeros(4)
        self.labelled = 0  # rows it was fitted on
        self.seen: dict[str, float] = {}

    def __getstate__(self):
        return {"restore": self.restore, "weights": self.weights, "logit": self.logit, "labelled": self.labelled, "seen": {}}

    def weight(self, token: str) -> float:
        w = self.seen.get(token)
        if w is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            w = self.seen[token] = max(map(self.word, readings(token, self.restore)), default=0.0)
        return w

    def word(self, word: str) -> float:
        """Mean weight of a word and its stems: what only its beginning shares counts little."""
        own = features((word,))
        get = self.weights.get
        return sum(get(f, 0.0) for f in own) / len(own) if own else 0.0

    def evidence(self, text: str) -> np.ndarray:
        """Strongest weight, sum of the three strongest, how many, and a constant."""
        low = text.lower()
        found = [w for w in map(self.weight, set(low.split())) if w > 0.0]
        for run in spaced(low):
            found += [w for w in map(self.word, run_words(run, self.restore)) if w > 0.0]
        found.sort(reverse=True)
        return np.array([found[0] if found else 0.0, sum(found[:3]), math.log1p(len(found)), 1.0])

    def score(self, text: str) -> float:
        z = float(self.evidence(text) @ self.logit)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for logistic regression; a class that is missing gives a constant."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Character counts cover all documents. Weights come from training rows of
    ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0: at most ``most`` of
    them, those with the smallest hash of their id. Rows with null id or label are no labels."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = C.struct(("code", "int"), ("n", "bigint"))
    arrow = C.arrow_schema(schema)

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            total += trigram_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=arrow)

    counts = np.zeros(SYMBOLS**3)
    for r in C.map_batches(src.select("text"), count, schema).groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["code"]] = r["n"]  # at most SYMBOLS ** 3 rows
    restore = Restorer(counts)

    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # copies of a text are one example
    same = src.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.avg(F.col("toxic").cast("double")).alias("mean"))
    rows = C.staged(same.select((F.col("mean") >= 0.5).cast("int").alias("toxic"), "text").repartition(C.partitions(docs.sparkSession)), "labelled")

    shared = docs.sparkSession.sparkContext.broadcast(restore)
    fschema = C.struct(("feature", "string"), ("toxic", "bigint"), ("clean", "bigint"))
    farrow = C.arrow_schema(fschema)

    def gather(batches):
        sums = {0: Counter(), 1: Counter()}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[int(y > 0)].update(document_features(t, shared.value))
        keys = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[1][k] for k in keys], pa.int64()), pa.array([sums[0][k] for k in keys], pa.int64())], schema=farrow)

    table = C.map_batches(rows, gather, fschema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a feature that fewer than three of the bounded rows have is no sign
    table = table.where("toxic >= 3").collect()
    n = {r["y"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = feature_weights(Counter({r["feature"]: r["toxic"] for r in table}), Counter({r["feature"]: r["clean"] for r in table}), n.get(True, 0), n.get(False, 0))
    model = Model(restore, weights)

    sent = docs.sparkSession.sparkContext.broadcast(model)
    eschema = C.struct(("y", "double"), *[(f"x{i}", "double") for i in range(4)])
    earrow = C.arrow_schema(eschema)

    def measure(batches):
        for b in batches:
            x = np.array([sent.value.evidence(t) for t in b.column(1).to_pylist()]).reshape(-1, 4)
            y = np.array([float(v > 0) for v in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(y), *[pa.array(x[:, i]) for i in range(4)]], schema=earrow)

    seen = np.array([tuple(r) for r in C.map_batches(rows, measure, eschema).collect()], float).reshape(-1, 5)  # at most `most` rows
    model.labelled = len(seen)
    if len(seen):
        model.logit = fit_logistic(seen[:, 1:], seen[:, 0])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Null text is empty; empty texts get the score of no evidence. A null id is in no
    label row and not held out. Repeated rows are scored one by one. Without labels of both classes the score is
    the constant that fits them, or 0.5. An empty table gives an empty result."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, id_col, text_col))
    schema = C.struct(C.id_field(src), ("score", "double"))
    arrow = C.arrow_schema(schema)

    def run(batches):
        model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], schema=arrow)

    out = C.map_batches(src, run, schema)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without rows scored at the threshold or above; all columns stay. Each row is
    judged by its own text, whatever its id; null and empty texts have no evidence. Without any label to learn from, no
    row is rejected: a score of 0.5 for all says nothing. An empty table gives an empty result."""
    C.tune(docs.sparkSession)
    model = train(docs, labels)
    if not model.labelled:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def stays(texts):
        return texts.map(lambda t: sent.value.score(t) < threshold).astype(bool)

    return docs.where(stays(F.coalesce("text", F.lit(""))))
