"""Language-model score by subword lattices.

The pieces of an existing subword vocabulary (and single bytes for whatever they do
not cover) span a lattice over each word; a word's probability is the sum over all
its segmentations of the product of piece probabilities, by forward recursion in
log space. No piece reaches over a word's start, so a document's marginal is the
product over its words and its end. Piece probabilities start from the vocabulary's
own ranking and are re-estimated by expectation-maximisation on the distinct training
words. A training word is an arc of its lattice too, with its absolutely discounted
share of the training tokens; the discounts are the weight of the spelled paths, so
that all of it is one probability distribution over texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Words of more bytes go sign by sign, one at a time.
LONG = 256
#: Words whose scores are broadcast; all others meet theirs in a shuffled join.
FREQUENT = 100_000
#: Distinct words a worker counts before it hands them on.
HELD = 300_000

_B = np.uint64(0x9E3779B97F4A7C15)
#: Words whose lattices are worked on together.
WORDS_AT_ONCE = 40_000
END = "\n"  # the end of a text as a token: no word holds white space


def _hashes(codes: np.ndarray, length: int) -> list[np.ndarray]:
    """For a matrix of bytes (words by positions): hash of the ``k`` bytes that start at
    each position, for k = 1 .. length."""
    out, h = [], np.zeros(codes.shape, np.uint64)
    width = codes.shape[1]
    for k in range(1, length + 1):
        h = h[:, : width - k + 1]
        h = (h ^ (codes[:, k - 1 : k - 1 + h.shape[1]].astype(np.uint64) + np.uint64(1))) * _B
        h = h ^ (h >> np.uint64(32))
        out.append(h)
    return out


class Pieces:
    """A vocabulary of byte strings with natural-log probabilities. The first 256 are
    the single bytes, so that every word has a segmentation; id 256 is the end."""

    def __init__(self, strings: list[bytes], weights: np.ndarray):
        self.strings, self.n = strings, len(strings)
        self.log = np.log(weights / weights.sum())
        self.by_length = {}
        self.longest = max((len(s) for i, s in enumerate(strings) if i != 256), default=1)
        size: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            if s and i != 256:
                size.setdefault(len(s), []).append(i)
        for k, ids in size.items():
            codes = np.frombuffer(b"".join(strings[i] for i in ids), np.uint8).reshape(len(ids), k)
            h = _hashes(codes, k)[k - 1][:, 0]
            order = np.argsort(h)
            self.by_length[k] = (h[order], np.array(ids, np.int32)[order])

    def find(self, codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, piece ids by word and start, -1 where none)."""
        out = []
        for k, h in enumerate(_hashes(codes, min(self.longest, codes.shape[1])), 1):
            if k in self.by_length:
                keys, ids = self.by_length[k]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out.append((k, np.where(keys[at] == h, ids[at], -1)))
        return out

    def forward(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list]:
        """Words of equal length: log marginals, all forward values, the arcs."""
        codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        width = codes.shape[1]
        arcs = self.find(codes)
        log = np.append(self.log, -np.inf)
        alpha = np.full((len(words), width + 1), -np.inf)
        alpha[:, 0] = 0.0
        if width > LONG:
            for w in range(len(words)):
                alpha[w] = _chain(width, *_arcs_of(arcs, w, log))
            return alpha[:, -1], alpha, arcs
        for e in range(1, width + 1):
            terms = [alpha[:, e - k] + log[ids[:, e - k]] for k, ids in arcs if k <= e]
            top = np.maximum.reduce(terms)
            alpha[:, e] = top + np.log(sum(np.exp(t - top) for t in terms))
        return alpha[:, -1], alpha, arcs

    def expected(self, words: list[bytes], n: np.ndarray) -> np.ndarray:
        """Expected piece counts of words of equal length, each seen n times."""
        total, alpha, arcs = self.forward(words)
        width = alpha.shape[1] - 1
        log = np.append(self.log, -np.inf)
        beta = np.full_like(alpha, -np.inf)
        beta[:, width] = 0.0
        if width > LONG:
            for w in range(len(words)):
                start, end, weight = _arcs_of(arcs, w, log)
                beta[w] = _chain(width, width - end, width - start, weight)[::-1]
        else:
            for s in range(width - 1, -1, -1):
                terms = [log[ids[:, s]] + beta[:, s + k] for k, ids in arcs if s + k <= width]
                top = np.maximum.reduce(terms)
                beta[:, s] = top + np.log(sum(np.exp(t - top) for t in terms))
        out = np.zeros(self.n + 1)
        for k, ids in arcs:
            weight = np.exp(alpha[:, : width - k + 1] + log[ids] + beta[:, k:] - total[:, None]) * n[:, None]
            out += np.bincount(np.where(ids < 0, self.n, ids).ravel(), weight.ravel(), self.n + 1)
        return out[: self.n]

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 marginals of any words, a leading space mark included; END is the end of a text."""
        out = np.zeros(len(words))
        for at in _by_length(words):
            out[at] = self.forward([b" " + words[i] for i in at])[0]
        for i, w in enumerate(words):
            if w == END.encode():
                out[i] = self.log[256]
        return out / np.log(10)


def _arcs_of(arcs: list[tuple[int, np.ndarray]], word: int, log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word's arcs: where they start, where they end, their log weights."""
    start = [np.flatnonzero(ids[word] >= 0) for _, ids in arcs]
    return np.concatenate(start), np.concatenate([s + k for s, (k, _) in zip(start, arcs, strict=True)]), np.concatenate([log[ids[word][s]] for s, (_, ids) in zip(start, arcs, strict=True)])


def _chain(width: int, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log sums over all paths from 0 to each place, sign by sign."""
    order = np.argsort(end, kind="stable")
    cuts = np.searchsorted(end[order], np.arange(1, width + 2)).tolist()
    start, weight = start[order].tolist(), weight[order].tolist()
    alpha = [0.0] * (width + 1)
    for e in range(1, width + 1):
        terms = [alpha[start[i]] + weight[i] for i in range(cuts[e - 1], cuts[e])]
        top = max(terms)
        alpha[e] = top + math.log(sum([math.exp(t - top) for t in terms]))
    return np.array(alpha)


def _by_length(words: list[bytes], most_cells: int = 200_000) -> list[list[int]]:
    """Positions of words of equal length, in groups of bounded total size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    out = []
    for k, ids in groups.items():
        step = max(1, most_cells // (k + 1))
        out += [ids[i : i + step] for i in range(0, len(ids), step)]
    return out


def _gathered(batches, most: int = WORDS_AT_ONCE):
    """Arrow batches put together to about ``most`` rows, so that words of equal length come in numbers."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def vocabulary(model_file: str | None = None) -> Pieces:
    """Bytes, end, and the word-inner pieces of a public vocabulary; the start weights
    fall with the rank that the vocabulary's own scores give (Zipf)."""
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file or P.path("piece_bpe_32k.model"))
    strings, rank = [bytes([i]) for i in range(256)] + [b"\n\n"], [sp.vocab_size()] * 256 + [100]
    seen = set(strings)
    for i in range(sp.vocab_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            s = sp.id_to_piece(i).replace("▁", " ").encode().lower()
            if b" " not in s[1:] and s not in seen:
                seen.add(s)
                strings.append(s)
                rank.append(int(-sp.get_score(i)) + 1)
    return Pieces(strings, 1.0 / (np.array(rank, float) + 10))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often training documents have it, 0 where only others do; the
    end of a text counts as the word END. Words are summed before they are shuffled."""
    schema = C.struct(("word", "string"), ("n", "bigint"), ("seen", "bigint"))
    arrow = C.arrow_schema(schema)

    def run(batches):
        trained, other = Counter(), Counter()

        def flush():
            keys = list(trained.keys() | other.keys())
            got = pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array([trained[k] for k in keys], pa.int64()), pa.array([trained[k] + other[k] for k in keys], pa.int64())], schema=arrow)
            trained.clear()
            other.clear()
            return got

        for b in batches:
            for out, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (other if out else trained).update(tokens(t) + [END.encode()])
            if len(trained) + len(other) > HELD:
                yield flush()
        if trained or other:
            yield flush()

    found = C.map_batches(docs.select("held_out", "text"), run, schema)
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def estimate(pieces: Pieces, counts: DataFrame, rounds: int = ROUNDS) -> Pieces:
    """Expectation-maximisation on all distinct training words: each round sums the
    expected piece counts of all partitions (as many numbers as the vocabulary has)."""
    spark = counts.sparkSession
    schema = C.struct(("piece", "int"), ("n", "double"))
    arrow = C.arrow_schema(schema)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pieces)

        def run(batches, sent=sent):
            model = sent.value
            total = np.zeros(model.n)
            for b in _gathered(batches):
                words = [w.encode() for w in b.column(0).to_pylist()]
                n = np.ones(len(words))  # each word is spelled once, then it has its own arc
                for at in _by_length(words):
                    if len(words[at[0]]) == 1:
                        ends = np.array([i for i in at if words[i] == END.encode()], int)
                        total[256] += n[ends].sum()
                        at = [i for i in at if words[i] != END.encode()]
                        if not at:
                            continue
                    total += model.expected([b" " + words[i] for i in at], n[at])
            at = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=arrow)

        total = np.zeros(pieces.n)
        for r in C.map_batches(counts.where("n > 0").select("word"), run, schema).groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["piece"]] = r["n"]
        # what was not met keeps a little of its old weight, bytes most
        pieces = Pieces(pieces.strings, total + 0.1 * np.exp(pieces.log) * pieces.n / 100 + 1e-3)
    return pieces


def score(docs: DataFrame, model_file: str | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Null text is empty: its end is its only token. Rows with a null id are training
    rows; repeated rows count and are scored one by one. Without training rows all
    probabilities are those of an untrained model. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counts = C.staged(word_counts(src), "words")
    once = lambda k: F.sum((F.col("n") == k).cast("long"))
    sums = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), once(1).alias("n1"), once(2).alias("n2")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    discount = sums["n1"] / (sums["n1"] + 2 * sums["n2"]) if sums["n1"] and sums["n2"] else 0.5
    model = estimate(vocabulary(model_file), counts, rounds)

    sent = spark.sparkContext.broadcast(model)
    schema = C.struct(("word", "string"), ("n", "bigint"), ("seen", "bigint"), ("score", "double"))
    arrow = C.arrow_schema(schema)

    def rate(batches):
        for b in _gathered(batches):
            words = [w.encode() for w in b.column(0).to_pylist()]
            log = sent.value.scores(words)
            if total:
                known = np.maximum(b.column(1).to_numpy(zero_copy_only=False) - discount, 0) / total
                with np.errstate(divide="ignore"):
                    log = np.logaddexp(np.log(known), np.log(discount * distinct / total) + log * np.log(10)) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(log)], schema=arrow)

    words = C.staged(C.map_batches(counts, rate, schema), "scored_words")

    # frequent words go to every worker, the rest of each text meets the table by word
    top = words.orderBy(F.desc("seen"), "word").limit(FREQUENT).collect()
    table = {r["word"].encode(): (r["n"], r["score"]) for r in top}
    frequent = spark.sparkContext.broadcast(table)
    del top

    part = C.struct(C.id_field(src), ("row", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("base", "double"), ("score", "double"), ("rare", "array<struct<word:string,k:int>>"))
    parrow = C.arrow_schema(part)
    down = np.log10(total + 0.5 * (distinct + 1))

    def sums_of(batches):
        from pyspark import TaskContext

        known = frequent.value
        weight = {w: (n > 0, np.log10(n + 0.5) - down, s) for w, (n, s) in known.items()}
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(2).to_pylist():
                ws = Counter(tokens(t))
                ws[END.encode()] += 1
                n = k = 0
                base = mine = 0.0
                left = []
                for w, c in ws.items():
                    n += c
                    x = weight.get(w)
                    if x is None:
                        left.append({"word": w.decode(), "k": c})
                    else:
                        k += c * x[0]
                        base += c * x[1]
                        mine += c * x[2]
                row += 1
                for col, v in zip(cols, (row, n, k, base, mine, left), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), b.column(1), *[pa.array(c, parrow.field(i + 3).type) for i, c in enumerate(cols[1:])]], schema=parrow)

    parts = C.staged(C.map_batches(src, sums_of, part), "parts")
    left = parts.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.k").alias("k"))
    met = left.join(words.hint("shuffle_hash"), "word")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known_"), F.sum(F.col("k") * (F.log10(F.col("n") + 0.5) - F.lit(float(down)))).alias("base_"), F.sum(F.col("k") * F.col("score")).alias("score_"))
    out = parts.drop("rare").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "known_").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "base_").alias("base_score"), plus("score", "score_").alias("score"))
