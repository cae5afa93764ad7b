"""Periodic runs of words by a suffix tree, after Stoye and Gusfield.

A document's words become numbers. Only stretches whose every word lies in a repeated window can
hold a run, and only these go on. Their suffix tree (suffix array, common prefixes, and the
intervals that are its inner nodes) is walked by the smaller half: of each node's leaf list, all
but the largest child's part are asked whether the leaf one depth further, or one depth back, is in
the list as well. That yields every branching tandem repeat in n log n steps. A branching repeat is
the last square of a run; rotating it left reaches the run's start, and repeats of a multiple of the
period that end at the same word merge into it.

Documents are independent, so the work is a map over Arrow batches; symbols are numbered per
document, so one tree per batch holds a subtree for each of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Stretch words in one tree; a single document may hold more.
TREE_WORDS = 400_000
#: Leaves that are asked at once.
VISITS = 1_000_000


def number_words(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray, window: int) -> np.ndarray:
    """Maximal [first, end) of words that lie in a ``window`` of words which occurs twice (or shares its hash with another: then the tree decides)."""
    n = len(ids) - window + 1
    if n < 2:
        return np.empty((0, 2), np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return np.empty((0, 2), np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    np.add.at(at, twice, 1)
    np.add.at(at, twice + window, -1)
    return np.flatnonzero(np.diff((np.cumsum(at[:-1]) > 0).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each, common prefix of each with the one before; the first has 0). Prefixes
    double; only groups that are not settled are sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    first = np.concatenate(([True], text[sa[1:]] != text[sa[:-1]]))
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, k = [rank.copy()], 1
    while True:
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        who = sa[slots]
        one, two = rank[who].astype(np.int64), np.where(who + k < n, rank[np.minimum(who + k, n - 1)], -1).astype(np.int64)
        order = np.argsort(one * (n + 1) + two + 1, kind="stable")
        who, one, two = who[order], one[order], two[order]
        sa[slots] = who
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        first[slots] = new
        rank[who] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank.copy())
        k *= 2
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        step = same.astype(np.int64) << level
        a, b, lcp[1:] = a + step, b + step, lcp[1:] + step
    return sa, rank, lcp


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree's inner nodes: depth, first and last leaf, parent (the root is node 0), and each leaf's parent."""
    depth, low, high, parent, stack = [0], [0], [len(lcp) - 1], [0], [0]
    leaf = [0] * len(lcp)
    for k, d in enumerate([*lcp[1:].tolist(), 0]):
        # d: what leaves k and k + 1 share. Leaf k hangs on the deeper of its two sides
        top = stack[-1]
        if d > depth[top]:
            depth.append(d)
            low.append(k)
            high.append(k)
            parent.append(top)
            top = len(depth) - 1
            stack.append(top)
        leaf[k] = top
        while d < depth[top]:
            high[top] = k
            stack.pop()
            under = stack[-1]
            if d > depth[under]:  # a node between the two begins where the closed one did
                depth.append(d)
                low.append(low[top])
                high.append(k)
                parent.append(under)
                parent[top] = len(depth) - 1
                stack.append(len(depth) - 1)
            top = stack[-1]
    return tuple(np.array(x, np.int64) for x in (depth, low, high, parent, leaf))


def branching_repeats(text: np.ndarray) -> np.ndarray:
    """All (start, period) of tandem repeats in ``text`` that the next symbol does not continue; sorted by end, then period."""
    n = len(text)
    if n < 2:
        return np.empty((0, 2), np.int64)
    sa, rank, lcp = suffix_array(text)
    depth, low, high, parent, leaf = inner_nodes(lcp)
    # children: inner nodes but the root, then leaves
    c_low, c_high = np.concatenate((low[1:], np.arange(n))), np.concatenate((high[1:], np.arange(n)))
    c_parent = np.concatenate((parent[1:], leaf))
    order = np.lexsort((c_high - c_low, c_parent))
    largest = np.append(c_parent[order][1:] != c_parent[order][:-1], True)
    asked = order[~largest & (depth[c_parent[order]] > 0)]
    sizes = c_high[asked] - c_low[asked] + 1
    found = []
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(asked):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + VISITS, "right")))
        some, size = asked[begin:stop], sizes[begin:stop]
        begin = stop
        own = np.repeat(c_parent[some], size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(c_low[some], size)
        i, d, lo, hi = sa[at], depth[own], low[own], high[own]
        for j, start in ((i + d, i), (i - d, i - d)):
            there = np.flatnonzero((j >= 0) & (j < n))
            r = rank[j[there]]
            there = there[(r >= lo[there]) & (r <= hi[there])]
            s, q = start[there], d[there]
            after = s + 2 * q
            last = (after >= n) | (text[np.minimum(after, n - 1)] != text[s])
            found.append(np.stack((s[last], q[last]), 1))
    out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    out = np.unique(out, axis=0)
    return out[np.lexsort((out[:, 1], out[:, 0] + 2 * out[:, 1]))]


def rotations(text: np.ndarray, start: int, period: int, most: int) -> int:
    """By how many words the repeat at ``start`` can be rotated left, ``most`` at most; looked at in blocks that double."""
    k, block = 0, 16
    while k < most:
        m = min(block, most - k)
        a = start - k
        same = text[a - m : a] == text[a - m + period : a + period]
        if not same.all():
            return k + int(np.argmin(same[::-1]))
        k += m
        block *= 2
    return k


def maximal_runs(text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All (start, length, smallest period) of runs of at least ``least`` symbols and two periods that nothing extends."""
    out: list[tuple[int, int, int]] = []
    here, end = [], -1  # runs of any length that end at ``end``
    for s, q in branching_repeats(text).tolist():
        if s + 2 * q != end:
            here, end = [], s + 2 * q
        if any(q % p == 0 and start <= s for start, p in here):
            continue  # a smaller period holds for the whole repeat: its run has the same end, and is the same
        k = rotations(text, s, q, s)
        here.append((s - k, q))
        if 2 * q + k >= least:
            out.append((s - k, 2 * q + k, q))
    return out


def runs_of_batch(docs: list[np.ndarray], least: int) -> list[list[tuple[int, int, int]]]:
    """Each document's runs, by start and period; documents share trees of ``TREE_WORDS`` symbols."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    parts: list[tuple[int, int, np.ndarray]] = []  # document, first word, numbers
    held = 0

    def settle() -> None:
        nonlocal held
        if parts:
            # symbols of one document are its own, and a symbol of its own ends each stretch
            size = max(int(x.max()) for _, _, x in parts) + 1
            ends = size * (max(d for d, _, _ in parts) + 1)
            text = np.concatenate([y for k, (d, _, x) in enumerate(parts) for y in (x + d * size, [ends + k])])
            text = np.unique(text, return_inverse=True)[1].ravel().astype(np.int64)
            begins = np.cumsum([0] + [len(x) + 1 for _, _, x in parts])
            for s, length, q in maximal_runs(text, least):
                k = int(np.searchsorted(begins, s, "right")) - 1
                runs[parts[k][0]].append((parts[k][1] + s - int(begins[k]), length, q))
        parts.clear()
        held = 0

    for d, ids in enumerate(docs):
        # a run of ``least`` words and two periods repeats half of ``least`` words
        for a, b in stretches(ids, max(1, least // 2)).tolist():
            if b - a >= least:
                parts.append((d, a, ids[a:b]))
                held += b - a
        if held >= TREE_WORDS:
            settle()
    settle()
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for repeated periods, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[k] for k in keep.tolist()])


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array<struct<start, length, period>> by start, then period,
    in words from 0) and collapsed (the words that stay, joined by one space).

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q, of at least
    ``least`` words and 2*q, that no neighbouring word extends; overlapping runs are all listed, and a word goes if any
    run holds it after that run's first q words. Null and wordless texts have no words, no runs and an empty ``collapsed``;
    repeated rows and null ids are judged row by row; an empty table gives an empty result; other columns are ignored.
    """
    src = C.id_text(docs, id_col, text_col)
    schema = C.struct(C.id_field(src), ("n_words", "bigint"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("collapsed", "string"))
    arrow = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.split() for t in b.column(1).to_pylist()]
            runs = runs_of_batch([number_words(w) for w in words], least)
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(arrow.field("runs").type.value_type))
            offsets = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, parts).cast(arrow.field("runs").type)
            text = pa.array([collapse(w, r).decode() for w, r in zip(words, runs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), lists, text], schema=arrow)

    return C.map_batches(src, run, schema)


def collapse_runs(docs: DataFrame, least: int = 12, text_col: str = "text") -> DataFrame:
    """docs with each text that holds a run replaced by its ``collapsed`` words; all other texts, nulls included, and all
    columns stay as they are, whatever their names."""

    @F.pandas_udf("string")
    def cut(texts):
        words = [b"" if t is None else t.encode() for t in texts]
        words = [t.split() for t in words]
        runs = runs_of_batch([number_words(w) for w in words], least)
        return texts.__class__([collapse(w, r).decode() if r else t for t, w, r in zip(texts, words, runs, strict=True)], dtype=object)

    C.tune(docs.sparkSession)
    return docs.select(*[cut(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the CRC of the id, end in a repetition of their own words; a null id has the CRC of an empty text."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h.alias("h"))
    words: Column = F.split(F.btrim("text", F.lit(C.WHITE)), "[\\x20\\x09-\\x0D]+")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("array_join(transform(sequence(0, n - 1), i -> element_at(words, 1 + if(i < a, i, a + (i - a) % p))), ' ')")
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: doc_id, n_runs, the longest run (ties: first start, then smallest period), and hashes of all runs and of the words that stay."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.withColumn("best", best)
    length = -F.col("best.less")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(-best.less * 1000) div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
