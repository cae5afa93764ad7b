"""Repeated byte strings across a collection, by column-wise BWT construction.

Whole texts are cut into *fragments*: for each window of ``length`` bytes the
smallest hash of its ``GRAM``-byte grams is its anchor, and a fragment is a longest
run of windows with one anchor. Equal windows have equal anchor hashes, so windows
need comparing only between fragments of one anchor hash:

* a hash that occurs once: none of its windows repeats;
* fragments that are equal: all of their windows repeat;
* different fragments of one hash (the edges of copied passages): bounded batches of
  them go through the column-wise multi-document construction. Each round inserts
  one symbol per fragment into the collection's Burrows-Wheeler transform and updates
  common parts; as fragments are aligned at their anchors, the transform is the
  positional one, whose rounds cost as much as there are fragments and not as much as
  there are symbols. Neighbours whose common part reaches ``length`` repeat. An anchor
  with more fragments than one batch may hold is settled by an exchange of
  compressed window hashes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .exchange import mark_repeated

#: Bytes of an anchor gram.
GRAM = 32
#: Fragments of one batch of the column-wise construction.
BATCH = 6000
#: Bytes that are hashed at a time; a worker holds about 130 bytes for each.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = max(n + 1, CHUNK + 4096)
        with np.errstate(over="ignore"):
            both = []
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(size, np.uint64(b))
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _POWERS[0] = (both[0], both[1])
    return _POWERS[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def _range_hash(sums: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of data[a:e], the same wherever it stands."""
    return _mix((sums[e] - sums[a]) * _powers(len(sums))[1][a])


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    pad = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(x)] = x
    rows = pad.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def fragments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """All fragments of the texts: (text number, first window, last window, anchor
    offset from the first window, anchor hash, fragment hash)."""
    gram = min(GRAM, length)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(data), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        sums = _sums(part)
        at = np.arange(len(part) - gram + 1)
        grams = _range_hash(sums, at, at + gram)
        low = _slide_min((grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), length - gram + 1)[:n]
        p = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(lo, lo + n)
        doc = np.searchsorted(ends, start, side="right")
        ok = start + length <= ends[np.minimum(doc, len(ends) - 1)]
        key = np.where(ok, p, -1)
        cut = np.flatnonzero(np.diff(key, prepend=-2))
        last = np.append(cut[1:], n) - 1
        keep = key[cut] >= 0
        a, b = cut[keep], last[keep]
        d = doc[a]
        first = lo - (ends[d] - sizes[d])
        out.append((d, a + first, b + first, p[a] - a, grams[p[a]].view(np.int64), _range_hash(sums, a, b + length).view(np.int64)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeated_windows(texts: list[bytes], anchors: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For fragments aligned at their anchors: which windows of ``length`` bytes another
    fragment of the same group has at the same place.

    Column by column, each round inserts one symbol per fragment into the collection's
    positional Burrows-Wheeler transform: fragments stay sorted by their group and their
    reversed texts up to the column, next to the column at which the common part
    with their predecessor starts. Both are read and written front to back.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = int(anchors.max()) - anchors.astype(np.int64)
    last = first + sizes
    base = np.cumsum(sizes) - sizes - first
    _, group = np.unique(groups, return_inverse=True)
    group = group.astype(np.int32) * 257
    out = np.zeros(len(data) + 1, bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int32)  # where the common part with the predecessor starts; one more for reduceat
    for k in range(int(first.min()), int(last.max())):
        here = (first[order] <= k) & (k < last[order])
        symbol = np.full(n, 256, np.int32)  # texts that have not begun or have ended come last
        symbol[here] = data[base[order[here]] + k]
        key = group[order] + symbol
        by = np.argsort(key, kind="stable")
        sorted_key, here = key[by], here[by]
        pair = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & here[1:]) + 1
        new = np.full(n + 1, k + 1, np.int32)
        if len(pair):
            ends = np.empty(2 * len(pair), np.int64)
            ends[0::2], ends[1::2] = by[pair - 1] + 1, by[pair] + 1
            new[pair] = np.maximum.reduceat(common, ends)[0::2]
        order, common = order[by], new
        if k + 1 >= length:
            hit = pair[new[pair] <= k + 1 - length]
            if len(hit):
                start = k + 1 - length
                out[base[order[hit]] + start] = True
                out[base[order[hit - 1]] + start] = True
    start = base + first
    return [out[a : a + max(0, s - length + 1)] for a, s in zip(start, sizes, strict=True)]


def _runs(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered runs."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((a, e))
    return out


def _cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, e in runs:
        kept.append(text[at:a])
        at = e
    kept.append(text[at:])
    return b"".join(kept)


def repeated_bytes(docs: DataFrame, length: int = 200, batch: int = BATCH, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    with ``keep_text`` also kept (the remaining bytes).

    A byte goes when a string of ``length`` bytes that covers it starts anywhere else
    too, in the same text or another row's. Null is empty; rows that repeat an id are rows of
    their own (equal rows repeat each other); an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    src = C.id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    ident = C.id_field(src)
    schema = C.struct(ident, ("th", "bigint"), ("a", "int"), ("b", "int"), ("r", "int"), ("m", "bigint"), ("f", "bigint"))
    arrow = C.arrow_schema(schema)

    def scan(batches):
        for b in batches:
            doc, first, last, anchor, m, f = fragments(b.column(1).to_pylist(), length)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchor, pa.int32()), pa.array(m), pa.array(f)], schema=arrow)

    found = C.staged(C.map_batches(src, scan, schema), "fragments")
    total = found.count()

    # anchors that repeat, and whether all their fragments are equal
    anchors = C.staged(found.groupBy("m").agg(F.count(F.lit(1)).alias("n"), (F.min("f") != F.max("f")).alias("mixed")).where("n > 1"), "anchors")
    again = C.keyed_join(found, anchors, ["m"], ["n", "mixed"], "n", total, ["doc_id", "a"]).where("n is not null")
    again = C.staged(again, "repeated")
    mixed = again.where("mixed")
    first = F.min(F.struct("doc_id", "th", "a")).alias("first")
    forms = C.staged(mixed.groupBy("m", "f").agg(F.count(F.lit(1)).alias("k"), first), "forms")
    several = forms.where("k > 1").select("m", "f", "k", "first")
    mixed = C.keyed_join(mixed, several, ["m", "f"], ["k", "first"], "k", total, ["doc_id", "a"])
    lone = F.col("k").isNull()
    role = F.when(lone, F.lit(1)).when(F.col("first").eqNullSafe(F.struct("doc_id", "th", "a")), F.lit(2)).otherwise(F.lit(0))
    parts = mixed.withColumn("role", role).unionByName(again.where("not mixed").withColumn("role", F.lit(0)), allowMissingColumns=True)

    # role 0: all windows repeat; 1: to be compared; 2: all repeat, and others are compared with it
    info = parts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b", "r", "m", "role")).alias("parts"))
    info = info.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "parts")
    joined = src.join(info.hint("shuffle_hash"), src["doc_id"].eqNullSafe(info["_id"]) & (src["th"] == info["_th"]), "left").select("doc_id", "th", "text", "parts")

    result = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("kept", "binary")]
    spans = "array<struct<a:int,e:int>>"
    split = C.struct(ident, ("th", "bigint"), ("tag", "int"), *result, ("text", "binary"), ("spans", spans), ("m", "bigint"), ("a", "int"), ("r", "int"), ("role", "int"))
    sarrow = C.arrow_schema(split)

    def finished(text: bytes, runs: list[tuple[int, int]]) -> dict:
        kept = _cut(text, runs)
        return {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if keep_text else None}

    def divide(batches):
        for b in batches:
            rows, seen = [], set()
            for d, th, text, ps in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ps = ps or []
                ready = merge([(p["a"], p["b"] + length) for p in ps if p["role"] != 1])
                if any(p["role"] == 1 for p in ps):
                    rows.append({"doc_id": d, "th": th, "tag": 1, "text": text, "spans": [{"a": x, "e": y} for x, y in ready]})
                else:
                    rows.append({"doc_id": d, "th": th, "tag": 0} | finished(text, ready))
                for p in ps:
                    if p["role"] and (d, th, p["a"], p["b"]) not in seen:
                        seen.add((d, th, p["a"], p["b"]))
                        rows.append({"doc_id": d, "th": th, "tag": 2, "text": text[p["a"] : p["b"] + length], "m": p["m"], "a": p["a"], "r": p["r"], "role": p["role"]})
            yield pa.RecordBatch.from_pylist(rows, schema=sarrow)

    stage = C.staged(C.map_batches(joined, divide, split), "divided")
    pieces = stage.where("tag = 2").select("doc_id", "th", "m", "a", "r", "role", "text")
    per = pieces.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    hot = C.staged(per.where(F.col("n") > batch), "hot")  # each has more than `batch` fragments
    count = pieces.count()
    cold = pieces.join(hot.select("m"), "m", "left_anti")
    buckets = max(1, -(-count * 2 // batch))
    open_schema = C.struct(ident, ("th", "bigint"), ("a", "int"), ("e", "int"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo in _batches(pdf["m"].to_numpy(), batch):
            part = pdf.iloc[lo]
            flags = repeated_windows(part["text"].tolist(), part["r"].to_numpy(), part["m"].to_numpy(), length)
            for d, th, a, role, w in zip(part["doc_id"], part["th"], part["a"], part["role"], flags, strict=True):
                if role == 1:
                    out += [(d, th, a + x, a + y - 1 + length) for x, y in _runs(w)]
        return pd.DataFrame(out, columns=["doc_id", "th", "a", "e"])

    opened = cold.withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("bucket").applyInPandas(solve, open_schema)

    # anchors with very many different fragments: 63-bit hashes of their windows, by exchange
    large = pieces.join(hot.select("m"), "m").withColumn("sender", F.pmod(F.xxhash64("doc_id", "th", "a"), F.lit(max(C.partitions(spark), -(-count // batch)))).cast("int"))

    def hashes(pdf: pd.DataFrame) -> np.ndarray:
        out = []
        for m, t in zip(pdf["m"], pdf["text"], strict=True):
            x = np.arange(len(t) - length + 1)
            own = np.uint64(m & (1 << 64) - 1)
            out.append(_mix(_range_hash(_sums(np.frombuffer(t, np.uint8)), x, x + length) ^ own) >> np.uint64(1))
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def settle(pdf: pd.DataFrame, twice: np.ndarray) -> pd.DataFrame:
        out, at = [], 0
        for d, th, a, role, t in zip(pdf["doc_id"], pdf["th"], pdf["a"], pdf["role"], pdf["text"], strict=True):
            k = len(t) - length + 1
            if role == 1:
                out += [(d, th, a + x, a + y - 1 + length) for x, y in _runs(twice[at : at + k])]
            at += k
        return pd.DataFrame(out, columns=["doc_id", "th", "a", "e"])

    opened = opened.unionByName(mark_repeated(large, hashes, settle, open_schema, 63, max(C.partitions(spark), -(-count // batch))))
    opened = opened.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "e")).alias("more"))
    opened = opened.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "more")
    rest = stage.where("tag = 1").select("doc_id", "th", "text", "spans")
    rest = rest.join(opened.hint("shuffle_hash"), rest["doc_id"].eqNullSafe(opened["_id"]) & (rest["th"] == opened["_th"]), "left").select("doc_id", "text", "spans", "more")
    final = C.struct(ident, *result)
    farrow = C.arrow_schema(final)

    def close(batches):
        for b in batches:
            rows = []
            for d, text, x, y in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append({"doc_id": d} | finished(text, merge([(s["a"], s["e"]) for s in x + (y or [])])))
            yield pa.RecordBatch.from_pylist(rows, schema=farrow)

    names = ["doc_id", *[n for n, _ in result if n != "kept" or keep_text]]
    return stage.where("tag = 0").select(*names).unionByName(C.map_batches(rest, close, final).select(*names))


def _batches(m: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of about ``most`` at most; the rows of an anchor stay together."""
    order = np.argsort(m, kind="stable")
    out, lo = [], 0
    edges = np.append(np.flatnonzero(np.diff(m[order], prepend=m[order][0] - 1 if len(m) else 0)), len(m))
    for a, e in zip(edges[:-1], edges[1:], strict=True):
        if e - lo > most and a > lo:
            out.append(order[lo:a])
            lo = a
    if lo < len(m):
        out.append(order[lo:])
    return out
