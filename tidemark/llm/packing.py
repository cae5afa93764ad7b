"""Best-fit packing after Martello-Toth dominance reduction.

Sizes are small integers, so the whole instance is a histogram of at most
``capacity`` counts, whatever the number of documents. The reduction fixes sets
of up to three items that dominate every other set with their largest item, until
none is left; what remains is packed best-fit, bin by bin. The plan is a list of bin patterns with
multiplicities; documents find their place in it by rank within their size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Chunks of text whose ids a worker remembers; the memory starts anew beyond it.
CACHE = 300_000
#: Buckets by which ranks within a size are counted.
BUCKETS = 4096

# white space before a space: the rule by which texts are cut at spaces does not hold there
_AWKWARD = re.compile(r"\s ")

#: Fixed value: the added token of the vocabulary. Texts that spell it have its id there.
ADDED, ADDED_ID = "<|endoftext|>", 50256


class Encoder:
    """Byte-BPE ids of the public 50k vocabulary, as little-endian uint32 bytes.

    ``tokenizers`` and ``tiktoken`` give equal ids for it (tested); the latter is
    five times faster. A space after a non-space always starts a new token, so
    texts are cut there and the ids of frequent chunks are remembered. A call takes
    the added token for plain text, ``document`` gives its id.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers as P
        import tiktoken

        with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _AWKWARD.search(text):
            return self._ids(text)
        seen, out = self.seen, []
        parts = text.split(" ")
        out.append(self._ids(parts[0]))
        get = seen.get
        for p in parts[1:]:
            b = get(p)
            if b is None:
                if len(seen) >= CACHE:
                    seen.clear()
                b = seen[p] = self._ids(" " + p)
            out.append(b)
        return b"".join(out)

    def document(self, text: str) -> bytes:
        if ADDED not in text:
            return self(text)
        return np.array([ADDED_ID], "<u4").tobytes().join(self(part) for part in text.split(ADDED))

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and an end
    id, cut into pieces of ``capacity`` of which only the first may be shorter.
    Null text is empty and has the end id alone."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = C.struct(C.id_field(src), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"))
    arrow = C.arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.document(t) + end
                n = len(ids) // 4
                at, k = 0, n % capacity or capacity
                p = 0
                while at < n:
                    rows.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + k)]))
                    at, k, p = at + k, capacity, p + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=arrow)

    return C.map_batches(src, run, schema)


def dominating(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, ...] | None:
    """Partners of an item beside which ``room`` is left, chosen among items of ascending
    ``sizes``: a set of at most two that dominates every other feasible set, if one is sure to.

    A set dominates another if the other's items can be put in place of its own, each of which
    may take several. With a as the largest item that fits: where none fits, the empty set does; where
    only one fits at a time or a fills the room, a does; where two fit at most, a does if no two together
    are larger, and a with b, the largest item beside it, if no pair has a smaller item above b.
    """
    fit = int(np.searchsorted(sizes, room, side="right"))
    if fit == 0:
        return ()
    s, n = sizes[:fit], counts[:fit]
    a = int(s[-1])
    # how many of the smallest fit together, up to three
    small = np.repeat(s[:3], np.minimum(n[:3], 3))[:3].cumsum()
    most = int((small <= room).sum())
    if most == 1 or a == room:
        return (a,)
    if most > 2:
        return None
    # pairs: each item's largest partner, itself only if there are two
    at = np.searchsorted(s, room - s, side="right") - 1
    own = np.arange(fit)
    at = np.where((at == own) & (n < 2), at - 1, at)
    paired = at >= 0
    if not paired.any() or int((s[own[paired]] + s[at[paired]]).max()) <= a:
        return (a,)
    beside = int(at[-1])
    if beside < 0:
        return None
    # the smaller item of any pair is below its partner or equal to it: the largest that has one not below
    up = np.where(n >= 2, s, np.append(s[1:], room + 1))
    lower = s[s + up <= room]
    return (a, int(s[beside])) if not len(lower) or int(lower.max()) <= int(s[beside]) else None


def reduce_dominated(count: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on counts by size: bins (sizes, how many of them) that
    some optimal packing has, taken out of ``count``.

    Sizes are gone through from the largest down; a set of up to three items that dominates all
    others with the size's item is fixed as often as its items last. Passes are made until one
    fixes nothing, as each bin that leaves may make other sets dominate.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for s in sorted(count, reverse=True):
            while count[s] > 0:
                sizes = np.array(sorted(x for x in count if count[x] - (x == s) > 0), np.int64)
                counts = np.array([count[int(x)] - (int(x) == s) for x in sizes], np.int64)
                partners = dominating(sizes, counts, capacity - s)
                if partners is None:
                    break
                used = Counter((s, *partners))
                times = min(count[x] // k for x, k in used.items())
                fixed.append(((s, *partners), times))
                for x, k in used.items():
                    count[x] -= k * times
                again = True
    return fixed


def best_fit(count: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, bin by bin: the open bin takes the largest item that still
    fits until none does; equal bins are made together."""
    sizes = np.array(sorted(x for x in count if count[x] > 0), np.int64)
    left = np.array([count[int(x)] for x in sizes], np.int64)
    bins = []
    while len(sizes):
        used: Counter = Counter()
        room = capacity
        while True:
            i = int(np.searchsorted(sizes, room, side="right")) - 1
            while i >= 0 and left[i] - used[i] <= 0:
                i -= 1
            if i < 0:
                break
            k = min(int(left[i]) - used[i], room // int(sizes[i]))
            used[i] += k
            room -= k * int(sizes[i])
        times = min(int(left[i]) // k for i, k in used.items())
        bins.append((tuple(int(sizes[i]) for i in sorted(used, reverse=True) for _ in range(used[i])), times))
        for i, k in used.items():
            left[i] -= k * times
        keep = left > 0
        sizes, left = sizes[keep], left[keep]
    return bins


def plan(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins for the counts by size: those the reduction fixes, then best fit."""
    rest = Counter({int(s): int(n) for s, n in count.items() if n})
    fixed = reduce_dominated(rest, capacity)
    return fixed + best_fit(rest, capacity)


def slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of a size go: rows (size, first rank, end rank, first bin, step, offset).
    The item of rank first + j lies in bin first bin + j at that offset."""
    out, rank, base = [], Counter(), 0
    for sizes, times in bins:
        at = 0
        for s in sizes:
            out.append((s, rank[s], rank[s] + times, base, 1, at))
            rank[s] += times
            at += s
        base += times
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per
    piece; the pieces of a sequence lie gapless from 0 and hold at most ``capacity`` ids.

    Repeated rows and null ids are packed as rows of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = C.staged(pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces")
    total = rows.count()
    buckets = max(1, min(BUCKETS, total // 500))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)

    # at most `capacity` counts, whatever the input
    count = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(count, capacity))

    # rank within the size: rows before the bucket, then row number within it
    per = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("length").alias("_l"), F.col("bucket").alias("_b"), before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("nth", nth).join(per, (F.col("length") == F.col("_l")) & (F.col("bucket") == F.col("_b")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)

    # slots are found by size and bisection; their number follows the number of sizes
    by: dict[int, list] = {}
    for s, a, b, first, _, at in table:
        by.setdefault(s, []).append((a, b, first, at))
    shared = spark.sparkContext.broadcast({s: np.array(sorted(v), np.int64) for s, v in by.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        size, rk = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        for s in np.unique(size):
            t, at = shared.value[int(s)], np.flatnonzero(size == s)
            i = np.searchsorted(t[:, 0], rk[at], side="right") - 1
            seq[at] = t[i, 2] + rk[at] - t[i, 0]
            off[at] = t[i, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked.withColumn("at", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
