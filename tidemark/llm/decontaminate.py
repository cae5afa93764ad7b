"""Benchmark decontamination: a broadcast hash set of benchmark word windows.

Training texts are scanned once. Words become numbers of the benchmark's
vocabulary, runs without an unknown word are rolled over with a hash, and hits
are verified word by word. Beyond ``MAX_WINDOWS`` the benchmark is cut into blocks
that each fit and the scan runs once for each block; nothing is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words: runs of 0-9, a-z (A-Z lowered) and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Windows in one broadcast set (several hundred bytes each, on the driver and in each Python worker).
MAX_WINDOWS = 500_000

_B = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _roll(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` ids."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ ids[i : len(ids) - size + 1 + i].astype(np.uint64)) * _B
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], list[object]]] = {}
        for item, ws in items:
            if ws:
                ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
                k = min(size, len(ids))
                for i in range(len(ids) - k + 1):
                    owners = found.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), [])
                    if not owners or owners[-1] != item:
                        owners.append(item)
        self.by_size = {}
        for k, table in found.items():
            hashes = _roll(np.array(list(table), np.int64).ravel(), k)[::k] if table else np.empty(0, np.uint64)
            self.by_size[k] = (np.unique(hashes), table)

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are in a window, and the items whose windows occur."""
        hit, items = np.zeros(len(ws), bool), set()
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        for k, (hashes, table) in self.by_size.items():
            if len(ids) < k:
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            part = ids[at[:, None] + np.arange(k)]
            out = np.zeros(len(at), np.uint64)
            for i in range(k):
                out = (out ^ part[:, i].astype(np.uint64)) * _B
                out ^= out >> np.uint64(29)
            near = np.searchsorted(hashes, out)
            for j in np.flatnonzero(hashes[np.minimum(near, len(hashes) - 1)] == out):
                owners = table.get(tuple(part[j].tolist()))
                if owners:
                    hit[at[j] : at[j] + k] = True
                    items.update(owners)
        return hit, items


def blocks(benchmark: DataFrame, size: int, most: int = MAX_WINDOWS, item_col: str = "item_id", text_col: str = "text") -> Iterator[Windows]:
    """The benchmark's windows in blocks of at most ``most``. Items are (number, name), rows of one id being one item; one of more
    windows goes on in the next block, from the words that no window before has begun with."""
    held: list[tuple[object, list[bytes]]] = []
    numbers: dict[object, int] = {}
    n = 0
    for item, text in benchmark.select(F.col(item_col), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        ws = words(text.encode())
        name = (numbers.setdefault(item, len(numbers)), "" if item is None else str(item))
        k = min(size, len(ws))
        for begin in range(0, len(ws) - k + 1 if ws else 0, most):
            part = ws[begin : begin + most + k - 1]
            if held and n + len(part) - k + 1 > most:
                yield Windows(held, size)
                held, n = [], 0
            held.append((name, part))
            n += len(part) - k + 1
    yield Windows(held, size)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, items (sorted item ids as strings), spans (array of [first, end)
    word positions that were hit), key (SHA-256 of the text).

    A window is ``size`` consecutive words of an item; an item of fewer words, but
    not none, is one window. Null and wordless texts have no words and are clean;
    repeated rows are judged one by one; an empty benchmark leaves all clean; rows that repeat an item id are one item;
    a null item id is an item of its own, called "". Other columns are ignored. The number of blocks changes nothing.
    """
    src = C.id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    schema = C.struct(C.id_field(src), ("key", "binary"), ("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<struct<no:int,item:string>>"), ("spans", "array<array<int>>"))
    arrow = C.arrow_schema(schema)
    parts = []
    for table in blocks(benchmark, size, most):
        shared = spark.sparkContext.broadcast(table)

        def run(batches, shared=shared):
            table = shared.value
            for b in batches:
                keys, n, hits, items, spans = [], [], [], [], []
                for t in b.column(1).to_pylist():
                    keys.append(hashlib.sha256(t).digest())
                    ws = words(t)
                    hit, found = table.scan(ws)
                    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    n.append(len(ws))
                    hits.append(int(hit.sum()))
                    items.append([{"no": k, "item": x} for k, x in sorted(found)])
                    spans.append(edges.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, arrow.field("items").type), pa.array(spans, pa.list_(pa.list_(pa.int32())))], schema=arrow)

        parts.append(C.map_batches(src, run, schema))
    out = parts[0]
    if len(parts) > 1:
        out = _merge(parts, schema)
    out = out.withColumn("items", F.sort_array(F.transform("items", lambda x: x["item"])))
    items = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans", "key")


def _merge(parts: list[DataFrame], schema) -> DataFrame:
    """Results of several blocks, one row per document: unions of items and spans. Rows are
    merged by id and text (its hash), so those that meet have one and the same result."""
    whole, n = parts[0], len(parts)
    for p in parts[1:]:
        whole = whole.unionByName(p)

    def join(pdf):
        import pandas as pd

        items = [{"no": k, "item": x} for k, x in sorted({(int(x["no"]), x["item"]) for row in pdf["items"] for x in row})]
        hit = np.zeros(int(pdf["n_words"].iloc[0]), bool)
        for row in pdf["spans"]:
            for a, b in row:
                hit[a:b] = True
        edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
        one = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].array, "key": pdf["key"].iloc[:1].array, "n_words": [len(hit)], "n_hit": [int(hit.sum())], "items": [items], "spans": [edges]})
        return one.loc[one.index.repeat(len(pdf) // n)]

    return whole.groupBy("doc_id", "key").applyInPandas(join, schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without the contaminated rows; all columns stay. Each row is judged by its own
    text, whatever its id. Null and empty texts have no words and stay; an empty benchmark removes nothing, an empty
    table gives an empty result."""
    C.tune(docs.sparkSession)
    out = docs
    for table in blocks(benchmark, size):
        out = out.where(_clean(docs.sparkSession.sparkContext.broadcast(table))(F.coalesce("text", F.lit("")).cast("binary")))
    return out


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: not shared.value.scan(words(t))[0].any()).astype(bool)

    return clean


def cut_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the hit words cut out of their texts instead (what stands between
    hit words goes too); all columns and rows stay, null text becomes empty. Rows meet their spans
    by id and text, so neither repeated ids nor the number of blocks change the result."""
    found = find_leaks(docs, benchmark, size, most, id_col, text_col).where("contaminated").select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = rows.withColumn("text_key", F.unhex(F.sha2(text.cast("binary"), 256)))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        done = []
        for t, own in zip(texts, spans, strict=True):
            if own is not None:
                raw = t.encode()
                at = [m.span() for m in WORD.finditer(raw.lower())]
                kept, last = [], 0
                for a, b in own:
                    kept.append(raw[last : at[a][0]])
                    last = at[b - 1][1]
                t = b"".join([*kept, raw[last:]]).decode()
            done.append(t)
        return pd.Series(done)

    C.tune(docs.sparkSession)
    met = rows.join(found.hint("shuffle_hash"), F.col("row").getField(id_col).eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["key"]), "left")
    return met.select(*[cut(text, F.col("spans")).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
