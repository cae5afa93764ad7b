"""Which values of a distributed collection occur twice, by compressed exchange.

Senders sort their distinct values, cut them by owner (ranges of the value space)
and send each owner one Golomb-Rice-coded block of gaps; owners answer with
bitmaps. A value that all senders hold reaches its owner once per sender at most.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers as Rice-coded gaps: a unary stream of
    quotients, then the remainders, k bits each; k follows from the mean gap."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    gaps[1:] -= np.uint64(1)  # distinct: the next is larger by one at least
    k = max(0, int(math.log2(max(1.0, float(gaps.mean())))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, ::-1]) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(block: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    k, bits = block[0], np.unpackbits(np.frombuffer(block, np.uint8, offset=1))
    ends = np.flatnonzero(bits == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    start = (int(ends[-1]) // 8 + 1) * 8
    r = np.zeros(n, np.uint64)
    for col in bits[start : start + n * k].reshape(n, k).T if k else ():
        r = (r << np.uint64(1)) | col.astype(np.uint64)
    gaps = (q.astype(np.uint64) << np.uint64(k)) + r
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64)


def mark_repeated(rows: DataFrame, values: Callable[[pd.DataFrame], np.ndarray], finish: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType, bits: int, owners: int, light: list[str] | None = None) -> DataFrame:
    """rows with a column ``sender``: ``values`` makes uint64 values below 2**bits from
    a sender's rows (from the columns ``light`` alone, if given); ``finish`` gets the
    rows and whether each value occurs anywhere else too, and returns rows of ``schema``."""
    width = -(-(1 << bits) // owners)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.unique(values(pdf))
        own = (v // np.uint64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(own, prepend=-1, append=owners))
        base = own.astype(np.uint64) * np.uint64(width)
        out = [(int(pdf["sender"].iloc[0]), int(own[a]), int(b - a), rice_encode(v[a:b] - base[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame(out, columns=["sender", "owner", "n", "block"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [rice_decode(b, n) for b, n in zip(pdf["block"], pdf["n"], strict=True)]
        v, n = np.unique(np.concatenate(lists), return_counts=True)
        twice = v[n > 1]
        maps = [zlib.compress(np.packbits(np.isin(x, twice, assume_unique=True)).tobytes(), 1) for x in lists]
        return pd.DataFrame({"sender": pdf["sender"].to_numpy(), "owner": pdf["owner"].to_numpy(), "n": pdf["n"].to_numpy(), "bitmap": maps})

    def mark(mine: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        v, back, n = np.unique(values(mine), return_inverse=True, return_counts=True)
        seen = [np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8))[:k] for m, k in maps.sort_values("owner")[["bitmap", "n"]].itertuples(index=False)]
        twice = (np.concatenate(seen) > 0 if seen else np.zeros(len(v), bool)) | (n > 1)
        return finish(mine, twice[back.ravel()])

    sent = rows.select("sender", *light) if light else rows
    blocks = sent.groupBy("sender").applyInPandas(send, "sender int, owner int, n long, block binary")
    maps = blocks.groupBy("owner").applyInPandas(answer, "sender int, owner int, n long, bitmap binary")
    return rows.groupBy("sender").cogroup(maps.groupBy("sender")).applyInPandas(mark, schema)
