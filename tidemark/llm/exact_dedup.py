"""Exact deduplication by a Golomb-coded fingerprint exchange.

Every input partition is a sender. It sorts its distinct fingerprints, cuts them
by owner (ranges of the fingerprint space) and sends each owner one
Golomb-Rice-coded block of gaps. The owner answers with a bitmap of those that
another sender has too. Rows whose fingerprint is marked, there or within their
own partition, are suspects; only their texts meet byte for byte: a filter of
bounded size over the suspects' fingerprints goes to a second scan, and a text
that isn't in it stays where it is.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .exchange import mark_repeated

#: Bits beyond log2(rows): a row is a false suspect about once in 2**EXTRA_BITS.
EXTRA_BITS = 16
#: Bits of the suspects' filter for each different suspect: with two places for each, one other text in 70 passes.
FILTER_BITS = 16
#: log2 of its bits at most: 64 MB. Beyond 2**25 different suspects it fills up, and more texts travel that turn out to have no equal.
FILTER_MOST = 29
#: Fixed value: bits in a bucket of Spark's bitmap functions.
BUCKET = 1 << 15
_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def normalise(b: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    if not b:
        return b
    core = b" ".join(b.split())
    if not core:
        return b" "
    return (b" " if b[0] in _SPACE else b"") + core + (b" " if b[-1] in _SPACE else b"")


def suspect_filter(shas: DataFrame, most: int = FILTER_MOST) -> np.ndarray:
    """Bytes of a Bloom filter of the only column (hex hashes), a power of two of bits: the places of a hash are its first
    and second 32 bits, modulo. Bits are set by bitmap aggregates on the executors; 2**most bits come back at most."""
    sha = F.col(shas.columns[0])
    different = shas.agg(F.approx_count_distinct(sha)).first()[0]
    size = 1 << min(most, max(15, math.ceil(math.log2(different * FILTER_BITS + 1))))
    places = F.array(*[F.conv(F.substring(sha, at, 8), 16, 10).cast("long") % size + 1 for at in (1, 9)])
    place = shas.select(F.explode(places).alias("p"))
    buckets = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for b, bits in buckets.collect():
        lo = (b - 1) * BUCKET // 8
        out[lo : lo + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def may_hold(bits: np.ndarray, digest: bytes) -> bool:
    size = len(bits) * 8
    places = (int.from_bytes(digest[:4], "big") % size, int.from_bytes(digest[4:8], "big") % size)
    return all(bits[p >> 3] >> (p & 7) & 1 for p in places)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes a
    space; null is empty. The smallest id of equal texts stays. Null ids lose to
    any other; rows that repeat an id with the same text share its flag. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    src = C.id_text(docs, id_col, text_col)
    ident = C.id_field(src)
    made = C.struct(("sender", "int"), ident, ("fp", "bigint"), ("sha", "string"))
    arrow = C.arrow_schema(made)

    def fingerprint(batches):
        sender = TaskContext.get().partitionId()
        for b in batches:
            shas = [hashlib.sha256(normalise(t)) for t in b.column(1).to_pylist()]
            fps = np.frombuffer(b"".join(s.digest()[:8] for s in shas), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), sender, np.int32)), b.column(0), pa.array(fps), pa.array([s.hexdigest() for s in shas], pa.string())], schema=arrow)

    rows = C.staged(C.map_batches(src, fingerprint, made), "fingerprints")
    total = rows.count()
    bits = min(63, max(24, math.ceil(math.log2(total + 1)) + EXTRA_BITS))
    owners = max(C.partitions(spark), -(-total // 1_000_000))

    def short(fp: pd.Series) -> np.ndarray:
        return fp.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)

    def finish(mine: pd.DataFrame, twice: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": mine["doc_id"], "sha": mine["sha"], "suspect": twice})

    marked = mark_repeated(rows, lambda pdf: short(pdf["fp"]), finish, C.struct(ident, ("sha", "string"), ("suspect", "boolean")), bits, owners, ["fp"])
    marked = C.staged(marked, "marked")

    held = spark.sparkContext.broadcast(suspect_filter(marked.where("suspect").select("sha")))
    found = C.struct(ident, ("same", "binary"))
    farrow = C.arrow_schema(found)

    def suspects(batches):
        for b in batches:
            texts = [normalise(t) for t in b.column(1).to_pylist()]
            inside = [i for i, t in enumerate(texts) if may_hold(held.value, hashlib.sha256(t).digest())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(inside, pa.int32())), pa.array([texts[i] for i in inside], pa.binary())], schema=farrow)

    texts = C.map_batches(src, suspects, found)
    groups = texts.groupBy("same").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = C.staged(groups.select(F.sha2("same", 256).alias("sha"), "keep", "n"), "groups")

    out = C.keyed_join(marked, groups, ["sha"], ["keep", "n"], "n", total, ["doc_id"])
    keep = F.when(F.col("n").isNotNull(), F.col("keep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the smallest id; all columns stay. Rows are told
    apart even if they share an id or have none: null ids lose to any other, and one of
    several rows with the same id, or all without one, stays."""
    rows, key = C.keyed_rows(docs, id_col, text_col)
    return C.without(rows, key, exact_groups(rows, key, text_col).where(~F.col("kept")).select("doc_id"), docs.columns)
