"""Exact Jaccard similarity join on word n-grams by vertical partitioning.

The global n-gram order is the order of 64-bit n-gram hashes. Cut into ranges it
gives fragments; a document's set falls into one segment per fragment, partial
overlaps of a pair are counted fragment by fragment, and the sum per pair
decides. Before that:

* documents with the same set are one class, of which one travels;
* the prefix rule picks candidates: with a threshold t, two linked sets share at least
  ``more`` n-grams among the first n - ceil(t n) + more of each. Which n-grams two
  classes have is found by an exchange of compressed hashes, not by a shuffle of postings;
* n-grams that no second candidate holds cannot overlap, so a set with too many
  of them has no link and leaves;
* sets that share one of their rarest n-grams, directly or through others, form clusters. Pairs are
  counted within a cluster's task and leave it as a spanning forest of links, one
  per set at most: no group's pairs are ever listed. A cluster too large for one task is
  cut into blocks, each two of which meet in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .exchange import mark_repeated

#: Vertical fragments: ranges of the n-gram order.
FRAGMENTS = 8
#: Sets of a cluster that one task compares; larger clusters are cut into blocks of so many.
BLOCK = 500

#: Sets of one sender of the exchange, hashes of one owner.
SENDER_SETS, OWNER_HASHES = 100_000, 4_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct int64 hashes of the word n-grams; a text of fewer words has
    one n-gram, its whole sequence. A-Z is lowered, ASCII white space splits."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter((h(x) for x in words), np.uint64, len(words))
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _A + w[i : len(w) - k + 1 + i] * _B)
    return np.unique(out.view(np.int64))


def _need(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def prefix_more(n: int) -> int:
    """How many n-grams linked sets must share in their prefixes; the prefix is longer by as many."""
    return max(1, n * 12 // 100)


def prefix_length(n: int, num: int, den: int) -> int:
    """n-grams of the prefix. A linked partner shares at least ceil(t n) of n n-grams, so
    any first n - ceil(t n) + more hold ``more`` of the common ones; the first common ones are in both prefixes."""
    return min(n, n - _need(n, num, den) + prefix_more(n)) if n else 0


def prefix_least(n: int, num: int, den: int) -> int:
    """Shared n-grams in the prefix without which no link is possible: what the
    smallest partner, of ceil(t n) n-grams, needs."""
    return prefix_more(_need(n, num, den))


def _width(rows: int) -> int:
    """Bytes of a shortened hash by which prefixes are compared: a hundredth of chance hits at most."""
    return min(7, -(-(max(1, rows).bit_length() + 14) // 8))


def _set_hash(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _shorten(grams: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of each hash in unsigned order."""
    return (grams ^ np.int64(-(1 << 63))).astype(">i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _lengthen(packed: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - width :] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def _heads(docs: DataFrame, size: int, num: int, den: int, width: int) -> DataFrame:
    """Per row: doc_id, n, set hash (s1, s2), the shortened n-grams of the prefix."""
    schema = C.struct(C.id_field(docs), ("n", "bigint"), ("s1", "bigint"), ("s2", "bigint"), ("head", "binary"))
    arrow = C.arrow_schema(schema)

    def run(batches):
        for b in batches:
            n, s1, s2, head = [], [], [], []
            for t in b.column(1).to_pylist():
                g = shingle_hashes(t, size)
                x, y = _set_hash(g)
                n.append(len(g))
                s1.append(x)
                s2.append(y)
                head.append(_shorten(g[: prefix_length(len(g), num, den)], width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(head, pa.binary())], schema=arrow)

    return C.map_batches(docs, run, schema)


def _whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, grams) of rows (doc_id, text, s1, s2) whose set has that hash; the
    rows of an id are in one partition, and the first of repeated ones is taken."""
    schema = C.struct(C.id_field(docs), ("n", "bigint"), ("grams", "array<bigint>"))
    arrow = C.arrow_schema(schema)

    def run(batches):
        seen = set()
        for b in batches:
            rows, grams = [], []
            for i, (d, t, x, y) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)):
                g = shingle_hashes(t, size)
                if d not in seen and _set_hash(g) == (x, y):
                    seen.add(d)
                    rows.append(i)
                    grams.append(g)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([len(g) for g in grams], pa.int64()), pa.array(grams, pa.list_(pa.int64()))], schema=arrow)

    return C.map_batches(docs, run, schema).withColumnRenamed("doc_id", "id")


def _grams(sets: DataFrame) -> int:
    return sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, by hooking and pointer jumping; the
    number of rounds grows with the logarithm of the longest path. Edges are (a, b).
    Every join is a ``keyed_join``: neither a node with very many edges nor a component with very many
    members meets in one task."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = C.staged(both, "edges")
    degrees = both.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    labels = C.staged(nodes.join(degrees, nodes["id"] == degrees["b"], "left").select("id", F.col("id").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree")), "labels")
    n_edges, n_nodes = both.count(), labels.count()
    size = F.count(F.lit(1)).alias("size")
    while True:
        seen = labels.where("degree > 0").select(F.col("id").alias("b"), "comp", "degree")
        best = C.keyed_join(both, seen, ["b"], ["comp"], "degree", n_edges, ["a"]).groupBy(F.col("a").alias("n")).agg(F.min("comp").alias("near"))
        hooked = labels.join(best, labels["id"] == best["n"], "left").select("id", "comp", "degree", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        hooked = C.staged(hooked, "hooked")
        # a root takes the least label that any of its members has seen
        roots = hooked.groupBy("comp").agg(F.min("new").alias("to"), size).where("to < comp")
        step = C.keyed_join(hooked, roots, ["comp"], ["to"], "size", n_nodes, ["id"])
        step = C.staged(step.select("id", F.col("comp").alias("old"), F.least("new", F.coalesce("to", "new")).alias("comp"), "degree"), "labels")
        # pointer jumping: follow the label of the label
        sizes = step.groupBy(F.col("comp").alias("label")).agg(size)
        up = sizes.join(step.select("id", F.col("comp").alias("next")), F.col("label") == F.col("id")).select(F.col("label").alias("comp"), "next", "size")
        jumped = C.keyed_join(step, up, ["comp"], ["next"], "size", n_nodes, ["id"])
        jumped = C.staged(jumped.select("id", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "degree"), "labels")
        if jumped.where("comp <> old").isEmpty():
            return jumped.select("id", "comp")
        labels = jumped.drop("old")


def linked(sets: list[np.ndarray], n: np.ndarray, block: np.ndarray, across: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects: a spanning forest of all links
    (``across``: of those between the two blocks), so at most one per set.

    Each fragment of the n-gram order has its postings; a set's partial overlaps with all
    sets are counted fragment by fragment and summed.
    """
    m = len(sets)
    sizes = np.array([len(g) for g in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    grams = np.concatenate(sets)
    fragment = (grams >> np.int64(64 - FRAGMENTS.bit_length() + 1)) + FRAGMENTS // 2
    index = []
    for f in range(FRAGMENTS):
        here = fragment == f
        g, who = grams[here], owner[here]
        order = np.argsort(g, kind="stable")
        _, first, back, count = np.unique(g[order], return_index=True, return_inverse=True, return_counts=True)
        at = np.empty(len(g), np.int64)
        at[order] = back.ravel()
        ends = np.searchsorted(who, np.arange(m + 1))
        index.append((who[order], first, count, at, ends))
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    out = []
    for i in range(m):
        if across and block[i] != block.min():
            continue
        common = np.zeros(m, np.int64)
        for who, first, count, at, ends in index:
            mine = at[ends[i] : ends[i + 1]]
            if len(mine):
                k = count[mine]
                step = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))
                common += np.bincount(who[step], minlength=m)
        hit = common * den >= (n[i] + n - common) * num
        hit[: i + 1] &= across
        if across:
            hit &= block != block.min()
        for j in np.flatnonzero(hit):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _task_links(rows: DataFrame, id_type: T.DataType, num: int, den: int) -> DataFrame:
    """Links (a, b) of rows (task, across, side, id, n, grams), task by task; where ``across``
    holds, only those between sides."""
    edge = C.struct(T.StructField("a", id_type), T.StructField("b", id_type))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side = pdf["id"].to_numpy(), pdf["side"].to_numpy()
        across = bool(pdf["across"].iloc[0])
        if across and side.min() == side.max():
            return pd.DataFrame({"a": [], "b": []})
        pairs = linked(list(pdf["grams"]), pdf["n"].to_numpy(np.int64), side, across, num, den)
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]})

    return C.staged(rows.select("task", "across", "side", "id", "n", "grams").groupBy("task", "across").applyInPandas(link, edge), "links")


def _cluster_links(member: DataFrame, id_type: T.DataType, spread: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what the threshold connects within each cluster. member:
    (id, comp, blocks, own, n, grams), own being the block of a set in its cluster."""
    zero = F.lit(0).alias("side")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(spread))).otherwise(F.xxhash64("comp", "own"))
    within = member.select(task.alias("task"), F.lit(False).alias("across"), zero, "id", "n", "grams")
    links = _task_links(within, id_type, num, den)
    large = member.where("blocks > 1")
    if large.isEmpty():
        return links

    # one set of each component of a block stands for it; blocks of these meet pairwise
    names = member.where("blocks > 1").select("id")
    part = components(links.join(names.hint("shuffle_hash"), links["a"] == names["id"], "left_semi"), names).where("id = comp").select("id")
    lead = large.join(part, "id").select("id", "comp", "n", "grams")
    many = lead.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    many = C.staged(many, "leaders")
    lead = C.keyed_join(lead, many, ["comp"], ["blocks"], "rows", many.agg(F.sum("rows")).first()[0] or 0, ["id"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lead = lead.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    lead = lead.select(F.xxhash64("comp", lo, hi).alias("task"), (lo != hi).alias("across"), F.col("own").alias("side"), "id", "n", "grams")
    links = links.unionByName(_task_links(lead, id_type, num, den))

    # what is still apart from its cluster's largest component meets all of the cluster
    of = C.staged(components(links.join(names.hint("shuffle_hash"), links["a"] == names["id"], "left_semi"), names).withColumnRenamed("comp", "part"), "parts")
    state = large.select("id", "comp", "blocks", "own").join(of, "id")
    sizes = state.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("comp").agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most")).where("most < all")
    main = C.staged(main.withColumn("stray_blocks", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")), "divided")
    if main.isEmpty():
        return links
    state = C.keyed_join(state, main, ["comp"], ["main", "stray_blocks"], "all", large.count(), ["id"]).where("main is not null")
    state = state.join(large.select("id", "n", "grams"), "id")
    stray = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("stray_blocks")).cast("int")
    one = state.where("part <> main").withColumn("i", stray).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.lit(0))
    two = state.withColumn("j", F.col("own")).withColumn("i", F.explode(F.expr("sequence(0, stray_blocks - 1)"))).withColumn("side", F.lit(1))
    both = [x.select(F.xxhash64("comp", "i", "j").alias("task"), F.lit(True).alias("across"), "side", "id", "n", "grams") for x in (one, two)]
    return links.unionByName(_task_links(both[0].unionByName(both[1]), id_type, num, den))


def similar_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of word
    n-grams; component_id is the smallest id reachable by links. Null or wordless
    texts have an empty set and no link. Rows that repeat an id are one document;
    rows with null id are classes of their own unless their set has a known id. An empty table gives
    an empty result; other columns are ignored.
    """
    src = C.id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    width = _width(src.count())
    heads = C.staged(_heads(src, size, num, den, width), "prefixes")
    total = heads.count()
    full = heads.where("n > 0")
    # senders and owners follow the input: a sender has so many sets, an owner so many hashes at most
    prefixes = heads.agg(F.coalesce(F.sum(F.length("head")), F.lit(0))).first()[0] // width
    senders = max(C.partitions(spark), -(-total // SENDER_SETS), -(-prefixes // OWNER_HASHES))
    owners = max(C.partitions(spark), -(-prefixes // OWNER_HASHES))

    # classes of equal sets; id: the smallest document of the class
    member = [F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")]
    classes = full.groupBy("s1", "s2").agg(*member)
    one = full.groupBy("s1", "s2").agg(*member, F.first("head").alias("head")).where("id is not null")
    one = one.select(F.pmod(F.xxhash64("s1", "s2"), F.lit(senders)).cast("int").alias("sender"), "id", "n", "s1", "s2", "head")

    # candidates: enough of the prefix is shared with other classes
    known = C.struct(T.StructField("id", heads.schema["doc_id"].dataType), ("s1", "bigint"), ("s2", "bigint"))

    def able(pdf: pd.DataFrame, twice: np.ndarray) -> pd.DataFrame:
        ends = np.cumsum([len(h) // width for h in pdf["head"]])
        hits = np.diff(np.concatenate(([0], np.cumsum(twice)))[ends], prepend=0)
        ok = hits >= np.array([prefix_least(int(n), num, den) for n in pdf["n"]])
        return pdf.loc[ok, ["id", "s1", "s2"]]

    cand = C.staged(mark_repeated(one, lambda pdf: _lengthen(list(pdf["head"]), width), able, known, 8 * width, owners), "candidates")

    # whole sets of the candidates, one document for each class
    pick = src.join(cand.hint("shuffle_hash"), src["doc_id"] == cand["id"]).select("doc_id", "text", "s1", "s2")
    sets = _whole_sets(pick, size).withColumn("sender", F.spark_partition_id())
    sets = C.staged(sets, "sets")

    # only n-grams of two candidates or more can overlap; a set with too many others has no link
    set_grams = _grams(sets)
    bits = min(63, set_grams.bit_length() + 12)
    cut = np.uint64(64 - bits)
    entry = C.struct(known["id"], ("n", "bigint"), ("grams", "array<bigint>"))

    def inner(pdf: pd.DataFrame, twice: np.ndarray) -> pd.DataFrame:
        ends = np.cumsum([len(g) for g in pdf["grams"]])
        own = [g[twice[e - len(g) : e]] for g, e in zip(pdf["grams"], ends, strict=True)]
        ok = np.array([len(o) * den >= n * num for o, n in zip(own, pdf["n"], strict=True)], bool)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "n": pdf["n"].to_numpy()[ok], "grams": [o for o, k in zip(own, ok, strict=True) if k]})

    core = C.staged(mark_repeated(sets, lambda pdf: (np.concatenate(list(pdf["grams"])) ^ np.int64(-(1 << 63))).view(np.uint64) >> cut, inner, entry, bits, max(C.partitions(spark), -(-set_grams // OWNER_HASHES))), "core")
    # clusters: sets that share one of their rarest n-grams, directly or through others. Among the
    # first size - ceil(t n) + 1 of a core set in order of frequency, linked pairs share one
    grams = core.select("id", "n", F.explode("grams").alias("g"))
    often = C.staged(grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "often")
    grams = C.keyed_join(grams, often, ["g"], ["df"], "df", _grams(core), ["id"])
    ordered = grams.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("own"))
    head = F.expr(f"transform(slice(own, 1, int(greatest(1, size(own) - ceil(n * {num} / {den}) + 1))), x -> x.g)")
    posts = C.staged(ordered.select("id", F.explode(head).alias("g")), "postings")
    pivots = C.staged(posts.groupBy("g").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "pivots")
    stars = C.keyed_join(posts, pivots, ["g"], ["b"], "rows", posts.count(), ["id"]).where("b < id").select(F.col("id").alias("a"), "b")
    clusters = components(stars, core.select("id"))

    sized = clusters.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    sized = C.staged(sized, "clusters")
    member = C.keyed_join(clusters, sized, ["comp"], ["blocks"], "rows", max(1, total), ["id"]).where("blocks is not null")
    member = C.staged(member.join(core, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    links = _cluster_links(member, known["id"].dataType, max(senders, -(-core.count() // BLOCK)), num, den)
    comps = C.staged(components(links, core.select("id")), "components")

    # back to the documents, by class
    named = classes.join(comps.withColumnRenamed("id", "_c"), F.col("id") == F.col("_c"), "left").select("s1", "s2", F.coalesce("comp", "id").alias("component"), "copies")
    named = C.staged(named, "named")
    out = C.keyed_join(heads, named, ["s1", "s2"], ["component"], "copies", total, ["doc_id"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def dedup_similar(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: the smallest id; all columns stay. Rows with
    a repeated or null id are documents of their own, null ids are the largest."""
    rows, key = C.keyed_rows(docs)
    return C.without(rows, key, similar_components(rows, size, num, den, key).where("component_id < doc_id").select("doc_id"), docs.columns)
