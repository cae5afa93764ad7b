"""Line deduplication with DataFrame functions only.

Lines become 128-bit hashes with document and position. Hashes are
range-partitioned and sorted by document and position within each range; a
window streams over each hash, finds the first occurrence (the largest document)
and marks the others. What comes back per document is a bitmap of dropped
positions in 64-bit words, no text. Lines so common that one range would be
overfull are settled by a broadcast of a bounded number of hashes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def _key(line: Column) -> Column:
    return C.lower_ascii(F.btrim(line, F.lit(C.WHITE)))


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, n_dropped, dropped): the bitmap of lines to drop, as
    array<struct<word, bits>> without empty words, for documents that lose any.

    Keys are lines stripped of ASCII white space with A-Z lowered. Rows with equal
    id are one document; a null id is smaller than any other. The largest id that
    holds a key keeps all its lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the hash comes before the lines: beside them it would be computed for each line anew
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", _key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = C.staged(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "text_hash", "pos"), "lines")

    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"))
    limit = C.hot_limit(lines.count())
    hot = C.staged(counts.where(F.col("rows") > limit).select("h1", "h2"), "hot_lines")  # few, see hot_limit

    # common lines: documents are counted after a map-side distinct, and the verdict is broadcast
    common = lines.join(F.broadcast(hot), ["h1", "h2"])
    verdict = common.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
    verdict = verdict.where(F.col("docs") >= min_docs).select("h1", "h2", "last")
    lost_common = common.join(F.broadcast(verdict), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "text_hash", "pos")

    # the rest: ranges of hashes, secondary sort by document and position
    rest = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange(C.partitions(docs.sparkSession), "h1", "h2")
    order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    new = (F.row_number().over(order) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order))
    rest = rest.withColumn("new", new.cast("int"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = rest.select("doc_id", "text_hash", "pos", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"), F.sum("new").over(whole).alias("docs"))
    lost = rest.where((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("doc_id", "text_hash", "pos").unionByName(lost_common)

    words = lost.distinct().groupBy("doc_id", "text_hash", (F.col("pos") / 64).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    n = F.aggregate("dropped", F.lit(0), lambda a, w: a + F.bit_count(w["bits"]))
    out = words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    return out.select("doc_id", "text_hash", n.cast("long").alias("n_dropped"), "dropped")


def _free(name: str, taken: list[str]) -> str:
    """The name, or with as many underscores in front as make it differ from all columns."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their text replaced by the lines that stay, joined by newlines, and
    columns n_lines (before) and n_dropped (with underscores in front where docs has such
    a column). Null text is empty; all columns of docs stay, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("line", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    rows = rows.withColumn("hash", F.xxhash64("line"))
    # words from the first to the last that has a bit: a line's word is found by position
    gap = "element_at(dropped, i).word - if(i = 1, -1, element_at(dropped, greatest(i - 1, 1)).word) - 1"
    bits = F.expr(f"flatten(transform(sequence(1, size(dropped)), i -> concat(array_repeat(0L, {gap}), array(element_at(dropped, i).bits))))")
    marks = bitmaps.select("doc_id", "text_hash", "n_dropped", bits.alias("bits"))
    out = rows.join(marks.hint("shuffle_hash"), F.col("row").getField(id_col).eqNullSafe(marks["doc_id"]) & (rows["hash"] == marks["text_hash"]), "left")
    out = out.withColumn("lines", F.split("line", "\n", -1))
    stay = F.expr("filter(lines, (x, i) -> shiftright(coalesce(get(bits, int(i / 64)), 0L), i % 64) & 1 = 0)")
    kept = F.when(F.col("bits").isNull(), F.col("line")).otherwise(F.array_join(stay, "\n"))
    counts = [F.size("lines").cast("long").alias(_free("n_lines", docs.columns)), F.coalesce("n_dropped", F.lit(0)).cast("long").alias(_free("n_dropped", docs.columns))]
    return out.select(*[kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns], *counts)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that are common among them, with n_lines and n_dropped; see
    ``drop_bitmaps`` for which lines go and ``apply_bitmaps`` for the columns.

    Null and empty texts are one empty line and stay. Rows that repeat an id are one document when
    documents are counted, and each keeps its own text; a null id is a document that is smaller
    than any other. An empty table gives an empty result.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
