"""Mixing sources to target weights by weighted fair queueing.

Each document is queued once per pass over its source, in the order of a hash. Its virtual finish
time is the number of its source's words up to its end, divided by the source's target. The mix is
all queued pieces in the order of virtual time, cut off at the total budget.

Nothing needs one task: a source is cut into buckets of the hash by its share of all rows and
virtual time into even ranges (shuffled documents lie evenly in it), each summed in its own task
after the sums of those before it are known. Sources may be as many as they like; how far the
others' excess lifts a source is found by aggregates over the table of sources.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: The weights of sources in order, repeating; the budget as a share of all words; most passes over a source.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
PASSES = 2
#: Places in the shuffle order: 15 hex digits.
PLACES = float(16**15)
#: Buckets and ranges per shuffle partition.
FINE = 4


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def place(turn: Column, doc_id: Column) -> Column:
    """Place in a source's order on a pass: from the id alone, so that reruns agree; a null id counts as an empty one."""
    name = F.concat(turn.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source_no, source, rows, source_size, target) of rows (source, size). Sources in code point order, null last, weigh
    ``weights`` in turn and share ``budget`` times all sizes; a target stops at ``passes`` times its source's size and the excess
    goes to the others by weight, until none is above."""
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = C.staged(C.ranked(sums, F.col("source").asc_nulls_last()).withColumn("weight", turn), "sources")
    most = F.col("source_size") * float(passes)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * budget
    # the level rises until no further source is above its share; each round is one aggregate
    level, full = 0.0, None
    while True:
        above = F.col("weight") * level > most
        n, fixed, free = table.agg(F.count_if(above), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or free is None:
            break
        full, level = n, (total - (fixed or 0.0)) / free
    return table.select(F.col("rank").alias("source_no"), "source", "rows", "source_size", F.least(F.col("weight") * level, most).alias("target"))


def running(items: DataFrame, group: list[str], buckets: list[str], order: list[str], value: str) -> DataFrame:
    """items with ``before``: the sum of ``value`` over the rows of their ``group`` that come earlier by ``buckets``, then ``order``.
    A bucket is one task's; those of a group are summed first."""
    keys = [*group, *buckets]
    sums = items.groupBy(*keys).agg(F.sum(value).alias("_held"))
    whole = Window.partitionBy(*group).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, 0)
    first = sums.select(*keys, (F.sum("_held").over(whole) - F.col("_held")).alias("_first"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = items.withColumn("_upto", F.sum(value).over(own))
    return part.join(first.hint("shuffle_hash"), keys).select(*items.columns, (F.col("_first") + F.col("_upto") - F.col(value)).alias("before"))


def _known(docs: DataFrame, weights: tuple[int, ...], budget: float, passes: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A row per input row: row, doc_id, source, size, text_hash and its source's number, rows, size and target."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = C.staged(rows.withColumn("row", F.monotonically_increasing_id()), "mix_rows")
    table = C.staged(targets(rows, weights, budget, passes), "targets")
    known = C.keyed_join(rows, table, ["source"], ["source_no", "rows", "source_size", "target"], "rows", rows.count(), ["row"])
    return C.staged(known, "mix_known")


def _queue(known: DataFrame, passes: int) -> DataFrame:
    """Pieces (row, source_no, pass, length, finish, start), ``start`` being the piece's first word in the mix."""
    n = FINE * C.partitions(known.sparkSession)
    turns = F.sequence(F.lit(0), F.least(F.lit(passes), F.greatest(F.lit(1), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))).cast("int") - 1)
    items = known.select("row", "doc_id", "text_hash", "source_no", "rows", "size", "target", F.explode(turns).alias("pass"))
    items = items.withColumn("place", place(F.col("pass"), F.col("doc_id")))
    share = F.ceil(F.col("rows") * n / F.lit(max(1, known.count())))
    items = items.withColumn("bucket", F.floor(F.col("place") / F.lit(PLACES) * share))
    queued = running(items, ["source_no"], ["pass", "bucket"], ["place", "doc_id", "text_hash", "row"], "size")
    # the document that would cross its source's target is cut there
    length = F.least(F.col("size"), F.floor("target") - F.col("before"))
    queued = queued.withColumn("length", length).where(F.col("length") > 0)
    queued = queued.withColumn("finish", (F.col("before") + F.col("length")) / F.col("target"))
    span = F.least(F.lit(n - 1), F.floor(F.col("finish") * n))
    queued = C.staged(queued.select("row", "source_no", "pass", "length", "finish", F.lit(0).alias("all"), span.alias("span")), "queued")
    # the spans' sums are as many as the partitions need, whatever the input
    mixed = running(queued, ["all"], ["span"], ["finish", "source_no", "pass", "row"], "length")
    return mixed.select("row", "source_no", "pass", "length", "finish", F.col("before").alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). Documents, one per input row: row (a number), doc_id, source, size (words), source_size, target,
    taken (words the mix takes of it). Pieces: row, source_no, pass, length (the mix takes so many words from the text's start on),
    finish (virtual time), start (its place in the mix, in words, gapless from 0).

    ``targets`` says what each source gets. It gets that to the word, rounded down: the document that would cross its source's target
    is cut there. No document is taken more than ``passes`` times. Null text has size 0 and is never taken; null is a source of its own,
    and so is every other string; rows that repeat an id are documents of their own (equal ids follow one another, in an order that
    their texts set); an empty table gives empty results. Other columns are ignored.
    """
    known = _known(docs, weights, budget, passes, id_col, text_col, source_col)
    pieces = _queue(known, passes)
    total = known.groupBy("source_no").agg(F.first("target").alias("target")).agg(F.sum(F.floor("target"))).first()[0] or 0
    # the truncation at the total budget
    pieces = pieces.where(F.col("start") < total).withColumn("length", F.least(F.col("length"), F.lit(total) - F.col("start")))
    pieces = C.staged(pieces, "mix")
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    out = known.join(taken.hint("shuffle_hash"), "row", "left")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), pieces


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: (start, finish, pass, doc_id, source, text), a row per piece, ``text`` being the whole text or, for a cut piece, its
    first words with the white space between them. Sort by ``start`` to read it in order. Documents must have ids that differ
    (``ValueError`` otherwise): texts meet their pieces by id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        raise ValueError("ids must be present and differ")
    found, pieces = mix(docs, weights, budget, passes, id_col, text_col, source_col)
    named = pieces.join(found.select("row", "doc_id", "source", "size"), "row")

    @F.pandas_udf("string")
    def begin(texts, lengths):
        def cut(t, n):
            return t if t is None else t[: next(islice(re.finditer(r"[^\x20\x09-\x0D]+", t), n - 1, None)).end()]

        return texts.__class__([cut(t, int(n)) for t, n in zip(texts, lengths, strict=True)], dtype=object)

    C.tune(docs.sparkSession)
    met = named.join(rows.hint("shuffle_hash"), "doc_id")
    partly = F.col("length") < F.col("size")
    return met.select("start", "finish", "pass", "doc_id", "source", F.coalesce(begin(F.when(partly, F.col("text")), "length"), "text").alias("text"))
