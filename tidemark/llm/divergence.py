"""How far each source's vocabulary is from its language's and from each other source's.

Counts of terms per (language, source) are gathered in one pass; a partition adds up its documents
before anything is shuffled. The distance of two sources is a sum over all kept terms, most of which
one or both of them lack. It is put together by inclusion and exclusion over the supports:

* terms both lack: a constant, times their number;
* a source's own terms, priced as if the other had none: from the histogram of its counts, by binary search;
* what that says wrongly of the terms both have: corrected where posting lists meet, in blocks of terms and tiles of sources.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Terms: runs of letters a-z (A-Z lowered) and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A share's unit, and the count added to each.
UNIT = 1_000_000_000
ADDED = 5
#: Counts that a task holds before it sends them on.
HELD = 300_000
#: Sources in a tile: what two tiles' terms add up to is a square of this side.
TILE = 512
#: Terms of a block that are laid out as a table at once.
LAID = 2048
#: Postings in a block at most, on average.
BLOCK = 500_000


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents. A row with the empty term stands for each occurring (lang, source)."""
    empty = F.lit("")
    src = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"), F.coalesce(F.col(text_col), empty).cast("binary").alias("text"))
    schema = C.struct(("lang", "string"), ("source", "string"), ("term", "binary"), ("n", "bigint"), ("docs", "bigint"))
    arrow = C.arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [b"", *n]
                dictionary = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(terms), np.int8)), pa.array([x])).cast(pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*dictionary, pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], schema=arrow)
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, own = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.lower())
                size -= len(n)
                n.update(terms)
                own.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from send()
                    size = 0
        yield from send()

    parts = C.map_batches(src, count, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)), in decimals, as UNIT times a count may not fit 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)"), (total + F.lit(ADDED) * kept).cast("decimal(20,0)"))


def _overlaps(postings: DataFrame, groups: DataFrame, side: int) -> DataFrame:
    """(lang, a, b, value), a < b: what the one-sided prices say wrongly of the terms that both have, in parts to be summed."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, one, two = pdf["lang"].iloc[0], int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
        term = pd.factorize(pdf["term"])[0]
        order = np.argsort(term, kind="stable")
        term, no, p, z = (x[order] for x in (term, pdf["no"].to_numpy(), pdf["p"].to_numpy(), pdf["z"].to_numpy()))
        zero = np.zeros(2 * side, np.int64)  # z by place in the two tiles
        at = np.where(no // side == one, no - one * side, side + no - two * side)
        zero[at] = z
        right = 0 if one == two else side
        sums = np.zeros((side, side), np.int64)
        for begin in range(0, int(term[-1]) + 1, LAID):
            some = slice(*np.searchsorted(term, (begin, begin + LAID)))
            t, s, q = term[some] - begin, at[some], p[some]
            own = (s >= right) & (s < right + side)
            wide = int((s[own] - right).max(initial=-1)) + 1
            table, there = np.zeros((LAID, wide), np.int64), np.zeros((LAID, wide), bool)
            table[t[own], s[own] - right], there[t[own], s[own] - right] = q[own], True
            z_b = zero[None, right : right + wide]
            for a in np.unique(s[s < side]).tolist():
                mine = np.flatnonzero(s == a)
                p_a, p_b = q[mine][:, None], table[t[mine]]
                wrong = np.abs(p_a - p_b) - np.abs(p_a - z_b) - np.abs(p_b - zero[a]) + np.abs(zero[a] - z_b)
                sums[a, :wide] += np.where(there[t[mine]], wrong, 0).sum(0)
        x, y = np.nonzero(np.triu(sums, 1) if one == two else sums)
        return pd.DataFrame({"lang": lang, "a": x + one * side, "b": y + two * side, "value": sums[x, y]})

    spark = postings.sparkSession
    sizes = groups.groupBy("lang").agg(F.sum("terms").alias("_rows"), F.max("no").alias("_last")).withColumnRenamed("lang", "_lang")
    total = groups.agg(F.sum("terms")).first()[0] or 0
    fine = 4 * C.partitions(spark)
    rows = postings.join(sizes, postings["lang"] == sizes["_lang"])
    blocks = F.greatest(F.ceil(F.col("_rows") * fine / F.lit(max(1, total))), F.ceil(F.col("_rows") / BLOCK))
    own = F.floor(F.col("no") / side).cast("int")
    tiles = F.sequence(F.lit(0), F.floor(F.col("_last") / side).cast("int"))
    rows = rows.select("lang", "term", "no", "p", "z", F.pmod(F.xxhash64("term"), blocks).alias("block"), own.alias("own"), F.explode(tiles).alias("tile"))
    rows = rows.select("lang", "term", "no", "p", "z", "block", F.least("own", "tile").alias("one"), F.greatest("own", "tile").alias("two"))
    return rows.groupBy("lang", "block", "one", "two").applyInPandas(meet, "lang string, a long, b long, value long")


def _one_sided(postings: DataFrame, groups: DataFrame, side: int) -> DataFrame:
    """(lang, a, b, value), a < b: each source's terms as if the other had none, and the terms that neither has, in parts."""
    counts = postings.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("n"))
    bars = counts.groupBy("lang", "no").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("bars"))
    # distinct counts of a source are as many as the root of twice its words at most
    left = groups.join(bars, ["lang", "no"], "left").select("lang", "no", "z", "terms", "kept", "last", "bars.p", "bars.n")
    tile, tiles = F.floor(F.col("no") / side).cast("int"), F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / side).cast("int")))
    left = left.select("*", tile.alias("one"), tiles.alias("two"))
    right = groups.select(F.col("lang").alias("to_lang"), F.col("no").alias("to"), F.col("z").alias("to_z"), F.col("terms").alias("to_terms"), tile.alias("to_two"), tiles.alias("to_one"))

    def price(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        z, no, terms = (others[k].to_numpy() for k in ("to_z", "to", "to_terms"))
        out = []
        for row in mine.itertuples(index=False):
            p, n = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (row.p, row.n))
            many, sums = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * p)))
            below = np.searchsorted(p, z)  # bars under z
            value = z * many[below] - sums[below] + (sums[-1] - sums[below]) - z * (many[-1] - many[below])
            first = row.no < no
            neither = (row.kept - row.terms - terms) * np.abs(row.z - z)
            part = pd.DataFrame({"a": np.minimum(row.no, no), "b": np.maximum(row.no, no), "value": value + np.where(first, neither, 0)})
            out.append(part[no != row.no])
        done = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []}, dtype="int64")
        done.insert(0, "lang", mine["lang"].iloc[0] if len(mine) else "")
        return done

    return left.groupBy("lang", "one", "two").cogroup(right.groupBy("to_lang", "to_one", "to_two")).applyInPandas(price, "lang string, a long, b long, value long")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, tile: int = TILE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    A language keeps the terms that ``min_docs`` of its documents have. A share is 1 + floor(UNIT * (n + 5) / (N + 5V)) of a
    term's n among all N occurrences of the V kept terms. Part ``pair``: each other source of the language, with the sum over kept
    terms of the differences of shares (0 without kept terms). Part ``term``: the ``top`` terms of a source that stand out most
    from the language's own shares. Ranks are by value, then by item. ``tile`` bounds the sources that meet in a task.

    Null text, lang and source are ''. Rows are documents, repeated ones too. A group without terms takes part in pairs; a
    language with one source has none. An empty table gives an empty result. Other columns are ignored.
    """
    counts = C.staged(count_terms(docs, text_col, lang_col, source_col), "term_counts")
    kept = counts.where(F.col("term") != "").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = C.staged(kept, "kept_terms")
    found = C.staged(counts.drop("docs").join(kept, ["lang", "term"]), "postings")

    groups = C.ranked(counts.where(F.col("term") == "").select("lang", "source"), F.col("lang"), F.col("source"))
    ends = groups.groupBy("lang").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    wide = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = groups.join(ends, "lang").join(sums, ["lang", "source"], "left").join(wide, "lang", "left").fillna(0, ["total", "terms", "kept", "lang_total"])
    zero = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long"))
    groups = groups.select("lang", "source", (F.col("rank") - F.col("least")).alias("no"), (F.col("most") - F.col("least")).alias("last"), "total", "terms", "kept", "lang_total", zero.alias("z"))
    groups = C.staged(groups, "groups")

    rows = found.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "no", "term", "z", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = rows.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    pairs = _overlaps(rows, groups, tile).unionByName(_one_sided(rows, groups, tile)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("to")), F.struct(F.col("b").alias("no"), F.col("a").alias("to")))).alias("way"))
    ways = ways.select("lang", F.col("way.no").alias("no"), F.col("way.to").alias("to"), "value")
    names = groups.select("lang", "no", "source")
    others = groups.select("lang", F.col("no").alias("to"), F.col("source").alias("item"))
    pairs = ways.join(names, ["lang", "no"]).join(others, ["lang", "to"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
