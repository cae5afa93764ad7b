"""News analytics: keyword sentiment with negation, and fuzzy title deduplication."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import staged
from .choice import kept_in_order


def sentiment(text: Column, weights: dict[str, float], negations: list[str], window: int = 3) -> Column:
    """struct(score, label, hits): the sum of the weights of words that occur; a word
    whose first occurrence has a negation within the ``window`` characters before it counts
    minus half. Scores are clamped to [-1, 1]; labels change at 0.2 either way."""
    words = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(float(w)).alias("w")) for word, w in weights.items()])
    there = F.filter(F.transform(words, lambda h: F.struct(h["word"].alias("word"), h["w"].alias("w"), F.instr(text, h["word"]).alias("at"))), lambda h: h["at"] > 0)

    def negated(h: Column) -> Column:
        before = F.substring(text, F.greatest(h["at"] - window, F.lit(1)), F.least(h["at"] - 1, F.lit(window)))
        return (h["at"] > 1) & F.exists(F.array(*map(F.lit, negations)), lambda n: F.contains(before, n))

    found = F.transform(there, lambda h: F.when(negated(h), F.struct(F.concat(F.lit("not:"), h["word"]).alias("word"), (h["w"] * -0.5).alias("w"))).otherwise(F.struct(h["word"].alias("word"), h["w"].alias("w"))))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(found, F.lit(0.0), lambda a, h: a + h["w"])))
    label = F.when(score >= 0.2, "positive").when(score <= -0.2, "negative").otherwise("neutral")
    return F.struct(F.round(score, 3).alias("score"), label.alias("label"), F.transform(F.slice(found, 1, 10), lambda h: h["word"]).alias("hits"))


def _length_of_common(a: str, b: str) -> int:
    """Length of the longest common subsequence: matching blocks hold no more."""
    return int(_Signs([a]).common(b, np.arange(1))[0])


#: Titles of a block are dealt into tiles of about as many, up to so many tiles; beyond, tiles grow to so many titles.
SMALL, TILES, LARGE = 2_000, 24, 40_000
#: Numbers in a table of signs.
CELLS = 1 << 24


class _Signs:
    """Titles as columns: how often each sign occurs in each, and where (a bit per place, 64 to a word)."""

    def __init__(self, titles: list[str]):
        self.n = np.array([len(t) for t in titles], np.int64)
        signs, code = np.unique(np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32), return_inverse=True)
        self.words, self.place = max(1, -(-int(self.n.max()) // 64)), {chr(c): k for k, c in enumerate(signs.tolist())}
        self.cells = len(signs) * self.words * len(titles)
        if len(titles) > 1 and self.cells > CELLS:
            return  # to be cut
        row = np.repeat(np.arange(len(titles)), self.n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.count = np.zeros((len(signs), len(titles)), np.int16 if self.n.max() < 1 << 15 else np.int64)
        np.add.at(self.count, (code, row), 1)
        self.bits = np.zeros((len(signs), self.words, len(titles)), np.uint64)
        np.bitwise_or.at(self.bits, (code, at // 64, row), np.uint64(1) << (at % 64).astype(np.uint64))

    def shared(self, title: str) -> np.ndarray:
        """How many signs each has in common with ``title``, in any order."""
        own = [(self.place[c], k) for c, k in Counter(title).items() if c in self.place]
        if not own:
            return np.zeros(len(self.n), np.int64)
        most = np.minimum(np.array([k for _, k in own]), np.iinfo(self.count.dtype).max).astype(self.count.dtype)
        return np.minimum(self.count[[k for k, _ in own]], most[:, None]).sum(axis=0, dtype=self.count.dtype)

    def common(self, title: str, rows: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of ``title`` and each title at ``rows``: a zero bit for each of its signs."""
        known = {c: k for k, c in enumerate(c for c in dict.fromkeys(title) if c in self.place)}
        bits = self.bits[[self.place[c] for c in known]][:, :, rows]
        v = np.full((self.words, len(rows)), ~np.uint64(0))
        for c in title:
            if c not in known:
                continue
            u = v & bits[known[c]]
            total = v + u
            for w in range(1, self.words):  # what the word before carries
                carry = (total[w - 1] < v[w - 1]) if w == 1 else (total[w - 1] < v[w - 1]) | (carry & (total[w - 1] == v[w - 1]))
                total[w] += carry
            v = total | (v ^ u)
        return np.bitwise_count(~v).sum(axis=0, dtype=np.int64)


def _tables(titles: np.ndarray, at: np.ndarray) -> Iterator[tuple[_Signs, np.ndarray]]:
    """Tables of the titles at ``at`` (by length), cut until each is small."""
    table = _Signs([titles[k] for k in at])
    if len(at) > 1 and (table.cells > CELLS or len(at) > 4096):
        for half in np.array_split(at, 2):
            yield from _tables(titles, half)
    else:
        yield table, at


def alike_titles(titles: DataFrame, most: float = 0.75) -> DataFrame:
    """(earlier, later): pairs of ``titles`` (id, place, block, title; titles of a block differ) with a Ratcliff-Obershelp ratio
    above ``most``, the later one by place being compared with the earlier one.

    A ratio is twice the matching signs over both lengths, and no more signs can match than both have, or have in the same order. Random
    titles have most signs in common, so no index tells them apart: titles of a block meet in pairs of tiles, and a task counts for a title
    and all of a tile at once what they have in common. Nothing is shuffled but titles, each as often as there are tiles, and only
    pairs above ``most`` are written.
    """
    placed = staged(titles.sort("place").select("id", "block", "title", F.monotonically_increasing_id().alias("number")), "placed")
    tiles = F.greatest(F.ceil(F.col("many") / LARGE), F.least(F.lit(TILES), F.ceil(F.col("many") / SMALL))).cast("int")
    blocks = staged(placed.groupBy(F.col("block").alias("_block")).agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("_block", tiles.alias("tiles")), "blocks")
    tasks = blocks.agg(F.sum(F.expr("tiles * (tiles + 1L) DIV 2"))).first()[0] or 1
    rows = placed.join(blocks, placed["block"].eqNullSafe(blocks["_block"])).withColumn("own", F.pmod(F.xxhash64("number"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("id", "block", "title", "number", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    kind = titles.schema["id"].dataType.simpleString()

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        title, number, own, ids = (pdf[c].to_numpy() for c in ("title", "number", "own", "id"))
        size = np.array([len(t) for t in title])
        left, right = (np.flatnonzero(own == side) for side in key[-2:])
        right = right[np.argsort(size[right], kind="stable")]
        earlier, later = [], []
        for table, at in _tables(title, right) if len(right) else ():
            for i in left:
                t = title[i]
                need = most * (table.n + len(t)) / 2 - 1e-6
                near = np.flatnonzero((table.shared(t) > need) & (number[at] < number[i] if key[-2] == key[-1] else True))
                if len(near):
                    near = near[table.common(t, near) > need[near]]
                for k in at[near]:
                    x, y = (k, i) if number[k] < number[i] else (i, k)
                    if difflib.SequenceMatcher(None, title[y], title[x]).ratio() > most:
                        earlier.append(ids[x])
                        later.append(ids[y])
        return pd.DataFrame({"earlier": earlier, "later": later})

    return rows.repartition(min(2 * tasks, 4000), "block", "a", "b").groupBy("block", "a", "b").applyInPandas(compare, f"earlier {kind}, later {kind}")


def fuzzy_titles(news: DataFrame, block: str | None, order: str, title: str = "title", most: float = 0.75) -> DataFrame:
    """News without titles too similar (Ratcliff-Obershelp ratio above ``most``) to one kept earlier in the same
    block (without ``block``: anywhere), in ``order``; equal places go by title. Null titles are empty. Of equal titles the first
    alone is compared: whatever becomes of it, the others are like it or like what drops it."""
    rows = staged(news.withColumn("_id", F.monotonically_increasing_id()).withColumn("_title", F.coalesce(title, F.lit(""))), "news")
    place = F.struct(F.col(order), F.col("_title"), F.col("_id"))
    titles = rows.groupBy((F.col(block) if block else F.lit(0)).alias("block"), "_title").agg(F.min(place).alias("place"))
    titles = staged(titles.select(F.col("place._id").alias("id"), "place", "block", F.col("_title").alias("title")), "titles")
    kept = kept_in_order(titles.select("id"), alike_titles(titles, most))
    return rows.join(kept, rows["_id"] == kept["id"], "left_semi").select(*news.columns)


#: A small lexicon for the test texts.
WEIGHTS = {"the": 0.1, "that": 0.1, "idiot": -0.6, "scum": -0.5, "trash": -0.4}
NEGATIONS = ["no", "un"]


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", sentiment(F.col("t"), WEIGHTS, NEGATIONS).alias("s")).select("doc_id", "s.score", "s.label", F.size("s.hits").alias("n_hits"))


def _sentiment_sql() -> str:
    parts, hits = [], []
    for w, v in WEIGHTS.items():
        at = f"instr(t, '{w}')"
        before = f"substr(t, greatest({at} - 3, 1), least({at} - 1, 3))"
        neg = f"({at} > 1 AND ({' OR '.join(f'contains({before}, {chr(39)}{n}{chr(39)})' for n in NEGATIONS)}))"
        parts.append(f"CASE WHEN {at} > 0 THEN CASE WHEN {neg} THEN {-0.5 * v!r}::DOUBLE ELSE {v!r}::DOUBLE END ELSE 0::DOUBLE END")
        hits.append(f"CASE WHEN {at} > 0 THEN 1 ELSE 0 END")
    return f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), s AS (SELECT doc_id, greatest(-1::DOUBLE, least(1::DOUBLE, {' + '.join(parts)})) AS x, {' + '.join(hits)} AS n FROM d) SELECT doc_id, round(x, 3) AS score, CASE WHEN x >= 0.2::DOUBLE THEN 'positive' WHEN x <= -0.2::DOUBLE THEN 'negative' ELSE 'neutral' END AS label, CAST(n AS INT) AS n_hits FROM s"


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title is not too like that of a page kept before."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1).alias("title"))
    return fuzzy_titles(pages, None, "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"sentiment_scores": sentiment_scores, "page_titles": page_titles}


def oracle_sql() -> dict[str, str]:
    return {"sentiment_scores": _sentiment_sql()}
