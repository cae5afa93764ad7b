"""All expressions of a grammar within a budget, as numbers; and a table that deals them out with quotas.

How many expressions have so many operators and so much window in total is counted once, by size, as sums over
what their parts may have. So every expression within the budget has a number, a number in the range has one
expression, and drawing numbers draws expressions evenly; none that is over the budget is ever made.

A schedule walks over the numbers by a stride that has no factor in common with their count: it meets each once, in an order
that looks drawn. Its table is written batch by batch, a candidate's place in the walk being its id; whoever starts again goes on
after the last whole batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ast import Node, parse
from ..sources.panel import market_panel
from . import mining


@dataclass(frozen=True)
class Grammar:
    """An expression is a leaf, a function of one, a function of one and a window, or an operator between two."""

    leaves: tuple[str, ...] = mining.LEAVES
    unary: tuple[str, ...] = mining.UNARY
    windowed: tuple[str, ...] = mining.WINDOWED
    binary: tuple[str, ...] = mining.BINARY
    windows: tuple[int, ...] = mining.FIBONACCI
    operators: int = 26  # most in an expression
    window_sum: int = 160  # most days in all of its windows

    @cached_property
    def counts(self) -> list[list[int]]:
        """counts[n][w]: expressions with n operators whose windows sum to w."""
        n_max, w_max = self.operators, self.window_sum
        out = [[len(self.leaves)] + [0] * w_max]
        sums = [len(self.leaves)]  # without regard to windows: rows of nothing are skipped
        for n in range(1, n_max + 1):
            row = [len(self.unary) * x for x in out[n - 1]]
            for k in self.windows:
                for w in range(k, w_max + 1):
                    row[w] += len(self.windowed) * out[n - 1][w - k]
            for left in range(n):
                row = [x + len(self.binary) * y for x, y in zip(row, self._product(out[left], out[n - 1 - left]), strict=True)]
            out.append(row)
            sums.append(sum(row))
        return out

    def _product(self, a: list[int], b: list[int]) -> list[int]:
        """Sums over all ways to share a window sum: digits of one product of large numbers."""
        bits = max(x.bit_length() for x in a) + max(x.bit_length() for x in b) + len(a).bit_length()
        pack = lambda row: int.from_bytes(b"".join(x.to_bytes(bits // 8 + 1, "little") for x in row), "little")
        size = bits // 8 + 1
        raw = (pack(a) * pack(b)).to_bytes(2 * size * len(a) + 8, "little")
        return [int.from_bytes(raw[size * k : size * (k + 1)], "little") for k in range(len(a))]

    @cached_property
    def total(self) -> int:
        return sum(map(sum, self.counts))

    def expression(self, number: int) -> Node:
        """The expression of a number from 0 to ``total`` - 1."""
        if not 0 <= number < self.total:
            raise ValueError(f"{number} is not below {self.total}")
        for n, row in enumerate(self.counts):
            for w, count in enumerate(row):
                if number < count:
                    return self._node(n, w, number)
                number -= count
        raise AssertionError

    def _node(self, n: int, w: int, number: int) -> Node:
        """The number-th expression with n operators and windows of w in all."""
        if n == 0:
            return parse(self.leaves[number])
        below = self.counts[n - 1]
        if number < len(self.unary) * below[w]:
            op, rest = divmod(number, below[w])
            return Node(self.unary[op], (self._node(n - 1, w, rest),))
        number -= len(self.unary) * below[w]
        for k in self.windows:
            count = below[w - k] if k <= w else 0
            if number < len(self.windowed) * count:
                op, rest = divmod(number, count)
                return Node(self.windowed[op], (self._node(n - 1, w - k, rest), Node("num", value=float(k))))
            number -= len(self.windowed) * count
        op, number = divmod(number, sum(self.counts[a][u] * self.counts[n - 1 - a][w - u] for a in range(n) for u in range(w + 1)))
        for a in range(n):
            for u in range(w + 1):
                right = self.counts[n - 1 - a][w - u]
                if number < self.counts[a][u] * right:
                    x, y = divmod(number, right)
                    return Node(self.binary[op], (self._node(a, u, x), self._node(n - 1 - a, w - u, y)))
                number -= self.counts[a][u] * right
        raise AssertionError

    def walk(self, seed: int = 0) -> Callable[[int], int]:
        """A walk over all numbers: step i gives another number for every i below ``total``."""
        stride = int(self.total * 0.6180339887498949) + 2 * seed + 1
        while math.gcd(stride, self.total) != 1:
            stride += 1
        start = (seed * 0x9E3779B97F4A7C15) % self.total
        return lambda i: (start + i * stride) % self.total


def candidates(spark: SparkSession, grammar: Grammar, first: int, last: int, seed: int = 0) -> DataFrame:
    """(id, expression, structure, fingerprint): the walk's steps from first to before last, made where they are needed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = grammar.walk(seed)
        for b in batches:
            ids = b.column(0).to_pylist()
            text = [str(grammar.expression(step(i))) for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array([mining.novelty_key(t) for t in text], pa.string()), pa.array([mining.equivalence_key(t) for t in text], pa.string())], names=["id", "expression", "structure", "fingerprint"])

    return spark.range(first, min(last, grammar.total)).mapInArrow(make, "id bigint, expression string, structure string, fingerprint string")


class Schedule:
    """A table of candidates at ``path``: accepted in order of the walk, at most ``quota`` of a structure and one of a fingerprint."""

    def __init__(self, spark: SparkSession, path: str, grammar: Grammar, quota: int = 3, batch: int = 1000, seed: int = 0):
        self.spark, self.path, self.grammar, self.quota, self.batch, self.seed = spark, path, grammar, quota, batch, seed

    def accepted(self) -> DataFrame | None:
        """(id, expression, structure, fingerprint, batch) of all whole batches, or None before the first."""
        try:
            return self.spark.read.parquet(f"{self.path}/accepted").where(F.col("batch").isin(self._whole()))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _whole(self) -> list[int]:
        """Numbers of the batches that were written to their end: a mark follows each."""
        try:
            return sorted(r["batch"] for r in self.spark.read.parquet(f"{self.path}/done").distinct().collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def advance(self) -> DataFrame:
        """Examines the next batch of the walk and returns what of it was accepted. A batch that was cut off is written anew."""
        whole = self._whole()
        k = whole[-1] + 1 if whole else 0
        new = candidates(self.spark, self.grammar, k * self.batch, (k + 1) * self.batch, self.seed)
        first = Window.partitionBy("fingerprint").orderBy("id")
        new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        old = self.accepted()
        if old is not None:
            new = new.join(old.select("fingerprint"), "fingerprint", "left_anti")
            used = old.groupBy("structure").agg(F.count(F.lit(1)).alias("_used"))
            new = new.join(used, "structure", "left")
        else:
            new = new.withColumn("_used", F.lit(0))
        place = F.row_number().over(Window.partitionBy("structure").orderBy("id")) + F.coalesce("_used", F.lit(0))
        new = new.withColumn("_place", place).where(F.col("_place") <= self.quota).select("id", "expression", "structure", "fingerprint")
        new.write.mode("overwrite").parquet(f"{self.path}/accepted/batch={k}")
        self.spark.range(1).select(F.lit(k).alias("batch")).write.mode("append").parquet(f"{self.path}/done")
        return self.spark.read.parquet(f"{self.path}/accepted/batch={k}")


#: Grammar of the registered query: few operators, so that a batch is one plan of moderate depth.
SMALL = Grammar(operators=3, window_sum=21)


def scheduled_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the first candidates of a walk, one of a structure, on the panel."""
    new = candidates(spark, SMALL, 0, 60)
    w = Window.partitionBy("structure").orderBy("id")
    chosen = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").orderBy("id").limit(8).collect()  # eight expressions make up the plan
    return mining.rounded(mining.batch_metrics(market_panel(spark, sf_dir), {f"c{r['id']:03d}": r["expression"] for r in chosen}))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"scheduled_batch": scheduled_batch}


def oracle_sql() -> dict[str, str]:
    return {}
