"""Walks over dates: state that one date hands to the next, in bounded memory.

What depends on cash, or on orders that wait for the next bar, is no window function. Its
rows are partitioned by run, sorted by date, and stream through the run's task in
Arrow batches; only the rows of one date and the run's own state are held at a time.
Runs (factors, parameter sets, folds, strategies) are walked in parallel, each in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.work import staged

class Walker(Protocol):
    """One run over columns: what a date does, and all that the next leg has to know."""

    def day(self, day: object, rows: pa.Table) -> list[dict]:
        """Columns of the result without the keys and the date (a name that is left out is null), for the date's rows in order."""

    def state(self) -> bytes: ...


def legs_of(sizes: list[tuple[object, int]], most: int) -> list[tuple[object, object]]:
    """First and last dates of legs of at most so many rows, a date at least; ``sizes``: dates in order and their rows."""
    out: list[list] = []
    for day, n in sizes:
        if out and out[-1][2] + n <= most:
            out[-1][1:] = [day, out[-1][2] + n]
        else:
            out.append([day, day, n])
    return [(a, b) for a, b, _ in out]


def walk_dates(rows: DataFrame, keys: list[str], time: str, order: list[str], start: Callable[[tuple, bytes | None], Walker], schema: str, legs: list[tuple[object, object]], deal: tuple[int, Column]) -> DataFrame:
    """``start`` makes the walker of a run from its key and its state, if it has been under way; it is called once per date in order, with that date's rows sorted
    by ``order`` as columns, and returns columns. ``schema`` is that of the result: the keys first, then what walkers return. More than one of ``legs`` (first and last
    date) are walked one after the other, each by a job that reads its own rows alone, so a task sorts one leg of one run; between
    them goes the walker's state, as a row in the work folder. ``deal``: how many runs there are, and a run's number among them, so that each has a task."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = f"{schema}, state binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walker, day, held = None, None, None, []
        kinds = pa.schema([(n, t) for n, t in zip([*names, "state"], types, strict=True)])

        def column(values, fixed: dict, f: pa.Field, n: int) -> pa.Array:
            if f.name in fixed:
                return pa.repeat(pa.scalar(fixed[f.name], f.type), n)
            if values is None:
                return pa.nulls(n, f.type)
            return values.cast(f.type) if isinstance(values, pa.Array) else pa.array(values, f.type)

        def rows_of(parts: list[dict], at: tuple, date) -> Iterator[pa.RecordBatch]:
            for part in parts:
                n = len(next(iter(part.values())))
                if not n:
                    continue
                fixed = dict(zip(keys, at, strict=True)) | {time: date}
                yield pa.RecordBatch.from_arrays([column(part.get(f.name), fixed, f, n) for f in kinds], schema=kinds)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from rows_of(walker.day(day, pa.Table.from_batches(held).combine_chunks()), key, day)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in (*keys, time):
                v = batch.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                here, date = tuple(part.column(k)[0].as_py() for k in keys), part.column(time)[0].as_py()
                if (here, date) != (key, day):
                    yield from flush()
                if here != key:
                    if walker:
                        yield from rows_of([{"state": [walker.state()]}], key, None)
                    key, walker = here, start(here, part.column("state")[0].as_py())
                day = date
                if date is not None:
                    held.append(part)
        yield from flush()
        if walker:
            yield from rows_of([{"state": [walker.state()]}], key, None)

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(whole)]

    def walk(part: DataFrame) -> DataFrame:
        return part.repartitionById(*deal).sortWithinPartitions(*keys, F.asc_nulls_first(time), *order).mapInArrow(run, whole)

    first = F.lit(None).cast("binary").alias("state")
    if len(legs) < 2:
        return walk(rows.select("*", first)).where(F.col(time).isNotNull()).drop("state")
    number = F.coalesce(*[F.when(F.col(time) <= F.lit(b), i) for i, (_, b) in enumerate(legs)])
    parts = staged(rows.select("*", first, number.alias("leg")), "walk", ["leg"])
    out, state = [], None
    for i in range(len(legs)):
        part = parts.where(F.col("leg") == i).drop("leg")
        done = staged(walk(part if state is None else part.unionByName(state, allowMissingColumns=True)), "leg")
        out.append(done.where(F.col(time).isNotNull()).drop("state"))
        state = done.where(F.col(time).isNull()).select(*keys, time, "state")
    return reduce(DataFrame.unionByName, out)
