"""Positions of a stream equal those of the table, whatever the batches, lateness, repetition and restarts."""

import datetime as dt
import random

import pytest

from tidemark.streaming import positions as P

SCHEMA = "code string, time timestamp, event_id bigint, side string, shares bigint, price double"
T0 = dt.datetime(2024, 1, 1, 9)


def walk(events, jump=P.JUMP):
    out, state = [], {}
    for code, t, e, side, n, price in sorted(set(events), key=lambda r: (r[0], r[1], r[2])):
        held, sellable, day, since, last = state.get(code, (0, 0, None, None, None))
        if t.date() != day:
            sellable, day = held, t.date()
        k = n if side == "buy" else min(n, sellable)
        held, sellable = (held + k, sellable) if side == "buy" else (held - k, sellable - k)
        since = 0 if price is not None and last is not None and price >= jump * last else None if since is None else since + 1
        state[code] = (held, sellable, day, since, last if price is None else price)
        out.append((code, t, e, side, n, k, held, sellable, since))
    return out


def some_events(rng, n, spread_hours=200):
    return [(rng.choice("ab"), T0 + dt.timedelta(hours=rng.random() * spread_hours), i, rng.choice(["buy", "sell"]), rng.randint(1, 50), rng.choice([None, 10.0, 11.0, 13.0, 20.0])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_table_against_the_walk(spark, seed):
    events = some_events(random.Random(seed), 150)
    df = spark.createDataFrame(events + events[:20], SCHEMA).repartition(3)
    assert sorted(map(str, P.settled(df).collect())) == sorted(map(str, spark.createDataFrame(walk(events), P.RESULT).collect()))
    assert P.settled(df.limit(0)).count() == 0


def test_stream_with_restart(spark, tmp_path):
    rng = random.Random(8)
    was = {k: spark.conf.get(k) for k in P.STORE}
    for k, v in P.STORE.items():
        spark.conf.set(k, v)
    events = sorted(some_events(rng, 60, 120), key=lambda r: r[1])
    thirds = [events[:20], events[20:40], events[40:]]
    # within six hours, the last of a batch may come with the next one, and any may come twice
    thirds[1].append(thirds[0].pop())
    thirds[1].append(thirds[1][0])
    thirds[2] += [thirds[2][0], thirds[2][-1]]
    dropped = ("a", events[2][1] + dt.timedelta(microseconds=1), 999, "buy", 1000, 10.0)  # long after the watermark
    thirds[2].append(dropped)
    flush = ("z", T0 + dt.timedelta(days=365), 1000, "buy", 1, None)
    src, out, checkpoint = (f"{tmp_path}/{x}" for x in ("src", "out", "checkpoint"))

    def step(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        query = P.positions(stream, late="6 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()  # each batch is a restart from the checkpoint

    for rows in [*thirds, [flush], [("z", T0 + dt.timedelta(days=366), 1001, "buy", 1, None)]]:
        step(rows)
    for k, v in was.items():
        spark.conf.set(k, v)
    got = sorted(map(str, spark.read.parquet(out).where("code <> 'z'").collect()))
    assert got == sorted(map(str, spark.createDataFrame(walk(events), P.RESULT).collect()))
