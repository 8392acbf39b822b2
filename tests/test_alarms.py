"""Alarms on a stream against the same on a table, across a restart."""

import datetime as dt
import random

import pytest

from seqwatch.operators import counts
from seqwatch.operators import surprise as S
from seqwatch.streaming import alarms

SCHEMA = "trial_id long, ts timestamp, state int"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    was = {k: spark.conf.get(k, None) for k in alarms.STORE}
    for k, v in alarms.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run(spark, source, sink, checkpoint, limits):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    q = alarms.stall_alarms(stream, limits, "10 seconds").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None


def test_alarms_equal_the_table_and_survive_a_restart(rocks, tmp_path):
    spark, draw = rocks, random.Random(3)
    limits = {0: 20_000, 1: 35_000}
    events = []
    for trial in range(4):
        at, state = draw.randint(0, 20), 0
        while at < 240:
            for _ in range(draw.randint(1, 3)):
                events.append((trial, START + dt.timedelta(seconds=at), state))
                at += draw.randint(1, 15)
            state = (state + draw.randint(1, 2)) % 3
            at += draw.choice([0, 0, 30])
    events.append((9, START + dt.timedelta(seconds=100), 1))  # a trial of one event: its alarm needs no other
    # each batch of 40 s comes shuffled, some events a batch boundary late but within the bound
    batch_of = lambda e: int((e[1] - START).total_seconds() + (8 if draw.random() < 0.3 else 0)) // 40
    batches = {}
    for e in events:
        batches.setdefault(batch_of(e), []).append(e)
    last = START + dt.timedelta(seconds=1000)
    order = sorted(batches)
    for k in order:
        draw.shuffle(batches[k])
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))

    def put(k, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{k:04d}")

    for k in order[: len(order) // 2]:
        put(k, batches[k])
    run(spark, source, sink, checkpoint, limits)
    for k in order[len(order) // 2 :]:
        put(k, batches[k])
    put(900, [(99, last, 2)])  # moves the watermark past all
    run(spark, source, sink, checkpoint, limits)
    table = spark.createDataFrame(events + [(99, last, 2)], SCHEMA)
    until = str(last - dt.timedelta(seconds=10))
    expected = sorted(map(tuple, alarms.stalls(table, limits, until).collect()))
    found = sorted(map(tuple, spark.read.schema(alarms.SCHEMA).parquet(sink).collect()))
    assert found == expected and len(found) > 4 and any(r[0] == 9 for r in found)


def test_limits_are_where_the_live_stall_is_flagged(spark):
    segments = spark.createDataFrame([(t, k, s, d) for t in range(30) for k, (s, d) in enumerate([(0, 1 + t % 3), (1, 2 + (t == 4) * 7), (2, 4)])], "trial_id long, seg_idx int, state int, duration int")
    tails = S.duration_tails(counts.duration_counts(segments, 50)).cache()
    found = alarms.stall_limits(tails, 50, 0.2)
    shares = {(r["state"], r["d"]): r["p_ge"] for r in tails.collect()}
    for state in (0, 1, 2):
        durations = sorted(d for s, d in shares if s == state)
        survival = lambda e: next(shares[state, d] for d in durations if d >= e)
        over = [e for e in range(1, max(durations) + 1) if survival(e) < 0.2]
        assert found.get(state) == (over[0] - 1 if over else None)
