"""State with an end: elapsed times over several batches, and freezes released once, across a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quern.operators import events
from quern.streaming import timers

START = dt.datetime(2026, 1, 1)


def drain(spark, stream, base, out):
    with timers.rocksdb(spark):
        q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("append").format("parquet").start(out)
        q.awaitTermination()
    assert q.exception() is None


def test_elapsed_in_batches_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(5)}", START + dt.timedelta(seconds=20 * i + rng.randrange(10)), rng.choice(["click", "purchase", "view"])) for i in range(300)]
    shape = "event_id long, session_id string, ts timestamp, event_type string"
    kinds = {"click": "since_user", "purchase": "since_assistant"}
    for k, cut in enumerate((rows[:100], rows[100:180], rows[180:])):  # a restart after each
        rng.shuffle(cut)
        spark.createDataFrame(cut, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        drain(spark, timers.elapsed(stream, kinds), tmp_path, f"{tmp_path}/out")
    got = {(r.session_id, r.event_id): (r.since_user, r.since_assistant) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = events.elapsed(spark.createDataFrame(rows, shape), kinds).collect()
    assert len(got) == 300 and got == {(r.session_id, r.event_id): (r.since_user, r.since_assistant) for r in want}


def test_freezes_are_released_once_when_they_are_due(spark, tmp_path):
    shape = "session_id string, ts timestamp, ready_at timestamp"
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    steps = [
        [("a", at(0), at(60)), ("b", at(5), at(300)), ("x", at(6), at(6 + 5 * 1440))],
        [("b", at(30), at(90)), ("c", at(50), at(110))],  # b's later freeze stands for its earlier one; nothing is due
        [("d", at(80), at(4000))],  # the watermark passes a
        [("a", at(0), at(60)), ("d", at(130), at(190))],  # a is read again; b and c are due
        [("z", at(10 * 1440), at(11 * 1440))],  # d is due but too old, as x is
    ]
    for step in steps:
        spark.createDataFrame(step, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        drain(spark, timers.released(stream), tmp_path, f"{tmp_path}/out")
    got = sorted((r.session_id, r.ts, r.ready_at) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", at(0), at(60)), ("b", at(30), at(90)), ("c", at(50), at(110))]
