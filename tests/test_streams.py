"""Stateful streams by event time: silent series end, gaps close, and nothing is left behind."""

import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import dynamics as dyn
from seriesloom.operators import keyframes as keys
from seriesloom.plans.series import dense_series
from seriesloom.streaming import frames, ingest, stateful

START = datetime(2024, 1, 1)
ROWS = "m string, n long, ts timestamp, z double, closing boolean"


def row(m, n, hour, closing=False):
    return (m, n, START + timedelta(hours=hour), None if closing else float(n % 5) - 1.0, closing)


def run(spark, tmp_path, batches, build, schema=ROWS, name="run"):
    """Feed each list of rows as one micro-batch, in one drained stream that resumes from its checkpoint."""
    ingest.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # of a new checkpoint
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-{name}")
    out = stateful.run_available(build(stream.withWatermark("ts", "1 hour")), f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return out


def left(spark, tmp_path, variable, name="run"):
    state = spark.read.format("statestore").option("stateVarName", variable)
    if variable == "waiting":
        state = state.option("flattenCollectionTypes", "true")
    return state.load(f"{tmp_path}/{name}/progress").count()


def cusum(**times):
    return lambda rows: stateful.cusum_stream(rows, ["m"], 3.0, 0.5, event_time="ts", **times)


def walked(numbers):
    s = w = 0.0
    out = []
    for n in numbers:
        z = float(n % 5) - 1.0
        s, w = max(0.0, s + z - 0.5), max(0.0, w + z)
        out.append((n, s, w, s >= 3.0))
    return out


def of(out, m):
    return sorted((r["n"], r["s"], r["w"], r["alarm"]) for r in out.collect() if r["m"] == m)


def test_rows_settle_in_order_and_a_closed_series_leaves_nothing(spark, tmp_path):
    batches = [
        [row("a", n, n) for n in (2, 0, 3)],
        [row("a", 1, 3.2), row("a", 5, 5), row("b", 0, 5)],
        [row("a", 4, 4.5), row("a", 6, 6, closing=True)],
        [row("a", 3, 5.5), row("a", 7, 5.9)],  # a replay before its time is over
        [row("c", 0, 60)],
        [row("a", 0, 61, closing=True), row("b", 1, 61, closing=True), row("c", 1, 61, closing=True)],
        [row("d", 0, 90, closing=True)],
        [row("d", 0, 120, closing=True)],
    ]
    out = run(spark, tmp_path, batches, cusum())
    assert of(out, "a") == walked(range(6)) and of(out, "b") == walked([0]) and of(out, "c") == walked([0])
    assert [left(spark, tmp_path, v) for v in ("carry", "waiting")] == [0, 0] and left(spark, tmp_path, "place") <= 1  # the last mark


def test_what_can_no_longer_come_is_not_awaited(spark, tmp_path):
    batches = [
        [row("a", n, n) for n in (0, 1, 3, 4, 7)],  # 2 is missing, and 5 and 6
        [row("b", 0, 7.1)],  # the watermark has passed 3 and 4, not 7
        [row("a", 2, 1.0)],  # too late
        [row("b", 1, 7.2)],
    ]
    out = run(spark, tmp_path, batches, cusum())
    assert of(out, "a") == walked([0, 1, 3, 4]) and left(spark, tmp_path, "waiting") == 1
    out = run(spark, tmp_path, [[row("b", 2, 12)], [row("b", 3, 12)], [row("a", 8, 12)], [row("b", 4, 13)]], cusum())
    assert of(out, "a") == walked([0, 1, 3, 4, 7, 8]) and left(spark, tmp_path, "waiting") == 0


def test_a_silent_series_ends_by_itself(spark, tmp_path):
    pdf = pd.DataFrame({"m": "a", "n": range(12), "a": [0.0, 3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], "i": [2.0, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5]})
    series = dense_series(spark.createDataFrame(pdf), ["m"])
    want = keys.tick_rows(keys.energy_ticks(dyn.climb(dyn.force(series)), F.lit(1.5))).select("n", "step_rows").collect()
    fact = dyn.calibration(series).first()
    schema = "m string, n long, ts timestamp, a double, i double, s_a double, s_i double, eps double, closing boolean"

    def tick(m, n, hour, closing=False):
        a, i = pdf["a"][n % 12], pdf["i"][n % 12]
        return (m, n, START + timedelta(hours=hour), float(a), float(i), fact["s_a"], fact["s_i"], 1.5, closing)

    build = lambda rows: stateful.tick_stream(rows, ["m"], event_time="ts", patience="6 hours")
    batches = [[tick("a", n, n / 12) for n in (0, 1, 2, 5, 4)], [tick("a", n, n / 12) for n in (3, 6, 7, 8, 9, 11, 10)], [tick("b", 0, 2)]]
    out = run(spark, tmp_path, batches, build, schema)
    assert (12 - 1) not in [r["n"] for r in out.where("m = 'a'").collect()]  # the last row isn't known to be the last yet
    out = run(spark, tmp_path, [[tick("b", 1, 30)], [tick("b", 2, 31)]], build, schema)
    assert sorted((r["n"], r["step_rows"]) for r in out.where("m = 'a'").collect()) == sorted(map(tuple, want))
    run(spark, tmp_path, [[tick("c", 0, 80, closing=True)], [tick("c", 0, 120, closing=True)], [tick("c", 0, 121, closing=True)]], build, schema)
    assert [left(spark, tmp_path, v) for v in ("carry", "waiting")] == [0, 0]


def test_without_times_marks_stay_or_expire(spark, tmp_path):
    batches = [[row("a", n, 0) for n in (0, 2)], [row("a", 3, 0, closing=True)], [row("a", 0, 0), row("a", 1, 0)]]
    plain = lambda rows: stateful.cusum_stream(rows.drop("ts"), ["m"], 3.0, 0.5)
    assert of(run(spark, tmp_path, batches, plain), "a") == walked([0, 2]) and left(spark, tmp_path, "place") == 1
    # By processing time a stream is never drained, so this one is stopped.
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-run")
    kept = stateful.cusum_stream(stream.drop("ts"), ["m"], 3.0, 0.5, ttl="1 hour")
    query = kept.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/kept").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not ((query.lastProgress or {}).get("batchId", -1) >= 3):
            time.sleep(0.3)
    finally:
        query.stop()
    assert of(spark.table("kept"), "a") == walked([0, 2])
    with pytest.raises(ValueError):
        stateful.cusum_stream(spark.createDataFrame([], ROWS), ["m"], 3.0, patience="1 hour")


def test_streams_that_end_give_all_frames_and_sessions(spark, tmp_path):
    hours = [0.5, 1.5, 7.0, 30.0, 31.0, 31.5]
    rows = [(START + timedelta(hours=h), k % 2, "view", float(k)) for k, h in enumerate(hours)]
    schema = "ts timestamp, user_id int, event_type string, value double"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = spark.createDataFrame([(START + timedelta(hours=60),)], "ts timestamp")
    end.coalesce(1).write.parquet(f"{tmp_path}/ends")
    events = lambda: frames.with_end(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), spark.readStream.schema(end.schema).parquet(f"{tmp_path}/ends")
    )
    batch = spark.createDataFrame(rows, schema)
    for name, build in (("frames", lambda e: frames.sliding_frames(e, "6 hours", "3 hours", "3 days")), ("sessions", lambda e: frames.sessions(e, "4 hours", "3 days"))):
        got = stateful.run_available(build(events()), f"{tmp_path}/{name}")
        assert got.count() == 0  # with three days of lateness the end is not past them yet
    spark.createDataFrame([(START + timedelta(hours=200),)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ends")
    for name, build in (("frames", lambda e: frames.sliding_frames(e, "6 hours", "3 hours", "3 days")), ("sessions", lambda e: frames.sessions(e, "4 hours", "3 days"))):
        got = stateful.run_available(build(events()), f"{tmp_path}/{name}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(batch).collect()))


class _Counted:
    """A state that is empty and counts how often it is asked or changed."""

    def __init__(self, calls):
        self.calls = calls

    def __getattr__(self, name):
        return lambda *args: self.calls.append(name)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_a_series_within_one_batch_asks_the_state_once(order):
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from seriesloom.streaming import stateful

    rows = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("z", T.DoubleType()), T.StructField("closing", T.BooleanType())])
    walk = stateful.SeriesWalk(["k"], rows, stateful.WALK, stateful.WALK_CARRY, stateful.cusum_walk(1.0, 0.0), None, 0, None, None, None)
    calls = []
    walk.place = walk.state = walk.waiting = _Counted(calls)
    pdf = pd.DataFrame({"k": 7, "n": [0, 1, 2, 3], "z": [0.5, 0.5, -2.0, np.nan], "closing": [False, False, False, True]}).iloc[order].reset_index(drop=True)
    (out,) = walk.handleInputRows((7,), iter([pdf]), None)
    assert out.to_dict("list") == {"k": [7] * 3, "n": [0, 1, 2], "s": [0.5, 1.0, 0.0], "w": [0.5, 1.0, 0.0], "alarm": [False, True, False]}
    assert calls == ["exists", "update"]
