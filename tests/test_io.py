"""Files, stores and streams."""

import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import dynamics as dyn
from seriesloom.operators import health, ledger
from seriesloom.operators import keyframes as keys
from seriesloom.plans.series import dense_series
from seriesloom.sources import recordings, stores
from seriesloom.streaming import frames, ingest, stateful


def write_wav(path, data, sr=8000, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(data.shape[1])
        f.setsampwidth(width)
        f.setframerate(sr)
        f.writeframes(b"".join(struct.pack("<i", int(v))[:width] for v in data.ravel()))


def test_recordings_of_every_width(spark, tmp_path):
    rng = np.random.default_rng(0)
    for width in (2, 3, 4):
        top = 1 << (8 * width - 1)
        write_wav(tmp_path / f"w{width}.wav", rng.integers(-top, top, (70_000, 2)), width=width)
    facts = {r["series_id"]: r for r in recordings.read_recording_facts(spark, str(tmp_path)).collect()}
    assert facts["w3"]["sample_bits"] == 24 and facts["w3"]["channels"] == 2 and facts["w3"]["frames"] == 70_000
    native = recordings.long_samples(recordings.read_recordings(spark, str(tmp_path), mono=False, native=True))
    mono = recordings.long_samples(recordings.read_recordings(spark, str(tmp_path)))
    assert native.count() == 3 * 140_000 and mono.count() == 3 * 70_000
    both = native.groupBy("series_id", "n").agg(F.avg("x").alias("m")).join(mono, ["series_id", "n"])
    scale = F.pow(F.lit(2.0), F.substring("series_id", 2, 1).cast("int") * 8 - 1)
    assert both.filter(F.abs(F.col("m") / scale - F.col("x")) > 1e-12).count() == 0
    assert mono.agg(F.max(F.abs("x"))).first()[0] <= 1.0


def test_text_snapshots_skip_bad_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "s1.txt").write_text("0.1\t-0.2 0.3\n1.5 2.5\t3.5\nbad line here\n-1 -2 -3\n")
    (tmp_path / "b" / "acc1.csv").write_text("9,39,1,2,0.5,-0.25\n9;39;1;3;1.5;-1.25\nh,m,s,us,x,y\n9,39,1,4,2.5,-2.25\n")
    got = recordings.read_column_snapshots(spark, str(tmp_path / "a"), 1).orderBy("line_no").collect()
    assert [(r["line_no"], r["x"]) for r in got] == [(0, -0.2), (1, 2.5), (3, -2.0)]
    rows = recordings.read_delimited_snapshots(spark, str(tmp_path / "b")).orderBy("line_no").collect()
    assert [(r["line_no"], r["horizontal"], r["vertical"]) for r in rows] == [(0, 0.5, -0.25), (1, 1.5, -1.25), (3, 2.5, -2.25)]


def state_frame(rng, size=60):
    return pd.DataFrame(
        {
            "series_id": "s", "n": np.arange(size), "a": rng.normal(-20, 5, size), "i": rng.normal(size=size),
            "chroma": list(map(list, rng.random((size, 12)))), "engagement": 0.0,
        }
    )


def test_state_store_keeps_what_it_got(spark, tmp_path):
    from seriesloom.schema import META, STATE

    state = spark.createDataFrame(state_frame(np.random.default_rng(1)), STATE)
    meta = spark.createDataFrame([("s", "h", 44100, 1024, 2048, 120.0, None, 4, 1.0, -80.0, (1.0, 1.0), ["none"])], META)
    stores.write_state(state, meta, str(tmp_path / "store"), buckets=4)
    back = stores.read_state(spark, str(tmp_path / "store"))
    fresh = dyn.derive(dense_series(state, ["series_id"]), omega_n=0.1, hop_s=0.02, chroma="chroma")
    again = dyn.derive(back, omega_n=0.1, hop_s=0.02, chroma="chroma")
    columns = ["n", "h", "kappa", "hue", "sat", "val"]
    a, b = (s.df.select(*columns).orderBy("n").toPandas() for s in (fresh, again))
    pd.testing.assert_frame_equal(a, b)


def test_ledger_appends_once_and_shows_tampering(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = spark.createDataFrame([(1, "aa", "one"), (2, "bb", "two"), (3, "aa", "copy")], "at int, content_hash string, song_id string")
    empty = spark.createDataFrame([], "index long, content_hash string, block_hash string")
    stores.append_ledger(ledger.append_once(empty, batch, "at"), path)
    more = spark.createDataFrame([(4, "bb", "again"), (5, "cc", "three")], "at int, content_hash string, song_id string")
    stores.append_ledger(ledger.append_once(stores.read_ledger(spark, path), more, "at"), path)
    assert ledger.append_once(stores.read_ledger(spark, path), more, "at").isEmpty()
    rows = stores.read_ledger(spark, path)
    assert [(r["index"], r["song_id"]) for r in rows.orderBy("index").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    assert ledger.verify(rows).first()["ok"]
    bad = rows.withColumn("content_hash", F.when(F.col("index") == 1, "zz").otherwise(F.col("content_hash")))
    assert tuple(ledger.verify(bad).first()) == (False, 1)
    assert ledger.find(rows, spark.createDataFrame([("cc",)], "content_hash string")).count() == 1


def test_export_is_checked_and_csv_is_readable(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 2).cast("string").alias("series_id"), F.floor(F.col("id") / 2).alias("n"), F.rand(3).alias("x"))
    rows = rows.cache()
    bad = stores.export_recordings(rows, spark.createDataFrame([("1",)], "series_id string"), str(tmp_path / "out"))
    assert bad.isEmpty() and spark.read.json(str(tmp_path / "out" / "index")).first()["rows"] == 100
    stores.write_table_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 200


# -- streams in several micro-batches ------------------------------------------------------------
def replay(spark, folder, rows, pieces, reader="n"):
    """Write rows in order as several files and read them one file per micro-batch."""
    pdf = rows.toPandas().sort_values(reader)
    for k, part in enumerate(np.array_split(pdf, pieces)):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.fixture
def history(spark):
    rng = np.random.default_rng(7)
    parts = [state_frame(rng, size).assign(series_id=k) for k, size in (("a", 90), ("b", 41), ("c", 1))]
    return dense_series(spark.createDataFrame(pd.concat(parts)).select("series_id", "n", "a", "i"), ["series_id"])


def closing(series, *columns):
    rows = series.df.select("series_id", "n", *columns, F.lit(False).alias("closing"))
    ends = rows.groupBy("series_id").agg((F.max("n") + 1).alias("n")).withColumn("closing", F.lit(True))
    return rows.unionByName(ends, allowMissingColumns=True)


def test_tick_stream_equals_batch(spark, tmp_path, history):
    batch = keys.tick_rows(keys.energy_ticks(dyn.climb(dyn.force(history)), F.lit(2.0)))
    facts = dyn.calibration(history).select("series_id", "s_a", "s_i")
    rows = closing(history.attach(facts).with_columns(eps=F.lit(2.0)), "a", "i", "s_a", "s_i", "eps")
    ingest.use_rocksdb(spark)
    stream = stateful.tick_stream(replay(spark, tmp_path, rows, 5), ["series_id"])
    got = stateful.run_available(stream, str(tmp_path / "run")).toPandas().sort_values(["series_id", "n"])
    want = batch.select("series_id", "n", "h", "step_rows").toPandas().sort_values(["series_id", "n"])
    assert got[["series_id", "n", "step_rows"]].values.tolist() == want[["series_id", "n", "step_rows"]].values.tolist()
    np.testing.assert_allclose(got["h"], want["h"], atol=1e-9)


def test_keyframe_stream_equals_batch(spark, tmp_path, history):
    policy = keys.seeded_policy(dyn.volatility(history, 1.0), 0.02, 1.0, event=60.0, hard=90.0)
    want = {tuple(r) for r in keys.keyframes(history, policy).collect()}
    z = dyn.standardise(history, za="a", zi="i").attach(policy)
    rows = closing(z, "za", "zi", "tau_event", "tau_max", "leak")
    stream = stateful.keyframe_stream(replay(spark, tmp_path, rows, 4), ["series_id"])
    assert {tuple(r) for r in stateful.run_available(stream, str(tmp_path / "run")).collect()} == want


def test_cusum_stream_equals_batch(spark, tmp_path, history):
    scored = history.with_columns(z=F.col("i")).reflected_sum(s=F.col("z") - 0.25, w=F.col("z"))
    want = scored.df.select("series_id", "n", F.round("s", 9), F.round("w", 9)).collect()
    stream = stateful.cusum_stream(replay(spark, tmp_path, closing(scored, "z"), 4), ["series_id"], 10.0)
    got = stateful.run_available(stream, str(tmp_path / "run")).select("series_id", "n", F.round("s", 9), F.round("w", 9))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want}


def test_monitor_stream_equals_batch(spark, tmp_path):
    from test_kernels import life

    snaps = dense_series(spark.createDataFrame(pd.concat([life("growing"), life("plateau")])), ["m"])
    want = {tuple(r) for r in health.monitor(snaps, 30).select("m", "detect_rev", "disposition").collect()}
    slim, columns = health.monitor_input(snaps, 30)
    rows = slim.df.filter("NOT in_reference").select("m", "n", *columns, F.lit(False).alias("closing"))
    ends = rows.groupBy("m").agg((F.max("n") + 1).alias("n")).withColumn("closing", F.lit(True))
    stream = stateful.monitor_stream(replay(spark, tmp_path, rows.unionByName(ends, allowMissingColumns=True), 6), ["m"])
    got = stateful.run_available(stream, str(tmp_path / "run")).select("m", "detect_rev", "disposition")
    assert {tuple(r) for r in got.collect()} == want


def test_late_rows_are_dropped_and_frames_are_whole(spark, tmp_path):
    from seriesloom.schema import EVENTS

    def batch(hours):
        at = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in hours]
        return pd.DataFrame({"event_id": range(len(at)), "ts": at, "user_id": 1, "event_type": "view", "value": 1.0, "props": "{}"})

    for hours in ([0.5, 1.5, 2.5], [30.0, 31.0], [31.5], [1.0, 32.0], [60.0], [61.0]):  # 1.0 comes far too late
        spark.createDataFrame(batch(hours), EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.run_available(frames.sliding_frames(events, "6 hours", "6 hours"), str(tmp_path / "run"))
    got = {r["start"].hour + 24 * (r["start"].day - 1): r["events"] for r in out.collect()}
    assert got == {0: 3, 30: 4}


def test_contents_and_files_are_taken_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    convert = lambda batch: batch.select("path", F.length("content").alias("bytes"))
    (tmp_path / "in" / "a.bin").write_bytes(b"12345")
    ingest.watch_folder(spark, str(tmp_path / "in"), store, progress, convert, "*.bin")
    (tmp_path / "in" / "b.bin").write_bytes(b"123")
    (tmp_path / "in" / "note.txt").write_text("no")
    for _ in range(2):
        ingest.watch_folder(spark, str(tmp_path / "in"), store, progress, convert, "*.bin")
    # a lost checkpoint replays every file: the store still holds each once
    ingest.watch_folder(spark, str(tmp_path / "in"), store, str(tmp_path / "fresh"), convert, "*.bin")
    assert sorted(r["bytes"] for r in spark.read.parquet(store).collect()) == [3, 5]
