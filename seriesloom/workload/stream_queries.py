"""The stateful streams over the event table, drained with ``availableNow``.

The rows of the batch side are written as the stream's source, in a folder below the cluster's
checkpoint folder; each must equal the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import dynamics as dyn
from seriesloom.operators import health
from seriesloom.operators import keyframes as keys
from seriesloom.plans.series import Series
from seriesloom.session import block_rows, checkpointed, shared_folder
from seriesloom.streaming import ingest, manifest, stateful
from seriesloom.streaming.frames import sessions, sliding_frames, with_end
from seriesloom.workload.health_queries import CUSUM, FRAMES, LIMIT, REF, SESSIONS, monitor_snapshots
from seriesloom.workload.registry import query
from seriesloom.workload.source_queries import LINES, of_path, written_snapshots
from seriesloom.workload.state_queries import EPS_H, ONE_EPS, RAILS, SCALED, _policy
from seriesloom.workload.tables import r4, table, user_state


def _replay(series: Series, columns: list[str], name: str, spark, build) -> DataFrame:
    """Feed the rows (and one closing row per series) to a stream in waves of increasing ``n``.

    A wave brings at most ``seriesloom.block.rows`` rows of any series, so that is all a task holds
    of a key at a time; the stream resumes from its checkpoint for every wave.
    """
    rows = series.df.select(*series.keys, "n", *columns, F.lit(False).alias("closing"))
    ends = rows.groupBy(*series.keys).agg((F.max("n") + 1).alias("n")).withColumn("closing", F.lit(True))
    rows = rows.unionByName(ends, allowMissingColumns=True)
    size = block_rows(spark)
    last = ends.agg(F.max("n")).first()[0] or 0
    waves = range(last // size + 1)
    if len(waves) > 1:
        rows = checkpointed(rows)
    folder = shared_folder(spark, name)
    ingest.use_rocksdb(spark)
    for wave in waves:
        rows.filter(F.floor(F.col("n") / size) == wave).write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/input")
        out = stateful.run_available(build(stream), folder)
    return out


@query("st1_tick_stream", f"WITH RECURSIVE {ONE_EPS} SELECT user_id, n, round(h, 4) AS h, step_rows FROM ticks")
def tick_stream(spark, sf_dir):
    s = user_state(spark, sf_dir)
    s = s.attach(dyn.calibration(s).select("user_id", "s_a", "s_i")).with_columns(eps=F.lit(EPS_H))
    out = _replay(s, ["a", "i", "s_a", "s_i", "eps"], "ticks", spark, lambda rows: stateful.tick_stream(rows, ["user_id"]))
    return out.select("user_id", "n", r4("h", "h"), "step_rows")


@query("st2_keyframe_stream", f"WITH RECURSIVE {SCALED}, {RAILS} SELECT user_id, n, rail FROM picked")
def keyframe_stream(spark, sf_dir):
    s = user_state(spark, sf_dir)
    z = dyn.standardise(s, za="a", zi="i").attach(_policy(s, 60.0, 90.0).select("user_id", "tau_event", "tau_max", "leak"))
    columns = ["za", "zi", "tau_event", "tau_max", "leak"]
    return _replay(z, columns, "keyframes", spark, lambda rows: stateful.keyframe_stream(rows, ["user_id"]))


@query("st3_monitor_stream")
def monitor_stream(spark, sf_dir):
    s, columns = health.monitor_input(monitor_snapshots(spark, sf_dir), 4)
    late = Series(s.df.filter("NOT in_reference"), s.keys, s.block)
    out = _replay(late, columns, "monitor", spark, lambda rows: stateful.monitor_stream(rows, ["user_id"], first=4))
    return out.select("user_id", "detect_rev", "disposition", r4("t_detect_h", "t_detect_h"), r4("departure_sigma", "departure_sigma"))


@query("st4_cusum_stream", f"WITH RECURSIVE {CUSUM} SELECT user_id, n, round(s, 4) AS s, round(w, 4) AS w FROM walks WHERE n >= {REF}")
def cusum_stream(spark, sf_dir):
    s = health.reference_scores(user_state(spark, sf_dir), "a", REF)
    late = Series(s.df.filter(F.col("n") >= REF), s.keys, s.block)
    out = _replay(late, ["z"], "cusum", spark, lambda rows: stateful.cusum_stream(rows, ["user_id"], LIMIT, slack=0.05, first=REF))
    return out.select("user_id", "n", r4("s", "s"), r4("w", "w"))


def _ended_events(spark, sf_dir, span):
    """The events as a stream that ends: one closing time follows, ``span`` and the lateness of an hour after the last."""
    folder = shared_folder(spark, "ends")
    events = table(spark, sf_dir, "events")
    events.select((F.max("ts") + F.expr(f"INTERVAL {span}") + F.expr("INTERVAL 2 HOURS")).alias("ts")).where("ts IS NOT NULL").write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return with_end(stream, spark.readStream.schema(events.select("ts").schema).parquet(folder))


@query("st5_frame_stream", FRAMES)
def frame_stream(spark, sf_dir):
    """Sliding frames as a stream that was drained to its end."""
    events = _ended_events(spark, sf_dir, "24 HOURS")
    out = stateful.run_available(sliding_frames(events, "24 hours", "6 hours"), shared_folder(spark, "frames"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events", r4("total", "total"))


@query("st6_session_stream", SESSIONS)
def session_stream(spark, sf_dir):
    """Sessions as a stream that was drained to its end."""
    events = _ended_events(spark, sf_dir, "12 HOURS")
    out = stateful.run_available(sessions(events, "12 hours"), shared_folder(spark, "sessions"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events", r4("total", "total"))


@query("st7_content_stream", "SELECT DISTINCT event_type || ':' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS content_hash, 1 AS copies FROM events")
def content_stream(spark, sf_dir):
    """Copies per content in the store after the same events were drained twice."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    content = F.concat_ws(":", "event_type", F.round("value").cast("long").cast("string"))
    rows = events.select("ts", content.alias("content_hash"))
    folder = shared_folder(spark, "contents")
    ingest.ingest_stream(ingest.once_per_content(rows, "1 hour"), f"{folder}/store", f"{folder}/first", prefixes=8)
    ingest.ingest_stream(ingest.once_per_content(rows, "1 hour"), f"{folder}/store", f"{folder}/second", prefixes=8)
    stored = manifest.read_store(spark, f"{folder}/store", T.StructType([rows.schema["content_hash"]]))
    return stored.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"))


@query("s13_settled_files", f"WITH {LINES} SELECT machine, snap, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS ids FROM files GROUP BY 1, 2")
def settled_snapshots(spark, sf_dir):
    """Files of a watched folder, converted once over two runs and a lost checkpoint."""
    files = written_snapshots(spark, sf_dir, F.col("event_id").cast("string"))
    folder = shared_folder(spark, "watched")
    ids = F.transform(F.split(F.trim(F.col("content").cast("string"), F.lit("\n")), "\n"), lambda x: x.cast("long"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)

    def convert(batch):
        return batch.withColumn("ids", ids).select("path", F.size("ids").cast("long").alias("lines"), total.alias("ids"))

    for progress in ("first", "first", "second"):
        ingest.watch_folder(spark, files, f"{folder}/store", f"{folder}/{progress}", convert, "*.txt", settle=0.2, prefixes=8)
    stored = manifest.read_store(spark, f"{folder}/store", T.StructType.fromDDL("path string, lines long, ids long"))
    return stored.select(of_path("machine"), of_path("snap"), "lines", "ids")
