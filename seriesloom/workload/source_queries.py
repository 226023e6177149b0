"""Sources and sinks over the shared tables: rows are written in a source's own format and read back by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.plans.series import index_series
from seriesloom.schema import META
from seriesloom.session import shared_folder
from seriesloom.sources import recordings, stores
from seriesloom.workload.registry import query
from seriesloom.workload.tables import DAYS, STATE, WAVES, days, r4, table, user_state, waves

ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
SOUND = f"""
sound AS (
  SELECT l_returnflag || '/' || l_linestatus AS series_id,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {', '.join(ITEM_ORDER)}) - 1 AS n,
         CAST(round(l_quantity * 100) AS INTEGER) AS c0, CAST(round(l_tax * 100000) AS INTEGER) - 4000 AS c1
  FROM lineitem)"""


def _written_recordings(spark, sf_dir):
    """Line items of a flag and status as a recording of two channels, in a folder for each flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("series_id"),
        *ITEM_ORDER,
        F.array(F.round(F.col("l_quantity") * 100), F.round(F.col("l_tax") * 100000) - 4000).cast("array<int>").alias("frame"),
    )
    numbered = index_series(rows, ["series_id"], ITEM_ORDER).df
    samples = numbered.select("series_id", "n", F.posexplode("frame").alias("channel", "x"))
    folder = shared_folder(spark, "recordings")
    recordings.write_recordings(recordings.chunked(samples), folder, 8000)
    return folder


@query("s1_recordings_mono", f"WITH {SOUND} SELECT series_id, n, (c0 + c1) / 65536.0::DOUBLE AS x FROM sound")
def recordings_mono(spark, sf_dir):
    chunks = recordings.read_recordings(spark, _written_recordings(spark, sf_dir), range_bytes=1 << 20)
    return recordings.long_samples(chunks).select("series_id", "n", "x")


@query("s2_recordings_native", f"""WITH {SOUND}, c AS (SELECT series_id, n, 0 AS channel, c0 AS x FROM sound UNION ALL SELECT series_id, n, 1, c1 FROM sound)
SELECT series_id, channel, 8000 AS sr, 2 AS channels, 16 AS sample_bits, count(*) AS frames, CAST(sum(x * (n % 1000)) AS BIGINT) AS moment, min(x) AS low, max(x) AS high
FROM c GROUP BY 1, 2""")
def recordings_native(spark, sf_dir):
    folder = _written_recordings(spark, sf_dir)
    samples = recordings.long_samples(recordings.read_recordings(spark, folder, mono=False, native=True))
    sums = samples.groupBy("series_id", "channel").agg(
        F.sum(F.col("x") * (F.col("n") % 1000)).alias("moment"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    return sums.join(recordings.read_recording_facts(spark, folder), "series_id")


SNAPSHOT = 1000  # lines of a file
LINES = f"""lines AS (SELECT *, user_id % 8 AS machine, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS m FROM events),
files AS (SELECT *, m // {SNAPSHOT} AS snap, m % {SNAPSHOT} AS line_no FROM lines)"""


def written_snapshots(spark, sf_dir, line):
    """Each machine's events in text files of a thousand lines."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("machine"), "ts", "event_id", line.alias("line"))
    rows = index_series(rows, ["machine"], ["ts", "event_id"]).df
    texts = rows.groupBy("machine", F.floor(F.col("n") / SNAPSHOT).alias("snap")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    folder = shared_folder(spark, "snapshots")
    texts.select("machine", "snap", F.array_join("lines.line", "\n").alias("value")).write.partitionBy("machine", "snap").text(folder)
    return folder


def of_path(name):
    return F.regexp_extract("path", name + r"=(\d+)/", 1).cast("long").alias(name)


@query("s3_column_snapshots", f"WITH {LINES} SELECT machine, snap, line_no, value AS x FROM files WHERE event_id % 10 <> 0")
def column_snapshots(spark, sf_dir):
    line = F.concat(F.lit(" 0.5\t"), F.col("value").cast("string"), F.lit("  "), F.col("event_id").cast("string"))
    folder = written_snapshots(spark, sf_dir, F.when(F.col("event_id") % 10 == 0, "no reading here").otherwise(line))
    return recordings.read_column_snapshots(spark, folder, 1).select(of_path("machine"), of_path("snap"), "line_no", "x")


@query("s4_delimited_snapshots", f"WITH {LINES} SELECT machine, snap, line_no, value AS horizontal, -value / 2 AS vertical FROM files WHERE event_id % 9 <> 0")
def delimited_snapshots(spark, sf_dir):
    fields = [F.hour("ts"), F.minute("ts"), F.second("ts"), F.lit(0), F.col("value"), -F.col("value") / 2]
    texts = [f.cast("string") for f in fields]
    line = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", *texts)).otherwise(F.concat_ws(";", *texts))
    folder = written_snapshots(spark, sf_dir, F.when(F.col("event_id") % 9 == 0, "h,m,s,us,x,y").otherwise(line))
    return recordings.read_delimited_snapshots(spark, folder).select(of_path("machine"), of_path("snap"), "line_no", "horizontal", "vertical")


@query("s7_state_store", f"""WITH {STATE} SELECT CAST(user_id AS VARCHAR) AS series_id, n, round(a, 4) AS a, round(i, 4) AS i, 60.0 + user_id % 90 AS bpm FROM state""")
def state_store(spark, sf_dir):
    rows = user_state(spark, sf_dir).df.select(
        F.col("user_id").cast("string").alias("series_id"), "n", "a", "i",
        F.lit(None).cast("array<double>").alias("chroma"), F.lit(0.0).alias("engagement"),
    )
    facts = {"series_id": F.col("series_id"), "bpm": 60.0 + F.col("series_id").cast("long") % 90, "hop": F.lit(1)}
    meta = rows.select("series_id").distinct().select(*[facts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in META])
    folder = shared_folder(spark, "state")
    stores.write_state(rows, meta, folder, buckets=8)
    return stores.read_state(spark, folder).df.select("series_id", "n", r4("a", "a"), r4("i", "i"), "bpm")


@query("s8_ledger_lines", "SELECT doc_id AS index, sha256(text) AS content_hash, source AS song_id, n_chars AS n_frames FROM documents")
def ledger_lines(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("song_id"), F.col("n_chars").alias("n_frames")
    )
    path = shared_folder(spark, "ledger")
    for part in (F.col("index") % 2 == 1, F.col("index") % 2 == 0):
        stores.append_ledger(blocks.where(part), path)
    return stores.read_ledger(spark, path).select("index", "content_hash", "song_id", "n_frames")


@query("s9_metrics_csv", f"WITH {DAYS} SELECT user_id, day, round(rms, 4) AS rms, round(peak, 4) AS peak FROM days")
def metrics_csv(spark, sf_dir):
    rows = days(spark, sf_dir).df.select("user_id", "day", "rms", "peak")
    path = shared_folder(spark, "csv")
    stores.write_table_csv(rows, path)
    back = spark.read.option("header", True).schema(rows.schema).csv(path)
    return back.select("user_id", "day", r4("rms", "rms"), r4("peak", "peak"))


@query("s10_checked_export", f"""WITH {WAVES} SELECT CAST(l_suppkey AS VARCHAR) AS series_id, count(*) AS rows, min(n) AS first, max(n) AS last, false AS differs
FROM waves WHERE l_suppkey % 3 = 0 GROUP BY 1""")
def checked_export(spark, sf_dir):
    samples = waves(spark, sf_dir).df.select(F.col("l_suppkey").cast("string").alias("series_id"), "n", "x")
    wanted = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("series_id"))
    folder = shared_folder(spark, "export")
    bad = stores.export_recordings(samples, wanted, folder).withColumn("differs", F.lit(True))
    index = spark.read.schema("series_id string, rows long, first long, last long").json(f"{folder}/index")
    return index.join(bad, "series_id", "left").withColumn("differs", F.coalesce("differs", F.lit(False)))
