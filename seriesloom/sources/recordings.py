"""Recordings and sensor snapshots from files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans.selection import pick_rank
from seriesloom.plans.series import Series, index_series
from seriesloom.sources.pcm import CHUNK, RANGE_BYTES, PcmSource, absolute

AUDIO_EXTENSIONS = ["wav"]
PEAK_SHARE = 0.95 * 32767.0


def read_recordings(
    spark: SparkSession, folder: str, mono: bool = True, native: bool = False, first: int = 0, after: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Chunks of 65 536 samples of every PCM file below a folder, whose path below it names the series.

    ``mono`` averages the channels; ``native`` keeps whole sample values (32-bit integers, or their average) instead
    of scaling to [-1, 1). Only frames from ``first`` to before ``after`` are read. Files are read by byte ranges.
    """
    spark.dataSource.register(PcmSource)
    out = spark.read.format("pcm").option("mono", mono).option("native", native).option("rangeBytes", range_bytes).option("first", first)
    return (out if after is None else out.option("after", after)).load(absolute(folder))


def read_recording_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Sample rate, channels, bits and length of every PCM file, from the headers alone."""
    spark.dataSource.register(PcmSource)
    return spark.read.format("pcm").option("rows", "facts").load(absolute(folder))


def write_recordings(chunks: DataFrame, folder: str, sr: int, bits: int = 16) -> None:
    """Write chunks of whole sample values, as ``read_recordings(mono=False, native=True)`` gives them, as one file for
    each series. Chunks of a series pass through one task in order, one at a time."""
    chunks.sparkSession.dataSource.register(PcmSource)
    shape = chunks.groupBy("series_id").agg(
        (F.max("channel") + 1).alias("channels"), F.max(F.col("start") + F.size("x")).cast("long").alias("frames")
    )
    rows = chunks.join(shape, "series_id").repartition("series_id").sortWithinPartitions("series_id", "start", "channel")
    rows.write.format("pcm").options(sr=str(sr), bits=str(bits)).mode("append").save(absolute(folder))


def chunked(samples: DataFrame) -> DataFrame:
    """``series_id, channel, n, x`` with dense ``n``, one row per sample, as chunks."""
    rows = samples.groupBy("series_id", "channel", F.floor(F.col("n") / CHUNK).cast("int").alias("chunk"))
    rows = rows.agg(F.min("n").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))
    return rows.select("series_id", "channel", "chunk", "start", "x")


def long_samples(chunks: DataFrame) -> DataFrame:
    """``series_id, channel, n, x``: one row per sample."""
    rows = chunks.select("series_id", "channel", "start", F.posexplode("x").alias("at", "x"))
    return rows.select("series_id", "channel", (F.col("start") + F.col("at")).alias("n"), "x")


def _text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, line_no, line`` of every file; a snapshot file is one short burst."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("line_no", "line"))


def read_column_snapshots(spark: SparkSession, folder: str, channel: int) -> DataFrame:
    """Whitespace-separated sensor columns; lines whose channel does not parse are skipped."""
    parts = F.split(F.trim(F.regexp_replace("line", r"\r", "")), r"\s+")
    rows = _text_lines(spark, folder).withColumn("x", F.get(parts, F.lit(channel)).try_cast("double"))
    return rows.filter(F.col("x").isNotNull()).select("path", "line_no", "x")


def read_delimited_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """``h,m,s,us,horizontal,vertical`` with a comma or a semicolon, decided line by line."""
    line = F.regexp_replace("line", r"\r", "")
    parts = F.split(F.regexp_replace(line, ";", ","), ",")
    field = lambda at: F.trim(F.get(parts, F.lit(at))).try_cast("double")
    rows = _text_lines(spark, folder).select("path", "line_no", field(4).alias("horizontal"), field(5).alias("vertical"))
    return rows.filter(F.col("horizontal").isNotNull() & F.col("vertical").isNotNull())


def timed_files(files: DataFrame, keys: list[str], name: str, cadence_h: float) -> DataFrame:
    """Files of a machine in name order with ``snap`` 0, 1, 2, ... and ``t_h = snap * cadence``."""
    rows = index_series(files, keys, [name]).df.withColumnRenamed("n", "snap").drop("blk")
    return rows.withColumn("t_h", F.col("snap") * F.lit(float(cadence_h)))


def count_scale(samples: DataFrame, snap: str, value: str) -> Column:
    """Counts per unit from the 99.9th percentile of |x| over every k-th snapshot, as a scalar subquery.

    k keeps about 40 snapshots; the percentile is the value at sorted index floor(len * 0.999).
    """
    last = samples.select(F.max(snap)).scalar()
    step = F.greatest(F.lit(1), F.floor((last + 1) / 40))
    probed = samples.filter(F.pmod(F.col(snap), step) == 0).select(F.lit(0).alias("corpus"), F.abs(value).alias("size"))
    top = pick_rank(probed, ["corpus"], "size", F.floor(F.col("rows") * 0.999), "top")
    return F.lit(PEAK_SHARE) / F.greatest(top.select("top").scalar(), F.lit(1e-9))


def peak_scale(series: Series, value: str, name: str = "scale") -> Series:
    """Counts per unit from the largest |x| of each series, as a column of every row."""
    held = series.stats(_peak=F.max(F.abs(F.col(value))))
    held = held.with_columns(**{name: F.lit(PEAK_SHARE) / F.greatest(F.col("_peak"), F.lit(1e-9))})
    return replace(held, df=held.df.drop("_peak"))


def to_counts(value: Column, scale: Column) -> Column:
    """Rounded half away from zero and clamped to 16 bits."""
    return F.greatest(F.least(F.round(value * scale), F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def catalogue(files: DataFrame, path: str, extension: str, derived: str) -> DataFrame:
    """File list with folder, stem and extension; raw files flagged when a derived sibling exists."""
    at = F.col(path)
    rows = files.select(
        "*",
        F.regexp_extract(at, r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract(at, r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"),
        F.lower(F.regexp_extract(at, r"\.([^./]*)$", 1)).alias("ext"),
    )
    rows = rows.filter(F.col("ext").isin(extension, derived))
    done = rows.filter(F.col("ext") == derived).select("folder", "stem").distinct().withColumn("has_derived", F.lit(True))
    out = rows.join(done, ["folder", "stem"], "left")
    return out.withColumn("has_derived", (F.col("ext") != derived) & F.coalesce("has_derived", F.lit(False)))
