"""Stored tables: state, ledger, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.verify import content_mismatches
from seriesloom.plans.series import Series, dense_series
from seriesloom.schema import LEDGER, META, STATE

BUCKETS = 256


def write_state(state: DataFrame, meta: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Only the independent columns are stored, in folders by a hash bucket of the series.

    Rows are spread by (bucket, position), so a long series is written by many tasks.
    """
    rows = state.select(*STATE.fieldNames())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int"))
    spread = rows.repartition(F.col("bucket"), F.floor(F.col("n") / (1 << 20)))
    spread.sortWithinPartitions("bucket", "series_id", "n").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state")
    meta.select(*META.fieldNames()).write.mode("overwrite").parquet(f"{folder}/meta")


def read_state(spark: SparkSession, folder: str) -> Series:
    """Stored state with its meta; derived columns follow from ``operators.dynamics.derive``."""
    state = spark.read.schema(T.StructType([*STATE, T.StructField("bucket", T.IntegerType())])).parquet(f"{folder}/state").drop("bucket")
    meta = spark.read.schema(META).parquet(f"{folder}/meta")
    return dense_series(state, ["series_id"]).attach(meta)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; the order is the ``index`` column, never the position in a file."""
    return spark.read.schema(LEDGER).json(path)


def append_ledger(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("append").json(path)


def write_table_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_recordings(samples: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Copy the wanted series with a JSON-lines index; returns the series whose copy differs."""
    picked = samples.join(wanted.select("series_id").distinct(), "series_id", "left_semi")
    picked.write.mode("overwrite").parquet(f"{folder}/samples")
    counts = picked.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"), F.max("n").alias("last"))
    counts.write.mode("overwrite").json(f"{folder}/index")
    copy = samples.sparkSession.read.schema(picked.schema).parquet(f"{folder}/samples")
    return content_mismatches(picked, copy, ["series_id"], F.col("x")).select("series_id").distinct()
