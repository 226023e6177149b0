"""Store of distinct contents with a manifest for each micro-batch.

Rows live in ``prefix=<hash prefix>/batch=<key>`` folders, and ``_manifest/<key>`` lists those a batch wrote once they
are whole. A batch is compared with the folders of its own prefixes only, and of their rows only the content column is
read. A batch whose key is in the manifest is done; one that failed half-way left folders that no manifest names, and
replaces them when it comes again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIXES = 256
ENTRIES = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("prefix", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("live", T.BooleanType()),
    ]
)


def entries(spark: SparkSession, store: str) -> DataFrame | None:
    """All manifest rows, or None if nothing was committed yet."""
    try:
        return spark.read.schema(ENTRIES).option("recursiveFileLookup", "true").json(f"{store}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def live_folders(spark: SparkSession, store: str, prefixes: list[int] | None = None) -> list[tuple[int, str]]:
    """(prefix, batch) of the folders that count, of some prefixes or of all."""
    rows = entries(spark, store)
    if rows is None:
        return []
    rows = rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))
    live = rows.where("rows > 0").groupBy("prefix", "batch").agg(F.min("live").alias("live")).where("live")
    return [(r["prefix"], r["batch"]) for r in live.select("prefix", "batch").collect()]


def _paths(store: str, folders: list[tuple[int, str]]) -> list[str]:
    return [f"{store}/prefix={p}/batch={b}" for p, b in folders]


def _commit(spark: SparkSession, store: str, name: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, ENTRIES).coalesce(1).write.mode("overwrite").json(f"{store}/_manifest/{name}")


def append_batch(batch: DataFrame, store: str, key: str, content: str = "content_hash", prefixes: int = PREFIXES) -> int:
    """Add the contents that the store doesn't hold, the smallest row of each; returns how many. A null is no content.

    ``key`` names the batch: coming again under the same key it changes nothing, under another key its contents are known.
    """
    spark = batch.sparkSession
    done = entries(spark, store)
    if done is not None and not done.where(F.col("batch") == key).isEmpty():
        return 0
    first = batch.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(*[c for c in batch.columns if c != content])).alias("first"))
    first = first.select(content, "first.*").withColumn("prefix", F.pmod(F.xxhash64(content), F.lit(prefixes)).cast("int")).persist()
    try:
        touched = [r["prefix"] for r in first.select("prefix").distinct().collect()]  # at most ``prefixes`` numbers
        known = _paths(store, live_folders(spark, store, touched))
        fresh = first
        if known:
            kept = spark.read.schema(T.StructType([batch.schema[content]])).parquet(*known)
            fresh = first.join(kept, content, "left_anti")
        fresh = fresh.withColumn("batch", F.lit(key)).persist()
        try:
            counts = {r["prefix"]: r["count"] for r in fresh.groupBy("prefix").count().collect()}
            if counts:
                out = fresh.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                out.partitionBy("prefix", "batch").parquet(store)
            _commit(spark, store, key, [(key, p, n, True) for p, n in counts.items()] or [(key, -1, 0, True)])
        finally:
            fresh.unpersist()
    finally:
        first.unpersist()
    return sum(counts.values())


def read_store(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The committed rows."""
    folders = _paths(store, live_folders(spark, store))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_folders(spark: SparkSession, store: str, schema: T.StructType, most: int = 16) -> int:
    """Rewrite prefixes with more than ``most`` folders as one folder each; returns how many prefixes that were.

    The old folders no longer count but stay, for readers that still use them.
    """
    held: dict[int, list[str]] = {}
    for prefix, batch in live_folders(spark, store):
        held.setdefault(prefix, []).append(batch)
    many = {p: b for p, b in held.items() if len(b) > most}
    if not many:
        return 0
    key = f"merged-{uuid.uuid4().hex}"
    old = [(p, b) for p, batches in many.items() for b in batches]
    rows = spark.read.schema(T.StructType([*schema, T.StructField("prefix", T.IntegerType())])).option("basePath", store).parquet(*_paths(store, old))
    rows.repartition("prefix").withColumn("batch", F.lit(key)).write.mode("append").partitionBy("prefix", "batch").parquet(store)
    counts = spark.read.schema(T.StructType([T.StructField("prefix", T.IntegerType())])).option("basePath", store)
    counts = counts.parquet(*_paths(store, [(p, key) for p in many])).groupBy("prefix").count().collect()
    _commit(spark, store, key, [(key, r["prefix"], r["count"], True) for r in counts] + [(b, p, 1, False) for p, b in old])
    return len(many)
