"""How the shared tables play the roles of the data model, and the same roles in SQL."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans.series import Series, index_series

BIN_HZ = 350.0
BINS = 64
HOP_S = 1.0
OMEGA_N = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4).alias(name)


def loudness(value: Column) -> Column:
    return 20.0 * F.log10(F.greatest(value, F.lit(0.01)))


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state rows: loudness of the value, pitch of the counter in ``props``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "ts",
        "event_type",
        "value",
        loudness(F.col("value")).alias("a"),
        (12.0 * F.log2((k + 1) / F.lit(64.0))).alias("i"),
    )


def user_state(spark: SparkSession, sf_dir: str, *extra: str) -> Series:
    """Key ``user_id``, order of arrival, columns a and i (plus the extra ones asked for)."""
    rows = user_rows(spark, sf_dir)
    rows = rows.select("user_id", "ts", "event_id", "a", "i", *[c for c in extra if c not in ("ts", "event_id")])
    return index_series(rows, ["user_id"], ["ts", "event_id"]).slim("a", "i", *extra)


STATE = """
state AS (
  SELECT user_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
         20.0 * log10(greatest(value, 0.01)) AS a,
         12.0 * log2((CAST(json_extract(props, '$.k') AS INTEGER) + 1) / 64.0) AS i
  FROM events)"""


def waves(spark: SparkSession, sf_dir: str) -> Series:
    """Line items of a supplier in shipping order as a waveform: x is the centred quantity."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_shipdate",
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        (F.col("l_quantity") - 25.5).alias("x"),
        (F.round(F.col("l_quantity") * 100 + F.col("l_discount") * 100)).cast("int").alias("pcm"),
        F.col("l_quantity").cast("int").alias("q"),
    )
    series = index_series(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber"])
    return series.slim("x", "pcm", "q")


WAVES = """
waves AS (
  SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber) - 1 AS n,
         l_quantity - 25.5 AS x, CAST(round(l_quantity * 100 + l_discount * 100) AS INTEGER) AS pcm,
         CAST(l_quantity AS INTEGER) AS q
  FROM lineitem)"""


def tones(spark: SparkSession, sf_dir: str) -> Series:
    """Embeddings of a label in id order as spectra: 64 magnitudes, folded into 12 pitch classes."""
    e = F.col("embedding").cast("array<double>")
    folded = [reduce(add, [F.get("mag", F.lit(i)) for i in range(pc, BINS, 12)]) for pc in range(12)]
    rows = table(spark, sf_dir, "embeddings").withColumn("mag", F.transform(e, F.abs)).select(
        "label",
        "vec_id",
        "mag",
        F.array(*folded).alias("chroma"),
        (20.0 * F.log10(F.abs(e[13]) + F.lit(1e-10))).alias("a"),
    )
    series = index_series(rows, ["label"], ["vec_id"])
    return series.slim("vec_id", "mag", "chroma", "a")


TONES = """
tones AS (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n,
         list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS mag,
         list_transform(range(12), lambda pc: list_sum(list_transform(range(pc, 64, 12), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE))))) AS chroma,
         20.0 * log10(abs(CAST(embedding[14] AS DOUBLE)) + 1e-10) AS a
  FROM embeddings)"""
TONES_LONG = TONES + """,
bins AS (SELECT label, n, vec_id, unnest(range(64)) AS bin, unnest(mag) AS mag FROM tones)"""


def tones_long(series: Series) -> DataFrame:
    return series.df.select(*series.keys, "n", F.posexplode("mag").alias("bin", "mag"))


def days(spark: SparkSession, sf_dir: str) -> Series:
    """Users as machines, days as snapshots: burst statistics of the day's values."""
    from seriesloom.operators.aggregates import burst_statistics

    rows = table(spark, sf_dir, "events").select(
        "user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), "value"
    )
    stats = burst_statistics(F.col("value"))
    metrics = rows.groupBy("user_id", "day").agg(*[v.alias(k) for k, v in stats.items()])
    metrics = metrics.withColumn("t_h", F.col("day") * 24.0)
    return index_series(metrics, ["user_id"], ["day"])


DAYS = """
daily AS (
  SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day,
         sqrt(avg(value * value)) AS rms,
         CASE WHEN var_pop(value) > 0 THEN kurtosis_pop(value) + 3 ELSE 0 END AS kurtosis,
         max(abs(value)) AS peak
  FROM events GROUP BY 1, 2),
days AS (
  SELECT user_id, day, day * 24.0::DOUBLE AS t_h, rms, kurtosis, peak,
         CASE WHEN rms > 0 THEN peak / rms ELSE 0 END AS crest,
         row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS n
  FROM daily)"""


def gradient_sql(value: str, key: str = "user_id", order: str = "n") -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY {order})"
    prev, nxt = f"lag({value}) {w}", f"lead({value}) {w}"
    return (
        f"(CASE WHEN {prev} IS NOT NULL AND {nxt} IS NOT NULL THEN ({nxt} - {prev}) / 2.0 "
        f"WHEN {nxt} IS NOT NULL THEN {nxt} - {value} WHEN {prev} IS NOT NULL THEN {value} - {prev} ELSE 0.0 END)"
    )


GRADS = STATE + f""",
grads AS (SELECT *, {gradient_sql('a')} AS da, {gradient_sql('i')} AS di FROM state)"""
FORCE = GRADS + """,
spread AS (SELECT user_id, stddev_pop(da) AS s_a, stddev_pop(di) AS s_i FROM grads GROUP BY 1),
force AS (
  SELECT g.*, s_a, s_i, sqrt(power(da / CASE WHEN s_a = 0 THEN 1 ELSE s_a END, 2)
                           + power(di / CASE WHEN s_i = 0 THEN 1 ELSE s_i END, 2)) AS f
  FROM grads g JOIN spread USING (user_id)),
climb AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS h FROM force)"""
