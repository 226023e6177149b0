"""Equality and distance checks between two datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.dedup import chunk_hashes
from seriesloom.operators.features import dft_magnitudes, frame_arrays
from seriesloom.plans.series import Series


def content_mismatches(left: DataFrame, right: DataFrame, keys: list[str], value: Column, order: str = "n") -> DataFrame:
    """Chunks whose decoded values differ or that exist on one side only."""
    a = chunk_hashes(left, keys, value, order).withColumnRenamed("hash", "left_hash")
    b = chunk_hashes(right, keys, value, order).withColumnRenamed("hash", "right_hash")
    both = a.join(b, [*keys, "part"], "full_outer")
    return both.filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def log_spectral_distance(left: Series, right: Series, win: int, hop: int, x: str = "x") -> DataFrame:
    """Root mean square distance in dB over the frames and bins both series have."""
    keys = list(left.keys)
    bins = list(range(win // 2 + 1))
    level = lambda: F.transform(
        dft_magnitudes(F.col("x"), win, bins), lambda m: 20.0 * F.log10(m + F.lit(1e-6))
    )
    a = frame_arrays(left, win, hop, x).select(*keys, "n", level().alias("la"))
    b = frame_arrays(right, win, hop, x).select(*keys, "n", level().alias("lb"))
    gap = F.zip_with("la", "lb", lambda p, q: (p - q) * (p - q))
    rows = a.join(b, [*keys, "n"]).select(*keys, F.aggregate(gap, F.lit(0.0), lambda s, v: s + v).alias("sq"))
    return rows.groupBy(*keys).agg(F.sqrt(F.sum("sq") / (F.count(F.lit(1)) * len(bins))).alias("distance_db"))


def relative_l2(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """sqrt(sum (a - b)^2 / sum b^2) per group."""
    ratio = F.sqrt(F.sum((a - b) * (a - b)) / F.sum(b * b))
    return rows.groupBy(*keys).agg(ratio.alias("rel_l2")) if keys else rows.agg(ratio.alias("rel_l2"))
