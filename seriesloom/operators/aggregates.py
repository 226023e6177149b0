"""Grouped reductions: burst statistics, summaries, overviews, decile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.plans.selection import pick_rank
from seriesloom.plans.series import Series, index_series


def burst_statistics(value: Column) -> dict[str, Column]:
    """RMS, raw kurtosis (Gaussian near 3), peak and crest factor; zero-safe.

    Two values always have a kurtosis of 1 and three of 1.5. These are given exactly, because alarms compare days with
    each other, where rounding would decide between equal ones.
    """
    rms = F.sqrt(F.avg(value * value))
    peak = F.max(F.abs(value))
    few = F.when(F.count(value) == 2, F.lit(1.0)).when(F.count(value) == 3, F.lit(1.5))
    return {
        "rms": rms,
        "kurtosis": F.when(F.var_pop(value) > 0, F.coalesce(few, F.kurtosis(value) + 3.0)).otherwise(F.lit(0.0)),
        "peak": peak,
        "crest": F.when(rms > 0, peak / rms).otherwise(F.lit(0.0)),
    }


def crossing_rate(samples: Series, value: str, sr: Column | float) -> DataFrame:
    """Zero crossings per second per series; zero counts as positive, the first row never crosses."""
    sr = sr if isinstance(sr, Column) else F.lit(float(sr))
    sign = F.when(F.col(value) >= 0, 1).otherwise(-1)
    flips = samples.around(1, 0, flip=lambda w: (sign != F.lag(sign).over(w)).cast("int"))
    return flips.totals(n_samples=F.count(F.lit(1)), zcr_hz=F.lit(0.5) * F.sum("flip") * sr / F.count(F.lit(1)))


def steady_rate(revs: Series, bits: str, samples: str, skip: int = 8) -> DataFrame:
    """Bits per sample over all rows after the first ``skip``; NULL when nothing is left."""
    late = F.col("n") >= skip
    return revs.totals(bits_per_sample=F.sum(F.when(late, F.col(bits))) / F.sum(F.when(late, F.col(samples))))


def healthy_summary(rows: DataFrame, keys: list[str], healthy: Column, means: dict[str, str], worst: dict[str, str]) -> DataFrame:
    """Means over the healthy stretch next to unconditional maxima."""
    aggs = [F.avg(F.when(healthy, F.col(v))).alias(k) for k, v in means.items()]
    aggs += [F.max(v).alias(k) for k, v in worst.items()]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def decile_rates(rows: DataFrame, keys: list[str], by: str, order: str, flag: str, bins: int = 10) -> DataFrame:
    """Hit rate of ``flag`` in equal-count bins of ``by``, ties kept in row order.

    Bin sizes follow the equal split of an array: the first ``rows mod bins`` bins get one more.
    """
    ranked = index_series(rows, keys, [by, order]).stats(rows=F.count(F.lit(1)))
    wide = F.floor(F.col("rows") / bins)
    extra = F.col("rows") % bins
    big = extra * (wide + 1)
    where = F.when(F.col("n") < big, F.floor(F.col("n") / (wide + 1))).otherwise(
        extra + F.floor((F.col("n") - big) / F.greatest(wide, F.lit(1)))
    )
    return (
        ranked.with_columns(bin=where.cast("int"))
        .df.groupBy(*keys, "bin")
        .agg(F.avg(F.col(flag).cast("double")).alias("rate"), F.count(F.lit(1)).alias("rows"))
    )


def rising(rates: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """Whether the rate never drops by more than the tolerance from one bin to the next."""
    nxt = rates.select(*keys, (F.col("bin") - 1).alias("bin"), F.col("rate").alias("next_rate"))
    both = rates.join(nxt, [*keys, "bin"], "left")
    fine = F.coalesce(F.col("rate") <= F.col("next_rate") + tolerance, F.lit(True))
    return both.groupBy(*keys).agg(F.bool_and(fine).alias("monotone"))


def error_summary(rows: DataFrame, keys: list[str], error: str) -> DataFrame:
    """Largest, mean and upper-middle error per group."""
    middle = pick_rank(rows.select(*keys, error), keys, error, F.floor(F.col("rows") / 2), "err_mid")
    sums = rows.groupBy(*keys).agg(F.max(error).alias("err_max"), F.avg(error).alias("err_mean"))
    return sums.join(middle, keys)


def step_summary(ticks: DataFrame, keys: list[str], step: str = "step_rows") -> DataFrame:
    """Smallest, middle (upper) and largest step between ticks."""
    middle = pick_rank(ticks.select(*keys, step), keys, step, F.floor(F.col("rows") / 2), "step_mid")
    ends = ticks.groupBy(*keys).agg(F.min(step).alias("step_min"), F.max(step).alias("step_max"))
    return ends.join(middle, keys)


def mean_vector(rows: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Position-wise mean of array columns; sums are combined map-side per (key, position)."""
    long = rows.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = long.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("packed"))
    return packed.select(*keys, F.transform("packed", lambda p: p["m"]).alias(name))


def overview(samples: Series, value: str, buckets: int) -> DataFrame:
    """Per-bucket minimum and maximum, both seeded with 0; short series keep every sample."""
    rows = samples.stats(length=F.count(F.lit(1))).df
    short = F.col("length") <= buckets
    step = F.floor(F.col("length") / buckets)
    bucket = F.when(short, F.col("n")).otherwise(F.floor(F.col("n") / F.greatest(step, F.lit(1))))
    rows = rows.withColumn("bucket", bucket).withColumn("short", short).filter(short | (F.col("bucket") < buckets))
    lo, hi = F.min(value), F.max(value)
    return rows.groupBy(*samples.keys, "bucket", "short").agg(lo.alias("lo_raw"), hi.alias("hi_raw")).select(
        *samples.keys,
        "bucket",
        F.when(F.col("short"), F.col("lo_raw")).otherwise(F.least(F.lit(0.0), F.col("lo_raw"))).alias("lo"),
        F.when(F.col("short"), F.col("hi_raw")).otherwise(F.greatest(F.lit(0.0), F.col("hi_raw"))).alias("hi"),
    )


def inventory(state: DataFrame, keys_rows: DataFrame, keys: list[str], hop_s: float, key_bytes: int = 24) -> DataFrame:
    """Frames, keys, sparsity and index size per recording, from counts alone."""
    frames = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), (F.max("n") + 1).alias("last_frame"))
    held = keys_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_keys"))
    out = frames.join(held, keys, "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)))
    minutes = F.col("n_frames") * F.lit(hop_s) / 60.0
    return out.select(
        "*",
        (F.col("n_frames") / F.greatest(F.col("n_keys"), F.lit(1))).alias("sparsity"),
        (F.col("n_keys") * key_bytes).alias("key_bytes"),
        (F.col("n_keys") * key_bytes / 1024.0 / minutes).alias("kb_per_min"),
    )


def logical_sizes(state: DataFrame, keys: list[str], n_fft: int) -> DataFrame:
    """Logical float32 bytes of the state, of the stored columns and of the spectrogram they replace."""
    bins = n_fft // 2 + 1
    n = F.col("n_frames")
    return state.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames")).select(
        *keys,
        n,
        F.lit(bins).alias("n_bins"),
        (n * 8).alias("state_bytes"),
        (n * 56).alias("stored_bytes"),
        (n * 4 * bins).alias("stft_bytes"),
        (n * 4 * bins / F.greatest(n * 8, F.lit(1))).alias("ratio_state"),
        (n * 4 * bins / F.greatest(n * 56, F.lit(1))).alias("ratio_stored"),
    )


def top_moments(rows: DataFrame, keys: list[str], by: str, k: int, audible: Column | None = None) -> DataFrame:
    """The k strongest rows per series among the audible ones (earliest first on ties).

    Spark keeps only k rows per series and task before the shuffle, so a long series stays cheap.
    """
    rows = rows.filter(audible) if audible is not None else rows
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col("n"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
