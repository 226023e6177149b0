"""Machine-health indicators, coding-cost meters, alarms, change detection and dispositions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import rice_bits, zigzag
from seriesloom.operators.features import _burst_magnitudes, _envelope, previous_power_of_two, refine_speeds, stacks
from seriesloom.plans.relay import Emits, run_rule
from seriesloom.plans.series import Series, index_series

# Fixed values of the coding-cost meter, the detectors and the disposition rule.
FULL_SCALE = 32768.0
RICE_BLOCK = 256
RICE_HEADER_BITS = 5
RICE_PARAMETERS = range(17)
WARMUP_REVS = 8
EMA_WEIGHT = 1.0 / 64.0
FOLD_REVS = 32_768  # (64/63) ** FOLD_REVS still is a finite number
FOLD_STEP = 4096  # revolutions of a burst that are averaged together
CUSUM_SLACK = 0.25
CUSUM_THRESHOLD = 10.0
CONFIRM_MIN = 12
CONFIRM_MAX = 30
ABSORB_CEILING = 30.0
SERVICE_DEPARTURE = 100.0
RISE_RATIO = 1.25

# Bearing orders per shaft revolution (name, rollers, outer, inner, ball, cage).
BEARINGS = [
    ("Rexnord ZA-2115", 16, 7.092, 8.908, 4.197, 0.443),
    ("SKF 6205-2RS JEM", 9, 3.5848, 5.4152, 2.3575, 0.39828),
]


# -- alarms -------------------------------------------------------------------------------------
def first_alarm(
    metrics: Series,
    t: str = "t_h",
    value: str = "value",
    k_sigma: float = 5.0,
    consecutive: int = 3,
    share: float = 0.25,
    cap_h: float = 5.0,
) -> DataFrame:
    """First of ``consecutive`` rows above mean + k sigma of the reference stretch, NULL if none.

    The reference is the rows up to min(share * last time, cap); fewer than four rows overall or in
    the reference give no alarm.
    """
    rows = metrics.stats(t_end=F.max(t), total=F.count(F.lit(1)))
    quiet = F.col(t) <= F.least(F.lit(share) * F.col("t_end"), F.lit(cap_h))
    rows = rows.with_columns(quiet=quiet)
    in_ref = F.when(F.col("quiet"), F.col(value))
    rows = rows.stats(ref_mu=F.avg(in_ref), ref_sd=F.stddev_pop(in_ref), ref_rows=F.count(in_ref))
    tiny = F.lit(1e-12) * F.greatest(F.abs(F.col("ref_mu")), F.lit(1e-12))
    limit = F.col("ref_mu") + F.lit(k_sigma) * F.greatest(F.col("ref_sd"), tiny)
    over = (~F.col("quiet") & (F.col(value) > limit)).cast("int")
    ahead = lambda w: w.rowsBetween(0, consecutive - 1)
    rows = rows.with_columns(limit=limit, over=over).around(
        0,
        consecutive - 1,
        streak=lambda w: F.when(F.count("over").over(ahead(w)) == consecutive, F.min("over").over(ahead(w))).otherwise(0),
    )
    enough = (F.col("total") >= 4) & (F.col("ref_rows") >= 4)
    return rows.totals(t_alarm=F.min(F.when(enough & (F.col("streak") == 1), F.col(t))))


def indicator_rows(metrics: DataFrame, keys: list[str], t: str, indicators: dict[str, tuple[str, bool]]) -> DataFrame:
    """Wide metrics to (name, informed, t, value); ``indicators`` maps a column to its name and flag."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(informed).alias("informed"), F.col(c).cast("double").alias("value"))
            for c, (name, informed) in indicators.items()
        ]
    )
    return metrics.select(*keys, t, F.inline(pairs))


def alarm_leads(alarms: DataFrame, failures: DataFrame, on: list[str]) -> DataFrame:
    """Lead = failure time - alarm time; NULL when either is missing."""
    return alarms.join(failures, on, "left").withColumn("lead_h", F.col("t_fail") - F.col("t_alarm"))


# -- change detection ---------------------------------------------------------------------------
def cusum(rows: Series, z: Column, slack: float = CUSUM_SLACK) -> Series:
    """``s`` (with slack) and ``w`` (without) as reflected sums of the standardised value."""
    return rows.with_columns(z=z).reflected_sum(s=F.col("z") - F.lit(slack), w=F.col("z"))


def detections(scored: Series, t: str = "t_h", threshold: float = CUSUM_THRESHOLD) -> DataFrame:
    """First row with s >= threshold and the row where the slack-free walk last left zero."""
    rows = scored.around(1, 0, w_before=lambda w: F.coalesce(F.lag("w").over(w), F.lit(0.0)))
    left_zero = (F.col("w") > 0) & (F.col("w_before") <= 0)
    rows = rows.running(start=("last", F.when(left_zero, F.struct(F.col("n"), F.col(t).alias("t")))))
    hit = F.struct(F.col("n"), F.col(t).alias("t"), F.col("start"))
    first = rows.df.filter(F.col("s") >= threshold).groupBy(*rows.keys).agg(F.min_by(hit, "n").alias("hit"))
    return first.select(
        *rows.keys,
        F.col("hit.n").alias("detect_n"),
        F.col("hit.t").alias("t_detect"),
        F.coalesce("hit.start.n", "hit.n").alias("onset_n"),
        F.coalesce("hit.start.t", "hit.t").alias("t_onset"),
    )


def reference_scores(rows: Series, value: str, reference_rows: int) -> Series:
    """Departure ``z`` from the mean and spread of the first ``reference_rows`` rows."""
    early = F.when(F.col("n") < reference_rows, F.col(value))
    out = rows.stats(ref_mu=F.avg(early), ref_sd=F.stddev_pop(early))
    return out.with_columns(z=(F.col(value) - F.col("ref_mu")) / F.greatest(F.col("ref_sd"), F.lit(1e-9)))


def dispositions(candidates: DataFrame, keys: list[str], order: str = "ord", t: str = "t_h", d: str = "d") -> DataFrame:
    """Verdict per candidate from its departures in order (1, 2, ...).

    A verdict falls at the latest on row 30, so only those rows are looked at; a candidate that
    ends undecided is judged on its last row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = candidates.filter(F.col(order) <= CONFIRM_MAX)
    n = F.col(order)
    three = lambda lo, hi: F.coalesce(F.sum(d).over(w.rowsBetween(lo, hi)), F.lit(0.0)) / 3.0
    total_first3 = F.sum(F.when(n <= 3, F.col(d))).over(w.rowsBetween(Window.unboundedPreceding, 0)) / 3.0
    recent = w.rowsBetween(-11, 0)
    rows = rows.select(
        *keys,
        n.alias("ord"),
        F.col(t).alias("t"),
        three(-2, 0).alias("last"),
        F.greatest(F.when(n - 6 >= 3, three(-8, -6)).otherwise(total_first3), F.lit(0.05)).alias("prev"),
        F.avg(d).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"),
        F.regr_slope(F.log(F.greatest(F.col(d), F.lit(0.05))), F.col(t)).over(recent).alias("slope"),
        F.lead(n).over(w).isNull().alias("at_end"),
    )
    rising = F.col("last") / F.col("prev") >= RISE_RATIO
    decided = (F.col("ord") >= CONFIRM_MIN) & ~(rising & (F.col("ord") < CONFIRM_MAX))
    few = F.col("ord") < 4
    absorbed = few | (~rising & (F.col("last") < ABSORB_CEILING))
    rows = rows.withColumn("forced", ~decided).withColumn("absorbed", absorbed)
    rows = rows.filter(~F.col("forced") | F.col("at_end"))
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), "ord").alias("v"))
    v = lambda c: F.col(f"v.{c}")
    growth = F.greatest(F.coalesce(v("slope"), F.lit(1e-6)), F.lit(1e-6))
    ahead = F.greatest(F.log(F.lit(SERVICE_DEPARTURE) / F.greatest(v("last"), F.lit(1e-9))) / growth, F.lit(0.0))
    page = ~v("absorbed")
    return first.select(
        *keys,
        v("ord").alias("decided_at"),
        v("forced").alias("forced"),
        F.when(page, F.lit("maintenance")).otherwise(F.lit("absorbed")).alias("disposition"),
        F.when(v("absorbed"), F.when(v("ord") < 4, v("mean")).otherwise(v("last"))).alias("plateau_sigma"),
        F.when(page, growth).alias("growth_per_h"),
        F.when(page, F.lit(math.log(2.0)) / growth).alias("doubling_h"),
        F.when(page, v("t") + ahead).alias("service_by_h"),
    )


# -- revolutions and the coding-cost meter ------------------------------------------------------
def revolutions(length: Column, f_hz: Column, drift: Column, sr: Column) -> dict[str, Column]:
    """Revolution number and phase fraction of sample ``n`` under a linear speed drift."""
    t = F.col("n") / sr
    phi = f_hz * t + F.lit(0.5) * drift * t * (t - length / sr)
    return {
        "rev": F.floor(F.greatest(phi, F.lit(0.0))).cast("long"),
        "frac": phi - F.floor(phi),
    }


def revolution_states(revs: Series, sr: float, start_h: str = "t_h") -> Series:
    """Loudness, pitch proxy, bits per sample and running time of each revolution."""
    dt = F.col("n_samples") / F.lit(float(sr)) / 3600.0
    out = revs.running(end=-1, gone=("sum", dt))
    return out.with_columns(
        t=F.col(start_h) + F.coalesce(F.col("gone"), F.lit(0.0)),
        a=20.0 * F.log10(F.greatest(F.col("rms_fs"), F.lit(1e-9))),
        i=12.0 * F.log2(F.greatest(F.col("zcr_hz"), F.lit(1.0)) / 1000.0),
        bits_per_sample=F.col("bits") / F.greatest(F.col("n_samples"), F.lit(1)),
    )


def _fold_windows(splat: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means with varying weights, scaled by the product of the kept shares (a sum of logs)."""
    hit = F.col("wsum") > 1e-12
    eta = F.greatest(F.lit(1.0) / (F.col("n") + 1), F.lit(EMA_WEIGHT))
    w = Window.partitionBy(*keys, "bin").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(hit & (F.col("n") > 0), F.log(F.lit(1.0) - eta)).otherwise(F.lit(0.0))
    splat = splat.withColumn("scale", F.sum(kept).over(upto))
    share = F.when(hit, eta * F.col("acc") / F.col("wsum") * F.exp(-F.col("scale")))
    prior = F.coalesce(F.sum(share).over(before) * F.exp(F.sum(kept).over(before)), F.lit(0.0))
    return splat.withColumn("prior", prior).select(*keys, "rev", "bin", "prior")


def _fold_rule(splat: DataFrame, keys: list[str]) -> DataFrame:
    """The same fold row by row for bursts too long for the scaled sums.

    A block of revolutions forgets where it started, so blocks settle after two rounds.
    """
    emits = Emits(T.StructType([T.StructField("n", T.LongType()), T.StructField("prior", T.DoubleType())]))

    def fold(pdf: pd.DataFrame, state: list | None):
        held = state[0] if state else 0.0
        prior = np.empty(len(pdf))
        rows = zip(pdf["n"].to_numpy(), pdf["acc"].to_numpy(), pdf["wsum"].to_numpy())
        for at, (n, acc, weight) in enumerate(rows):
            prior[at] = held
            if weight > 1e-12:
                held += max(1.0 / (n + 1), EMA_WEIGHT) * (acc / weight - held)
        return pd.DataFrame({"n": pdf["n"].to_numpy(), "prior": prior}), [float(held)]

    series = Series(splat.select(*keys, "bin", "n", "acc", "wsum"), (*keys, "bin")).reblocked()
    return run_rule(series, fold, emits)


def _fold_bursts(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Adds ``pred`` to the rows of bursts that fit a task, one burst after the other: no copies of rows and no joins."""

    def fold(table: pa.Table) -> pa.Table:
        rev, j0, j1, u = (table[c].to_numpy() for c in ("rev", "j0", "j1", "u"))
        known = table[x].is_valid().to_numpy()
        v = np.where(known, table[x].cast(pa.float64()).to_numpy(), 0.0)
        turns, r = np.unique(rev, return_inverse=True)
        order = np.argsort(r, kind="stable")
        width = int(max(j0.max(), j1.max())) + 1
        pool, pred = np.zeros(width), np.empty(len(rev))
        for first in range(0, len(turns), FOLD_STEP):
            size = min(FOLD_STEP, len(turns) - first)
            at = order[slice(*np.searchsorted(r, [first, first + size], sorter=order))]
            sides = [((r[at] - first) * width + j, w) for j, w in ((j0[at], 1.0 - u[at]), (j1[at], u[at]))]
            total = lambda f: sum(np.bincount(cell, f(w), size * width) for cell, w in sides).reshape(size, width)  # noqa: E731, B023
            acc, weight = total(lambda w: v[at] * w), total(lambda w: w)  # noqa: B023
            hit = (weight > 1e-12) & (total(lambda w: known[at]) > 0)  # noqa: B023
            mean = np.divide(acc, weight, out=np.zeros_like(acc), where=hit)
            eta = np.maximum(1.0 / (first + np.arange(size) + 1), EMA_WEIGHT)
            prior = np.empty((size, width))
            for k in range(size):
                prior[k] = pool
                pool = np.where(hit[k], pool + eta[k] * (mean[k] - pool), pool)
            pred[at] = sum(prior.ravel()[cell] * w for cell, w in sides)
        return table.append_column("pred", pa.array(pred))

    return rows.groupBy(*keys).applyInArrow(fold, T.StructType([*rows.schema, T.StructField("pred", T.DoubleType())]))


def phase_average(samples: DataFrame, keys: list[str], grid: Column, x: str = "x", fits: bool = False) -> DataFrame:
    """Adds ``pred``: the sample predicted from the running mean of earlier revolutions.

    Needs ``n, rev, frac``. Samples are splatted linearly on a circular grid, averaged per
    (revolution, bin), folded over revolutions with weight max(1/r, 1/64), and read back with the
    same linear weights. The first revolution predicts 0; a bin missed in a revolution keeps its
    value. ``fits`` says that every burst fits one task (the plain layout); rows that are dealt by key already aren't
    shuffled again then.
    """
    g = F.col("frac") * grid
    rows = samples.withColumn("j0", (F.floor(g) % grid).cast("int")).withColumn("u", g - F.floor(g))
    rows = rows.withColumn("j1", ((F.col("j0") + 1) % grid).cast("int"))
    if fits:
        return _fold_bursts(rows, keys, x).drop("j0", "j1", "u")
    sides = F.inline(
        F.array(
            F.struct(F.col("j0").alias("bin"), (F.lit(1.0) - F.col("u")).alias("wt")),
            F.struct(F.col("j1").alias("bin"), F.col("u").alias("wt")),
        )
    )
    splat = rows.select(*keys, "rev", x, sides).groupBy(*keys, "rev", "bin").agg(
        F.sum(F.col(x) * F.col("wt")).alias("acc"), F.sum("wt").alias("wsum")
    )
    # Revolutions are numbered without gaps; the number decides the weight of each one.
    seen = index_series(rows.select(*keys, "rev").distinct(), keys, ["rev"]).df.select(*keys, "rev", "n")
    splat = splat.join(seen, [*keys, "rev"])
    longest = seen.agg(F.max("n")).first()[0] or 0
    if longest < FOLD_REVS:
        pool = _fold_windows(splat, keys)
    else:
        pool = _fold_rule(splat, keys).join(seen, [*keys, "n"]).select(*keys, "rev", "bin", "prior")
    side = lambda name: pool.select(*keys, "rev", F.col("bin").alias(name), F.col("prior").alias(f"at_{name}"))
    both = rows.join(side("j0"), [*keys, "rev", "j0"]).join(side("j1"), [*keys, "rev", "j1"])
    pred = F.col("at_j0") * (1 - F.col("u")) + F.col("at_j1") * F.col("u")
    return both.withColumn("pred", pred).drop("at_j0", "at_j1", "j0", "j1", "u")


def rice_cost(residuals: DataFrame, keys: list[str], position: str, residual: str, **sums: Column) -> DataFrame:
    """Bits per group under the best parameter of every block of up to 256 residuals, and ``sums`` over its rows.

    The 17 parameters are 17 partial sums of one aggregate, so rows are not multiplied.
    """
    block = F.floor(F.col(position) / RICE_BLOCK)
    rows = residuals.withColumn("coded", zigzag(F.col(residual).cast("long"))).withColumn("rice_block", block)
    costs = [F.sum(rice_bits(F.col("coded"), k)) for k in RICE_PARAMETERS]
    others = [F.sum(c).alias(k) for k, c in sums.items()]
    blocks = rows.groupBy(*keys, "rice_block").agg((F.least(*costs) + RICE_HEADER_BITS).alias("bits"), *others)
    return blocks.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("bits", *sums)])


def quantiser_step(eps_fs: float) -> int:
    """Step in counts whose rounding keeps the error within ``eps_fs`` of full scale."""
    return max(1, math.floor(2.0 * eps_fs * FULL_SCALE))


def round_away(v: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.floor(np.abs(v) + 0.5)


def _rice_bits(residuals: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bits of every stretch between ``cuts``, each in blocks of up to 256 residuals under their best parameter."""
    u = np.where(residuals >= 0, 2 * residuals, -2 * residuals - 1).astype(np.int64)
    first = [np.arange(lo, hi, RICE_BLOCK) for lo, hi in zip(cuts[:-1], cuts[1:])]
    starts = np.concatenate(first)
    least = np.full(len(starts), np.iinfo(np.int64).max)
    for k in RICE_PARAMETERS:
        q = u >> k
        least = np.minimum(least, np.add.reduceat(np.where(q >= 32, 50, q + 1 + k), starts))
    return np.add.reduceat(RICE_HEADER_BITS + least, np.cumsum([0, *map(len, first[:-1])]))


def meter_burst(x: np.ndarray, sr: float, f_hz: float, drift: float, q: int) -> tuple[pd.DataFrame, float]:
    """Cost of one burst, revolution by revolution, and the largest error (share of full scale).

    The prediction only changes between revolutions, so each revolution is one vector step.
    """
    n = len(x)
    grid_size = max(8, previous_power_of_two(int(sr / f_hz)))
    t = np.arange(n) / sr
    phi = f_hz * t + 0.5 * drift * t * (t - n / sr)
    rev = np.floor(np.maximum(phi, 0.0)).astype(np.int64)
    g = (phi - np.floor(phi)) * grid_size
    j0 = np.floor(g).astype(np.int64) % grid_size
    j1, u = (j0 + 1) % grid_size, g - np.floor(g)
    cuts = np.array([0, *(np.flatnonzero(np.diff(rev)) + 1), n])
    pool = np.zeros(grid_size)
    samples = x.astype(np.int64)
    coded = np.zeros(n)
    worst = 0.0
    for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        xs, a, b, w = samples[lo:hi], j0[lo:hi], j1[lo:hi], u[lo:hi]
        pred = round_away(pool[a] * (1 - w) + pool[b] * w)
        coded[lo:hi] = round_away((xs - pred) / q)
        recon = np.clip(pred + coded[lo:hi] * q, -32768, 32767)
        worst = max(worst, float(np.abs(xs - recon).max()) / FULL_SCALE)
        acc = np.bincount(a, recon * (1 - w), grid_size) + np.bincount(b, recon * w, grid_size)
        weight = np.bincount(a, 1 - w, grid_size) + np.bincount(b, w, grid_size)
        hit = weight > 1e-12
        pool[hit] += max(1.0 / (r + 1), EMA_WEIGHT) * (acc[hit] / weight[hit] - pool[hit])
    count = np.diff(cuts)
    flips = np.diff(np.where(samples >= 0, 1, -1), prepend=0) != 0
    flips[cuts[:-1]] = False  # a crossing lies within a revolution
    columns = {
        "rev": np.arange(len(count)),
        "bits": _rice_bits(coded, cuts),
        "n_samples": count,
        "rms_fs": np.sqrt(np.add.reduceat(samples.astype(float) ** 2, cuts[:-1]) / count) / FULL_SCALE,
        "zcr_hz": 0.5 * np.add.reduceat(flips.astype(np.int64), cuts[:-1]) * sr / count,
    }
    return pd.DataFrame(columns), worst


REV_TYPE = T.StructType(
    [
        T.StructField("rev", T.LongType()),
        T.StructField("bits", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("rms_fs", T.DoubleType()),
        T.StructField("zcr_hz", T.DoubleType()),
    ]
)
METRIC_FIELDS = [
    "f_hz", "drift", "bits_exact", "bits_bounded", "bits_packed", "rms_fs", "kurtosis", "crest", "line_strength", "max_err_fs",
]


def packed_bits(x: np.ndarray) -> float:
    """Bits per sample of the general-purpose compressor on the raw 16-bit samples."""
    raw = x.astype("<i2").tobytes()
    return len(zlib.compress(raw, 9)) * 8.0 / len(x)


def _steady(revs: pd.DataFrame) -> float | None:
    late = revs.iloc[WARMUP_REVS:]
    return float(late["bits"].sum() / late["n_samples"].sum()) if len(late) else None


def _line(x: np.ndarray, sr: float, hz: float) -> float:
    envelope = _envelope(x, sr, 0.2, 0.6)
    mags = _burst_magnitudes(envelope - envelope.mean())
    df = sr / len(envelope)
    lo, hi = max(1, math.floor(hz * 0.975 / df)), min(math.ceil(hz * 1.025 / df), len(mags) - 1)
    if lo >= hi:
        return 0.0
    rest = np.sort(mags[1:])
    return float(mags[lo : hi + 1].max() / max(rest[len(rest) // 2], 1e-12))


def plain_indicators(x: Column) -> dict[str, Column]:
    """RMS (share of full scale), raw kurtosis and crest factor of a burst ``array<int>``.

    A burst without spread has no kurtosis, one of zeros no crest factor: both are NULL.
    """
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    size = F.size(x)
    mean = total(x) / size
    moment = lambda k: total(F.transform(x, lambda y: F.pow(y - mean, F.lit(k)))) / size
    m2, m4 = moment(2.0), moment(4.0)
    rms = F.sqrt(total(F.transform(x, lambda y: y.cast("double") * y)) / size)
    return {
        "rms_fs": rms / FULL_SCALE,
        "kurtosis": F.when(F.array_max(x) > F.array_min(x), m4 / (m2 * m2)),
        "crest": F.when(rms > 0, F.array_max(F.transform(x, lambda y: F.abs(y.cast("long")))) / rms),
    }


def snapshot_metrics(bursts: DataFrame, watch_order: float, eps_fs: float = 0.001, tolerance: float = 0.05) -> DataFrame:
    """One metrics row per burst ``x array<int>, sr, f_nominal``, plus the bounded revolutions.

    Bursts are independent, so this is a plain map over the partitions Spark already has.
    """
    schema = T.StructType(
        [f for f in bursts.schema if f.name != "x"]
        + [T.StructField(name, T.DoubleType()) for name in METRIC_FIELDS]
        + [T.StructField("revs", T.ArrayType(REV_TYPE))]
    )
    q = quantiser_step(eps_fs)

    def one(x: np.ndarray, wave: np.ndarray, sr: float, f_hz: float, drift: float) -> dict:
        exact, _ = meter_burst(x, sr, f_hz, drift, 1)
        bounded, worst = meter_burst(x, sr, f_hz, drift, q)
        level = math.sqrt(float((wave**2).mean()))
        m = wave - wave.mean()
        m2 = float((m**2).mean())
        return {
            "f_hz": f_hz,
            "drift": drift,
            "bits_exact": _steady(exact),
            "bits_bounded": _steady(bounded),
            "bits_packed": packed_bits(x),
            "rms_fs": level / FULL_SCALE,
            "kurtosis": float((m**4).mean()) / (m2 * m2) if m2 else 0.0,
            "crest": float(np.abs(wave).max()) / level if level else 0.0,
            "line_strength": _line(wave, sr, watch_order * f_hz),
            "max_err_fs": worst,
            "revs": [dict(zip(bounded.columns, row)) for row in zip(*(bounded[c].tolist() for c in bounded.columns))],
        }

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, waves, sr in stacks(pdf):
                speeds = refine_speeds(waves, sr, part["f_nominal"].to_numpy(dtype=float), tolerance)
                found = [one(np.asarray(x), wave, sr, float(f), float(d)) for x, wave, f, d in zip(part["x"], waves, *speeds)]
                out = part.drop(columns="x").reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame(found, columns=[*METRIC_FIELDS, "revs"])], axis=1)[schema.fieldNames()]

    return bursts.mapInPandas(each, schema)


# -- lines, components, angle -------------------------------------------------------------------
def line_strength(mag: Column, df: float, hz: Column) -> Column:
    """Largest bin within 2.5 % of a frequency over the upper-middle bin; 0 when the window is empty."""
    bins = F.size(mag)
    lo = F.greatest(F.floor(hz * 0.975 / F.lit(df)), F.lit(1)).cast("int")
    hi = F.least(F.ceil(hz * 1.025 / F.lit(df)), bins - 1).cast("int")
    rest = F.array_sort(F.slice(mag, F.lit(2), bins - 1))
    middle = F.greatest(F.element_at(rest, (F.floor((bins - 1) / 2) + 1).cast("int")), F.lit(1e-12))
    peak = F.array_max(F.slice(mag, lo + 1, F.greatest(hi - lo + 1, F.lit(0))))
    return F.when(lo < hi, peak / middle).otherwise(F.lit(0.0))


def component_scores(spectra: DataFrame, mag: str, df: float, shaft_hz: Column, spec: tuple) -> DataFrame:
    """Best component, its score and its margin over the runner-up.

    The inner race gets half credit for its two shaft sidebands, the rolling element for its
    second harmonic.
    """
    _, _, outer, inner, ball, cage = spec
    line = lambda order: line_strength(F.col(mag), df, F.lit(float(order)) * shaft_hz)
    scores = {
        "outer race": line(outer),
        "inner race": line(inner) + F.lit(0.5) * (line(inner - 1.0) + line(inner + 1.0)),
        "rolling element": line(ball) + F.lit(0.5) * line(2.0 * ball),
        "cage": line(cage),
    }
    ranked = F.array(
        *[
            F.struct(s.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("component"))
            for place, (name, s) in enumerate(scores.items())
        ]
    )
    out = spectra.withColumn("ranked", F.sort_array(ranked, asc=False))
    best, second = F.element_at("ranked", 1), F.element_at("ranked", 2)
    return out.withColumns(
        {
            "component": best["component"],
            "score": best["score"],
            "margin": best["score"] / F.greatest(second["score"], F.lit(1e-12)),
        }
    ).drop("ranked")


def impact_angle(samples: Series, envelope: str = "env", frac: str = "frac") -> DataFrame:
    """Angle (degrees from the load zone) of the impact energy above the mean, and its confidence."""
    keys = list(samples.keys)
    rows = samples.stats(floor=F.avg(envelope)).df
    wt = F.pow(F.greatest(F.col(envelope) - F.col("floor"), F.lit(0.0)), 2)
    turn = F.lit(2.0 * math.pi) * F.col(frac)
    sums = rows.groupBy(*keys).agg(
        F.sum(wt * F.cos(turn)).alias("c"), F.sum(wt * F.sin(turn)).alias("s"), F.sum(wt).alias("total")
    )
    some = F.col("total") > 0
    return sums.select(
        *keys,
        F.when(some, F.pmod(-F.degrees(F.atan2("s", "c")), F.lit(360.0))).otherwise(F.lit(0.0)).alias("angle_deg"),
        F.when(some, F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("total")).otherwise(F.lit(0.0)).alias("confidence"),
    )


# -- the monitor --------------------------------------------------------------------------------
EVENTS = Emits(
    T.StructType(
        [
            T.StructField("t_detect_h", T.DoubleType()),
            T.StructField("detect_rev", T.LongType()),
            T.StructField("t_onset_h", T.DoubleType()),
            T.StructField("component", T.StringType()),
            T.StructField("margin", T.DoubleType()),
            T.StructField("angle_deg", T.DoubleType()),
            T.StructField("angle_confidence", T.DoubleType()),
            T.StructField("departure_sigma", T.DoubleType()),
            T.StructField("disposition", T.StringType()),
            T.StructField("plateau_sigma", T.DoubleType()),
            T.StructField("growth_per_h", T.DoubleType()),
            T.StructField("doubling_h", T.DoubleType()),
            T.StructField("service_by_h", T.DoubleType()),
        ]
    )
)
LATCHED = ["latched"]


def verdict(t: list[float], d: list[float], forced: bool) -> dict | None:
    """The disposition of a candidate on the departures so far, or None while it must wait."""
    n, level = len(d), np.asarray(d, dtype=float)
    threes = np.convolve(level, np.full(3, 1 / 3), "valid") if n >= 3 else level
    # The newest mean of three against the one six rows back, or against the first there is.
    last = float(threes[-1])
    rising = n >= 4 and last / max(float(threes[max(n - 9, 0)]), 0.05) >= RISE_RATIO
    if not forced and (n < CONFIRM_MIN or (rising and n < CONFIRM_MAX)):
        return None
    if n < 4 or (not rising and last < ABSORB_CEILING):
        return {"disposition": "absorbed", "plateau_sigma": last if n >= 4 else float(level.mean())}
    hours, logs = np.asarray(t[-12:], dtype=float), np.log(np.maximum(level[-12:], 0.05))
    off = hours - hours.mean()
    growth = max(float(off @ logs / (off @ off)) if off.any() else 0.0, 1e-6)
    ahead = math.log(SERVICE_DEPARTURE / max(last, 1e-9)) / growth
    out = {"growth_per_h": growth, "doubling_h": math.log(2.0) / growth, "service_by_h": t[-1] + max(ahead, 0.0)}
    return {"disposition": "maintenance", **out}


ADDRESS = ["component", "margin", "angle_deg", "angle_confidence"]


def reflected(before: float, steps: np.ndarray) -> np.ndarray:
    """max(0, value + step) along the steps: the running sum less its lowest point below zero."""
    total = before + np.cumsum(steps)
    return total - np.minimum(np.minimum.accumulate(total), 0.0)


def _event(case: dict, found: dict) -> dict:
    facts = {c: case[c] for c in ("t_detect_h", "detect_rev", "t_onset_h", *ADDRESS)}
    facts["angle_confidence"] = facts["angle_confidence"] or 0.0
    return {**dict.fromkeys(EVENTS.names), **facts, "departure_sigma": case["d"][-1], **found}


def _watching(mu: float, sigma: float) -> list:
    return ["watch", {"mu": mu, "sigma": sigma, "s": 0.0, "w": 0.0, "onset": None}]


def _watch(now: dict, snap: dict, z: np.ndarray) -> list:
    """Both walks over the revolutions of a snapshot; the first alarm opens a case."""
    s, w = reflected(now["s"], z - CUSUM_SLACK), reflected(now["w"], z)
    alarm = int((s >= CUSUM_THRESHOLD).argmax()) if (s >= CUSUM_THRESHOLD).any() else None
    seen = slice(None if alarm is None else alarm + 1)
    leaves_zero = np.flatnonzero(((w > 0) & (np.concatenate([[now["w"]], w[:-1]]) == 0))[seen])
    onset = float(snap["rev_t"][leaves_zero[-1]]) if len(leaves_zero) else now["onset"]
    if alarm is None:
        return ["watch", {**now, "s": float(s[-1]), "w": float(w[-1]), "onset": onset}]
    t = float(snap["rev_t"][alarm])
    case = {"t_detect_h": t, "detect_rev": int(snap["rev_base"]) + alarm, "t_onset_h": t if onset is None else onset}
    case.update({c: snap.get(c) for c in ADDRESS}, t=[float(snap["rev_t"][0])], d=[float(z.mean())])
    return ["case", {"mu": now["mu"], "sigma": now["sigma"], **case}]


def _follow(case: dict, snap: dict, z: np.ndarray) -> tuple[list, dict | None]:
    """One more departure of an open case, the clearer address of the two, and its verdict."""
    case = {**case, "t": [*case["t"], float(snap["rev_t"][0])], "d": [*case["d"], float(z.mean())]}
    if (snap.get("margin") or 0.0) > (case["margin"] or 0.0):
        angle = ADDRESS[2:] if snap.get("angle_deg") is not None else []
        case.update({c: snap[c] for c in [*ADDRESS[:2], *angle]})
    found = verdict(case["t"], case["d"], forced=False)
    if found is None:
        return ["case", case], None
    if found["disposition"] == "maintenance":
        return LATCHED, _event(case, found)
    # What was absorbed is the new normal.
    return _watching(case["mu"] + case["sigma"] * float(np.mean(case["d"][-6:])), max(case["sigma"], 1e-12)), _event(case, found)


def monitor_step(state: list | None, snap: dict) -> tuple[list, dict | None]:
    """One snapshot: ``mu, sigma, rev_t[], rev_bits[], rev_base, component, margin, angle...``.

    A state is ["watch", walks], ["case", candidate] or ["latched"].
    """
    state = state or _watching(snap["mu"], max(snap["sigma"], 1e-9))
    if state == LATCHED or len(snap["rev_bits"]) == 0:
        return state, None
    z = (np.asarray(snap["rev_bits"], dtype=float) - state[1]["mu"]) / state[1]["sigma"]
    if state[0] == "watch":
        return _watch(state[1], snap, z), None
    return _follow(state[1], snap, z)


def monitor_close(state: list | None) -> list[dict]:
    """An open candidate at the end of the record is judged on what there is."""
    if not state or state[0] != "case":
        return []
    return [_event(state[1], verdict(state[1]["t"], state[1]["d"], forced=True))]


def _clean(snap: dict) -> dict:
    return {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in snap.items()}


def _monitor_rule(pdf: pd.DataFrame, state: list | None):
    events = []
    for snap in pdf.to_dict("records"):
        if not snap["in_reference"]:
            state, event = monitor_step(state, _clean(snap))
            if event:
                events.append(event)
    return pd.DataFrame(events, columns=EVENTS.names), state


def monitor_input(snapshots: Series, reference_snapshots: int = 30) -> tuple[Series, list[str]]:
    """What the monitor reads per snapshot, and the names of those columns.

    Mean and spread over the revolutions of the reference stretch are whole-series aggregates; the
    number of revolutions before a snapshot is a running sum.
    """
    early = F.col("n") < reference_snapshots
    rev = F.col("rev_bits")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, b: s + b)
    part = lambda v: F.sum(F.when(early, v))
    rows = snapshots.running(end=-1, rev_base=("sum", F.size(rev).cast("long")))
    rows = rows.with_columns(rev_base=F.coalesce("rev_base", F.lit(0)), in_reference=early)
    rows = rows.stats(ref_sum=part(total(rev)), ref_revs=part(F.size(rev).cast("double")))
    rows = rows.with_columns(mu=F.col("ref_sum") / F.col("ref_revs"))
    off = total(F.transform(rev, lambda b: (b - F.col("mu")) * (b - F.col("mu"))))
    rows = rows.with_columns(off=off).stats(ref_off=part(F.col("off")))
    rows = rows.with_columns(sigma=F.sqrt(F.col("ref_off") / F.col("ref_revs")))
    address = [c for c in ("component", "margin", "angle_deg", "angle_confidence") if c in rows.df.columns]
    columns = ["mu", "sigma", "rev_t", "rev_bits", "rev_base", *address]
    return Series(rows.df.select(*rows._cell, "n", "in_reference", *columns), rows.keys, rows.block), columns


def monitor(snapshots: Series, reference_snapshots: int = 30) -> DataFrame:
    """Defect events of every machine.

    ``snapshots`` carries ``rev_t, rev_bits`` arrays and the localisation of each snapshot, which
    is computed for every snapshot on its own.
    """
    slim, _ = monitor_input(snapshots, reference_snapshots)
    close = lambda state: pd.DataFrame(monitor_close(state), columns=EVENTS.names)
    return run_rule(slim, _monitor_rule, EVENTS, close, final=LATCHED)


# The text form of an event (field order and digits).
EVENT_FORMAT = (
    '{"object":"defect_event","row_n":%d,"t_detect_h":%.4f,"t_onset_est_h":%.4f,"component":"%s",'
    '"component_margin":%.2f,"angle_deg_from_load_zone":%s,"angle_confidence":%.2f,"departure_sigma":%.1f,'
    '"disposition":"%s",%s}'
)
MAINTENANCE_FORMAT = '"growth_per_h":%.4f,"doubling_h":%.2f,"service_by_h":%.2f'
ABSORBED_FORMAT = '"plateau_sigma":%.1f'


def event_json() -> Column:
    """One JSON object per event row, with the digits each field carries."""
    paged = F.col("disposition") == "maintenance"
    detail = F.when(paged, F.format_string(MAINTENANCE_FORMAT, "growth_per_h", "doubling_h", "service_by_h")).otherwise(
        F.format_string(ABSORBED_FORMAT, "plateau_sigma")
    )
    kind = F.when(paged, F.lit("maintenance_request")).otherwise(F.lit("absorbed_stable"))
    angle = F.when(F.col("angle_deg").isNull(), F.lit("null")).otherwise(F.format_string("%.1f", "angle_deg"))
    return F.format_string(
        EVENT_FORMAT, "detect_rev", "t_detect_h", "t_onset_h", "component", "margin", angle, "angle_confidence",
        "departure_sigma", kind, detail,
    )
