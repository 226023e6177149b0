"""Framing, spectra and the per-frame features derived from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import EPS, decibels, doubles, semitones
from seriesloom.operators.dynamics import calibration, standardise
from seriesloom.plans.fourier import peak_autocorrelation, power_spectrum
from seriesloom.plans.selection import exact_median, pick_rank
from seriesloom.plans.series import Series

# The five energy bands in Hz.
BANDS = [
    ("sub", 20.0, 60.0),
    ("low", 60.0, 250.0),
    ("mid", 250.0, 2000.0),
    ("himid", 2000.0, 8000.0),
    ("hi", 8000.0, 20000.0),
]


# -- framing ------------------------------------------------------------------------------------
def frame_rows(samples: Series, win: int, hop: int) -> DataFrame:
    """Long form of overlapping full frames: one row per (frame, sample) with the offset ``j``.

    A sample only knows which frames could hold it; frames that run past the end are dropped by the
    series length, so no row is ever padded.
    """
    sized = samples.stats(length=F.count(F.lit(1)))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - win + 1) / hop)).cast("long")
    last = F.least(F.floor(F.col("n") / hop), F.floor((F.col("length") - win) / hop)).cast("long")
    rows = sized.df.filter(F.col("length") >= win)
    rows = rows.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.withColumn("j", (F.col("n") - F.col("frame") * hop).cast("int"))


def frame_arrays(samples: Series, win: int, hop: int, value: str = "x") -> DataFrame:
    """``keys, n, x array<double>``: full frames as arrays of ``win`` values, in order."""
    rows = frame_rows(samples, win, hop)
    packed = rows.groupBy(*samples.keys, "frame").agg(F.array_sort(F.collect_list(F.struct("j", value))).alias("packed"))
    return packed.select(
        *samples.keys,
        F.col("frame").alias("n"),
        F.transform("packed", lambda p: p[value].cast("double")).alias("x"),
    )


def frame_loudness(samples: Series, win: int, hop: int, floor_db: float = -80.0, value: str = "x") -> DataFrame:
    """Loudness per frame without building arrays."""
    rows = frame_rows(samples, win, hop)
    mean_square = F.avg(F.col(value).cast("double") * F.col(value).cast("double"))
    return rows.groupBy(*samples.keys, F.col("frame").alias("n")).agg(decibels(mean_square, floor_db).alias("a"))


def hann(n: int, periodic: bool = False) -> list[float]:
    """Symmetric (audio) or periodic (vibration) Hann window."""
    span = n if periodic else n - 1
    return [0.5 - 0.5 * math.cos(2.0 * math.pi * j / span) for j in range(n)]


def hann_at(j: Column, n: int, periodic: bool = False) -> Column:
    span = float(n if periodic else n - 1)
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0 * math.pi) * j / F.lit(span))


def windowed(x: Column, n: int, periodic: bool = False) -> Column:
    """An array times its Hann window."""
    return F.transform(x, lambda v, j: v * hann_at(j, n, periodic))


# -- spectra ------------------------------------------------------------------------------------
def magnitudes(win: int, periodic: bool = False):
    """Vectorised UDF: magnitude spectrum (win // 2 + 1 bins) of arrays of ``win`` values."""
    shape = np.asarray(hann(win, periodic))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def spectrum(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype=object)
        stacked = np.vstack([np.asarray(v, dtype=np.float64) for v in x])
        return pd.Series(list(np.abs(np.fft.rfft(stacked * shape, axis=1))))

    return spectrum


def dft_magnitudes(x: Column, win: int, bins: list[int], periodic: bool = False) -> Column:
    """A few named bins as JVM-side sums (for short windows; the UDF is faster for full spectra)."""
    w = hann(win, periodic)

    def part(k: int, wave) -> Column:
        weights = [w[j] * wave(2.0 * math.pi * k * j / win) for j in range(win)]
        basis = F.array(*[F.lit(v) for v in weights])
        return F.aggregate(F.zip_with(x, basis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return F.array(*[F.sqrt(F.pow(part(k, math.cos), 2) + F.pow(part(k, math.sin), 2)) for k in bins])


def previous_power_of_two(n: int) -> int:
    return 1 << (max(int(n), 1).bit_length() - 1)


def _burst_magnitudes(x: np.ndarray) -> np.ndarray:
    n = len(x)
    return np.abs(np.fft.rfft(x * np.asarray(hann(n, periodic=True))))[: n // 2]


def band_envelope(lo_share: float = 0.2, hi_share: float = 0.6):
    """Vectorised UDF ``(x, sr)``: magnitude of the analytic signal inside a share of Nyquist."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def envelope(x: pd.Series, sr: pd.Series) -> pd.Series:
        return pd.Series([_envelope(np.asarray(v, dtype=np.float64), r, lo_share, hi_share) for v, r in zip(x, sr)])

    return envelope


def _envelope(x: np.ndarray, sr: float, lo_share: float, hi_share: float) -> np.ndarray:
    n = len(x)
    spectrum = np.fft.fft(x)
    freqs = np.arange(n) * (sr / n)
    inside = (freqs >= lo_share * sr / 2) & (freqs <= hi_share * sr / 2) & (np.arange(n) <= n // 2)
    return np.abs(np.fft.ifft(np.where(inside, 2.0 * spectrum, 0.0)))


# -- spectral centre ----------------------------------------------------------------------------
def spectral_centre(spectra: Series, bin_hz: float, reference: float = 440.0, gate: float = 1e-2, mag: str = "mag") -> Series:
    """Centroid in semitones; frames below 1 % of the median positive energy hold the last valid one."""
    m = doubles(F.col(mag))
    total = F.aggregate(m, F.lit(0.0), lambda s, v: s + v)
    moment = F.aggregate(F.transform(m, lambda v, k: v * k * F.lit(bin_hz)), F.lit(0.0), lambda s, v: s + v)
    rows = spectra.with_columns(energy=total, moment=moment)
    loud = rows.df.filter("energy > 0").select(*rows.keys, "energy")
    rows = rows.attach(exact_median(loud, list(rows.keys), "energy", "mid_energy"), "left")
    valid = F.col("energy") > F.lit(gate) * F.coalesce(F.col("mid_energy"), F.lit(0.0))
    pitch = semitones(F.col("moment") / F.col("energy"), reference)
    rows = rows.running(held=("last", F.when(valid, pitch)))
    return rows.with_columns(i=F.coalesce(F.col("held"), F.lit(0.0))).with_columns(valid=valid)


def frame_calibration(spectra: Series, bin_hz: float, reference: float = 440.0, gate: float = 1e-2, mag: str = "mag") -> DataFrame:
    """The measuring pass over frames with a loudness ``a``: the energy gate of each series and, with the centroids it lets
    through, the calibration of its state (``dynamics.calibration``)."""
    rows = spectral_centre(spectra, bin_hz, reference, gate, mag)
    return calibration(rows, energy_thresh=F.lit(gate) * F.coalesce(F.col("mid_energy"), F.lit(0.0)))


# -- pitch classes ------------------------------------------------------------------------------
def pitch_weights(spark, bins: int, bin_hz: float, sigma: float = 0.5, reference: float = 440.0, classes: int = 12) -> DataFrame:
    """``bin, pc, w``: periodic Gaussian on the pitch-class ring, each bin summing to one, DC zero.

    Built from one row per bin, so its size is the (fixed) number of bins times 12.
    """
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    grid = grid.withColumn("pc", F.explode(F.array(*[F.lit(c) for c in range(classes)])))
    ring = F.pmod(F.lit(float(classes)) * F.log2(F.col("bin") * F.lit(bin_hz) / F.lit(reference)) - F.col("pc"), F.lit(float(classes)))
    away = F.least(ring, F.lit(float(classes)) - ring)
    raw = grid.filter("bin > 0").withColumn("raw", F.exp(-away * away / F.lit(2.0 * sigma * sigma)))
    sums = raw.groupBy("bin").agg(F.greatest(F.sum("raw"), F.lit(EPS)).alias("total"))
    weights = raw.join(sums, "bin").select("bin", "pc", (F.col("raw") / F.col("total")).alias("w"))
    silent = grid.filter("bin = 0").select("bin", "pc", F.lit(0.0).alias("w"))
    return weights.unionByName(silent)


def _pitch_matrix(bins: int, bin_hz: float, sigma: float, reference: float) -> np.ndarray:
    pitch = 12.0 * np.log2(np.arange(1, bins) * bin_hz / reference)
    ring = np.mod(pitch[:, None] - np.arange(12), 12)
    raw = np.exp(-(np.minimum(ring, 12 - ring) ** 2) / (2.0 * sigma**2))
    w = np.zeros((bins, 12))
    w[1:] = raw / np.clip(raw.sum(axis=1, keepdims=True), EPS, None)
    return w


def soft_chroma(bins: int, bin_hz: float, sigma: float = 0.5, reference: float = 440.0):
    """Vectorised UDF: magnitude array to 12 pitch-class energies (one matrix product per batch)."""
    weights = _pitch_matrix(bins, bin_hz, sigma, reference)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def chroma(mag: pd.Series) -> pd.Series:
        if mag.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.vstack([np.asarray(v, dtype=np.float64) for v in mag]) @ weights))

    return chroma


def chroma_long(spectra_long: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Relational form of the same product: join on the bin, sum per pitch class."""
    joined = spectra_long.join(F.broadcast(weights), "bin")  # weights: bins x 12 rows, fixed
    return joined.groupBy(*keys, "n", "pc").agg(F.sum(F.col("w") * F.col("mag")).alias("chroma"))


def hard_chroma(spectra_long: DataFrame, keys: list[str], bin_hz: float, reference: float = 440.0) -> DataFrame:
    """Every bin gives all its energy to the nearest pitch class."""
    pc = F.pmod(F.bround(12.0 * F.log2(F.col("bin") * F.lit(bin_hz) / F.lit(reference))), F.lit(12)).cast("int")
    rows = spectra_long.filter("bin > 0").withColumn("pc", pc)
    return rows.groupBy(*keys, "n", "pc").agg(F.sum("mag").alias("chroma"))


# -- bands --------------------------------------------------------------------------------------
def band_ranges(bins: int, bin_hz: float, bands=BANDS) -> list[tuple[str, int, int]]:
    """First bin at or above each edge, as half-open bin ranges."""
    at = lambda hz: min(bins, max(0, math.ceil(hz / bin_hz - 1e-12)))
    return [(name, at(lo), max(at(lo), at(hi))) for name, lo, hi in bands]


def band_levels(mag: Column, bins: int, bin_hz: float, bands=BANDS) -> dict[str, Column]:
    """Root energy per band straight from the magnitude array, no shuffle."""
    out = {}
    for name, lo, hi in band_ranges(bins, bin_hz, bands):
        part = F.slice(mag, lo + 1, hi - lo) if hi > lo else F.array().cast("array<double>")
        out[name] = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v))
    return out


def normalise_by_p98(series: Series, name: str, value: str) -> Series:
    """Divide by the value at sorted index min(int(0.98 n), n - 1), cap at 1."""
    rank = F.least(F.floor(F.col("rows") * 0.98), F.col("rows") - 1)
    p98 = pick_rank(series.df.select(*series.keys, value), list(series.keys), value, rank, "p98")
    out = series.attach(p98)
    level = F.least(F.col(value) / F.greatest(F.col("p98"), F.lit(1e-6)), F.lit(1.0))
    return out.with_columns(**{name: level})


def normalise_bands(series: Series, bands: list[str]) -> Series:
    """The same for several level columns, with one selection over (series, band)."""
    pairs = F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("level")) for b in bands]))
    long = series.df.select(*series.keys, pairs)
    rank = F.least(F.floor(F.col("rows") * 0.98), F.col("rows") - 1)
    p98 = pick_rank(long, [*series.keys, "band"], "level", rank, "p98")
    tops = [F.max(F.when(F.col("band") == b, F.col("p98"))).alias(f"p98_{b}") for b in bands]
    out = series.attach(p98.groupBy(*series.keys).agg(*tops))
    capped = {b: F.least(F.col(b) / F.greatest(F.col(f"p98_{b}"), F.lit(1e-6)), F.lit(1.0)) for b in bands}
    return out.with_columns(**capped)


def lagged_mean(series: Series, name: str, value: Column, past: int, recent: int) -> Series:
    """Mean over rows [n - past, n - recent), 0 until ``past`` rows have gone by."""
    mean = lambda w: F.avg(value).over(w.rowsBetween(-past, -recent - 1))
    gated = lambda w: F.when(F.col("n") > past, mean(w)).otherwise(F.lit(0.0))
    return series.around(past, 0, **{name: gated})


def decaying_trigger(series: Series, name: str, fired: Column, decay: float) -> Series:
    """1 where fired, then decaying by a constant factor per row; 0 before the first."""
    out = series.running(hit=("last", F.when(fired, F.col("n"))))
    age = F.col("n") - F.col("hit")
    return out.with_columns(**{name: F.coalesce(F.pow(F.lit(decay), age), F.lit(0.0))})


def bass_departure(
    series: Series, hop_s: float, sustained: float = 0.45, gone: float = 0.16, alive: float = 0.18
) -> Series:
    """Pulse when the lows were sustained, are gone now and the top is still alive.

    Needs the five held band levels as columns; row 0 never fires.
    """
    past = max(int(0.6 / hop_s), 2)
    recent = max(int(0.2 / hop_s), 1)
    bass = F.lit(0.4) * F.col("sub") + F.lit(0.6) * F.col("low")
    out = lagged_mean(series, "was_bass", bass, past, recent).with_columns(
        bass=bass, top=F.greatest(F.col("himid"), F.col("hi"))
    )
    fired = (F.col("n") > 0) & (F.col("was_bass") > sustained) & (F.col("bass") < gone) & (F.col("top") > alive)
    return decaying_trigger(out.with_columns(fired=fired), "drop", F.col("fired"), math.exp(-hop_s / 0.65))


def value_at(series_rows: DataFrame, probes: DataFrame, keys: list[str], position: str, value: str, length: DataFrame) -> DataFrame:
    """Linear interpolation at fractional, clamped positions: one equi-join per neighbour."""
    at = probes.join(length, keys).withColumn(
        "f", F.least(F.greatest(F.col(position), F.lit(0.0)), (F.col("length") - 1).cast("double"))
    )
    at = at.withColumn("n0", F.floor("f")).withColumn("n1", F.least(F.col("n0") + 1, F.col("length") - 1))
    low = series_rows.select(*keys, F.col("n").alias("n0"), F.col(value).alias("v0"))
    high = series_rows.select(*keys, F.col("n").alias("n1"), F.col(value).alias("v1"))
    both = at.join(low, [*keys, "n0"]).join(high, [*keys, "n1"])
    u = F.col("f") - F.col("n0")
    return both.withColumn("at_value", F.col("v0") + (F.col("v1") - F.col("v0")) * u)


# -- onset and tempo ----------------------------------------------------------------------------
def onset_strength(spectra: Series, mag: str = "mag") -> Series:
    """Positive spectral change summed over bins, minus its mean over the series."""
    rise = lambda w: F.coalesce(
        F.aggregate(
            F.zip_with(doubles(F.col(mag)), F.lag(doubles(F.col(mag))).over(w), lambda b, a: F.greatest(b - a, F.lit(0.0))),
            F.lit(0.0),
            lambda s, v: s + v,
        ),
        F.lit(0.0),
    )
    out = spectra.around(1, 0, flux=rise).stats(mean_flux=F.avg("flux"))
    return out.with_columns(onset=F.col("flux") - F.col("mean_flux"))


def lag_products(series: Series, value: str, lag_min: int, lag_max: int) -> DataFrame:
    """``keys, lag, ac``: autocorrelation sums for a band of lags.

    Each lag is one column over the same sort, so rows are never multiplied by the lags.
    """
    lags = range(lag_min, lag_max + 1)
    columns = {f"p{k}": (lambda w, k=k: F.col(value) * F.lag(value, k).over(w)) for k in lags}
    sums = series.around(lag_max, 0, **columns).totals(**{f"p{k}": F.sum(f"p{k}") for k in lags})
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"p{k}"), F.lit(0.0)).alias("ac")) for k in lags])
    return sums.select(*series.keys, F.inline(pairs))


def tempo(series: Series, fps: float, bpm_min: float = 60.0, bpm_max: float = 200.0, value: str = "onset") -> DataFrame:
    """Tempo from the strongest lag of the onset autocorrelation inside a tempo band.

    The confidence is the peak over the largest autocorrelation at any lag but zero. Series without
    variance or shorter than the band give NULL and 0.
    """
    lag_min = max(1, round(60.0 * fps / bpm_max))
    lag_max = round(60.0 * fps / bpm_min)
    keys = list(series.keys)
    facts = series.totals(length=F.count(F.lit(1)), spread=F.stddev_pop(value))
    facts = facts.join(peak_autocorrelation(series, value), keys)
    band = lag_products(series, value, lag_min, lag_max).join(facts, keys).filter("lag <= length - 1")
    best = band.groupBy(*keys).agg(
        F.max(F.struct(F.col("ac"), (-F.col("lag")).alias("back"))).alias("top"), F.count(F.lit(1)).alias("lags")
    )
    best = best.select(*keys, (-F.col("top.back")).alias("lag"), F.col("top.ac").alias("ac"), "lags")
    out = facts.join(best, keys, "left")
    usable = (F.col("spread") >= EPS) & (F.col("lags") > 1)
    return out.select(
        *keys,
        F.when(usable, F.lit(60.0 * fps) / F.col("lag")).alias("bpm"),
        F.when(usable, F.col("lag")).alias("lag"),
        F.when(usable, F.col("ac")).alias("ac"),
        F.when(usable, F.col("ac") / (F.col("peak") + F.lit(EPS))).otherwise(F.lit(0.0)).alias("confidence"),
    )


# -- resonance envelopes ------------------------------------------------------------------------
def resonance(frequency: Column, formants: list[tuple[float, float, float]]) -> Column:
    """Sum of Gaussian resonances ``(centre, width, gain)`` at a frequency."""
    out = F.lit(0.0)
    for centre, width, gain in formants:
        away = frequency - F.lit(float(centre))
        out = out + F.lit(float(gain)) * F.exp(-away * away / F.lit(2.0 * width * width))
    return out


def harmonics(rows: DataFrame, f0: Column, count: int, roll_off: float) -> DataFrame:
    """Harmonic series i * f0 with amplitude i ** -roll_off."""
    rows = rows.withColumn("harmonic", F.explode(F.array(*[F.lit(i) for i in range(1, count + 1)])))
    return rows.withColumn("frequency", F.col("harmonic") * f0).withColumn(
        "amplitude", F.pow(F.col("harmonic").cast("double"), F.lit(-float(roll_off)))
    )


def candidate_losses(rows: DataFrame, keys: list[str], parameter: str, grid: list[float], loss) -> DataFrame:
    """``keys, parameter, loss``: every candidate is one aggregate of the same pass over the rows."""
    sums = rows.groupBy(*keys).agg(*[loss(c).alias(f"loss_{k}") for k, c in enumerate(grid)])
    pairs = [F.struct(F.lit(c).alias(parameter), F.col(f"loss_{k}").alias("loss")) for k, c in enumerate(grid)]
    return sums.select(*keys, F.inline(F.array(*pairs)))


def grid_search(rows: DataFrame, keys: list[str], parameter: str, grid: list[float], loss) -> DataFrame:
    """The candidate with the least loss per group (the smallest on ties)."""
    scores = candidate_losses(rows, keys, parameter, grid, loss)
    best = scores.groupBy(*keys).agg(F.min(F.struct("loss", parameter)).alias("best"))
    return best.select(*keys, F.col(f"best.{parameter}").alias(parameter), F.col("best.loss").alias("loss"))


def local_minima(scores: DataFrame, keys: list[str], parameter: str, loss: str) -> DataFrame:
    """Candidates below both neighbours (the grid of one group is a fixed, short list)."""
    w = Window.partitionBy(*keys).orderBy(parameter)
    near = scores.withColumns({"lower": F.lag(loss).over(w), "upper": F.lead(loss).over(w)})
    return near.filter((F.col(loss) < F.col("lower")) & (F.col(loss) < F.col("upper"))).drop("lower", "upper")


# -- shaft speed --------------------------------------------------------------------------------
def coarse_speed(spectra_long: DataFrame, keys: list[str], bin_hz: float, lo: int, hi: int, bins: int) -> DataFrame:
    """Candidate fundamental bin with the best 1/k-weighted sum over four harmonics.

    A bin b' supports candidate b as harmonic k when b' is k*b or next to it, so each spectrum row
    is sent to the few candidates it can support.
    """
    near = spectra_long.withColumn("kb", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])))
    near = near.filter(F.col("kb") + 1 < bins)
    near = near.groupBy(*keys, "kb").agg(F.max("mag").alias("peak"))
    k = F.explode(F.array(*[F.lit(i) for i in range(1, 5)]))
    score = near.withColumn("k", k).filter((F.col("kb") % F.col("k") == 0))
    score = score.withColumn("b", (F.col("kb") / F.col("k")).cast("int")).filter(F.col("b").between(lo, min(hi, bins - 1)))
    score = score.groupBy(*keys, "b").agg(F.sum(F.col("peak") / F.col("k")).alias("score"))
    top = F.max(F.struct(F.col("score"), (-F.col("b")).alias("back")))
    best = score.groupBy(*keys).agg(top.alias("top"))
    return best.select(*keys, (-F.col("top.back") * F.lit(bin_hz)).alias("f_hz"), F.col("top.score").alias("score"))


HARMONICS = 5  # whose phase advance the refinement reads
SEGMENTS = 6
REFINEMENTS = 3


def _coarse(mags: np.ndarray, step: float, nominal: np.ndarray, tolerance: float) -> np.ndarray:
    """Fundamental with the best 1/k-weighted support of four harmonics, for each row of spectra."""
    bins = mags.shape[1]
    support = np.maximum(mags, np.maximum(np.pad(mags, ((0, 0), (1, 0)))[:, :-1], np.pad(mags, ((0, 0), (0, 1)))[:, 1:]))
    support[:, -1:] = 0.0
    lo = np.maximum(1, np.floor(nominal * (1 - tolerance) / step).astype(int))
    hi = np.maximum(lo, np.minimum(np.ceil(nominal * (1 + tolerance) / step).astype(int), bins - 1))
    candidate = np.arange(lo.min(), hi.max() + 1)
    k = np.arange(1, 5)[:, None]
    at = candidate * k
    score = (np.where(at < bins, support[:, np.minimum(at, bins - 1)], 0.0) / k).sum(1)
    score[(candidate < lo[:, None]) | (candidate > hi[:, None])] = -1.0
    return candidate[score.argmax(1)] * step


def refine_speeds(x: np.ndarray, sr: float, nominal: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Shaft frequency and its drift of a stack of bursts (rows) without a tachometer.

    Overlapping segments give the phase of every harmonic over time; against the frequency so far these
    phases are a line for a wrong frequency and a parabola for a drift. Both come from one least-squares fit
    over all segments and harmonics, each harmonic weighing as the square of its number and weakest amplitude.
    """
    n = x.shape[1]
    if n < 4 * SEGMENTS:  # too short to tell
        return np.asarray(nominal, dtype=float), np.zeros(len(x))
    f = coarse = _coarse(np.abs(np.fft.rfft(x * np.asarray(hann(n, periodic=True))))[:, : max(2, n // 2)], sr / n, nominal, tolerance)
    span = max(2, n // 3)
    starts = np.rint(np.linspace(0, n - span, SEGMENTS)).astype(int)
    shape = np.asarray(hann(span, periodic=True))
    pieces = np.lib.stride_tricks.sliding_window_view(x, span, axis=1)[:, starts] * shape
    t = np.arange(span) / sr
    middle = (starts + span / 2) / sr
    design = np.stack([middle, middle**2 / 2], 1)
    design = design - design.mean(0)
    drift = np.zeros(len(x))
    for turn in range(REFINEMENTS):
        k = np.arange(1, (1 if turn == 0 else HARMONICS) + 1)
        wave = np.exp(-2j * np.pi * f[:, None, None] * k[:, None] * t)
        tone = np.einsum("rsn,rkn->rks", pieces, wave) * np.exp(-2j * np.pi * (f[:, None, None] * k[:, None]) * (starts / sr))
        cycles = np.unwrap(np.angle(tone), axis=2) / (2 * np.pi * k[:, None])
        weight = (k * np.abs(tone).min(2)) ** 2
        # A harmonic that turns by half a cycle between segments cannot be followed.
        steady = np.abs(np.diff(cycles, axis=2)).max(2) * k < 0.45
        weight = np.where(steady, weight, 0.0)
        y = (weight[:, :, None] * (cycles - cycles.mean(2, keepdims=True))).sum(1)
        total = weight.sum(1, keepdims=True)
        y = np.divide(y, total, out=np.zeros_like(y), where=total > 0)
        fit = np.linalg.lstsq(design, y.T, rcond=None)[0]
        drift = fit[1]
        f = f + fit[0] + drift * (n / sr) / 2
    # A burst without a tone leads anywhere; then the coarse estimate stands.
    lost = ~(np.abs(f - nominal) <= 4 * tolerance * np.abs(nominal))
    return np.where(lost, coarse, f), np.where(lost, 0.0, drift)


def refine_speed(x: np.ndarray, sr: float, nominal: float, tolerance: float) -> tuple[float, float]:
    """Shaft frequency and drift of one burst."""
    f, drift = refine_speeds(np.asarray(x, dtype=np.float64)[None], sr, np.array([nominal]), tolerance)
    return float(f[0]), float(drift[0])


STACK = 1 << 17  # samples of bursts that are worked on together


def pieces(part: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Rows of ``width`` samples in pieces of about ``STACK`` samples, whatever the batch holds."""
    step = max(1, STACK // max(1, width))
    for at in range(0, len(part), step):
        yield part.iloc[at : at + step]


def stacks(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, float]]:
    """Bursts of equal length and rate together, a bounded number at a time: their rows, samples as a matrix, and the rate."""
    for (width, sr), rows in pdf.groupby([pdf["x"].map(len), "sr"], sort=False):
        for part in pieces(rows, width):
            yield part, np.stack(part["x"].to_numpy()).astype(np.float64), float(sr)


def shaft_speed(bursts: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Adds ``f_hz, drift`` to rows ``x array, sr, f_nominal``; bursts are independent of each other."""
    schema = T.StructType([*bursts.schema, T.StructField("f_hz", T.DoubleType()), T.StructField("drift", T.DoubleType())])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x, sr in stacks(pdf):
                f, drift = refine_speeds(x, sr, part["f_nominal"].to_numpy(dtype=float), tolerance)
                yield part.assign(f_hz=f, drift=drift)

    return bursts.mapInPandas(each, schema)


# -- slow spectrum of a whole series -------------------------------------------------------------
def state_bands(series: Series, hop_s: float, omega_bar: float, beats: int = 4) -> DataFrame:
    """Energy shares of the z-scored state below the bar rate, up to the beat, up to 10 Hz, above."""
    z = standardise(series, za="a", zi="i").stats(length=F.count(F.lit(1)))
    shape = F.when(
        F.col("length") > 1,
        F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0 * math.pi) * F.col("n") / (F.col("length") - 1)),
    ).otherwise(F.lit(1.0))
    z = z.with_columns(wa=F.col("za") * shape, wi=F.col("zi") * shape)
    f_bar = omega_bar / (2.0 * math.pi)
    power = power_spectrum(z, ["wa", "wi"])
    hz = F.col("bin") * (F.lit(1.0) / (F.col("length") * F.lit(hop_s)))
    power = power.filter("bin > 0").withColumn("hz", hz)
    total = F.sum("power")
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("power"))), F.lit(0.0)) / F.when(
        total > 0, total
    ).otherwise(F.lit(1.0))
    return power.groupBy(*series.keys).agg(
        share(F.col("hz") < f_bar).alias("below_bar"),
        share((F.col("hz") >= f_bar) & (F.col("hz") < beats * f_bar)).alias("bar_to_beat"),
        share((F.col("hz") >= beats * f_bar) & (F.col("hz") < 10.0)).alias("beat_to_10hz"),
        share(F.col("hz") >= 10.0).alias("above_10hz"),
    )
