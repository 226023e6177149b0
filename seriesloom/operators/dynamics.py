"""Derivative, force, climb, coil geometry and colour of a two-channel state (a, i)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import EPS, PHI, circular_colour, col, gradient, or_one
from seriesloom.plans.series import Series

LATENCY_S = 0.020  # perception bound used by the volatility seed


def smooth(series: Series, name: str, value: str, k: int, edges: str = "clipped") -> Series:
    """Boxcar mean over ``k`` rows.

    ``clipped`` averages the rows inside the series, ``symmetric`` clips k/2 rows on both sides,
    ``zero`` divides by ``k`` everywhere (an implicit zero padding).
    """
    if k <= 1:
        return series.with_columns(**{name: F.col(value)})
    if edges == "zero":
        before, after = k // 2, (k - 1) // 2
        mean = lambda w: F.sum(value).over(w.rowsBetween(-before, after)) / k
    else:
        before, after = (k // 2, k // 2) if edges == "symmetric" else ((k - 1) // 2, k // 2)
        mean = lambda w: F.avg(value).over(w.rowsBetween(-before, after))
    return series.around(before, after, **{name: mean})


def gradients(series: Series, **columns: str) -> Series:
    """``name=value`` pairs: each name becomes the gradient of its value."""
    return series.around(1, 1, **{k: (lambda w, v=v: gradient(v, w)) for k, v in columns.items()})


def force(series: Series, w_amp: float = 1.0, w_int: float = 1.0, smooth_rows: int = 1, edges: str = "clipped") -> Series:
    """da, di and f: derivatives divided by their own population spread, weighted, Euclidean."""
    a, i = "a", "i"
    if smooth_rows > 1:
        series = smooth(series, "a_smooth", "a", smooth_rows, edges)
        series = smooth(series, "i_smooth", "i", smooth_rows, edges)
        a, i = "a_smooth", "i_smooth"
    series = gradients(series, da=a, di=i)
    series = series.stats(s_a=F.stddev_pop("da"), s_i=F.stddev_pop("di"))
    fa = F.lit(w_amp) * F.col("da") / or_one(F.col("s_a"))
    fi = F.lit(w_int) * F.col("di") / or_one(F.col("s_i"))
    return series.with_columns(f=F.sqrt(fa * fa + fi * fi))


def climb(series: Series, force_column: str = "f") -> Series:
    """h: running sum of the force."""
    return series.running(h=("sum", F.col(force_column)))


def clock(omega_n: Column | float, hop_s: Column | float, r0: Column | float = 1.0) -> dict[str, Column]:
    """Time and position on the circle of row ``n``."""
    omega_n, hop_s, r0 = (c if isinstance(c, Column) else F.lit(float(c)) for c in (omega_n, hop_s, r0))
    alpha = omega_n * F.col("n")
    return {
        "t": F.col("n") * hop_s,
        "alpha": alpha,
        "x": r0 * F.cos(alpha),
        "y": r0 * F.sin(alpha),
    }


def angular_step(bpm: Column, beats: float, hop: float, sr: float) -> Column:
    """Radians per row: one turn of the coil is one bar."""
    return F.lit(2.0 * math.pi) * bpm / F.lit(60.0 * beats) * F.lit(hop / sr)


def curvature_torsion(omega: Column | float, r0: Column | float, h1: Column, h2: Column, h3: Column):
    """Frenet curvature and torsion of (r0 cos wn, r0 sin wn, h(n))."""
    w, r = (c if isinstance(c, Column) else F.lit(float(c)) for c in (omega, r0))
    common = F.pow(w, 4) * r * r + w * w * h1 * h1 + h2 * h2
    speed = w * w * r * r + h1 * h1
    kappa = r * w * F.sqrt(common) / F.pow(speed, 1.5)
    tau = w * (w * w * h1 + h3) / F.greatest(common, F.lit(EPS))
    return kappa, tau


def bend(series: Series, omega_n: Column | float, r0: Column | float = 1.0) -> Series:
    """kappa and tau from the force and its first two gradients."""
    series = gradients(series, f1="f")
    series = gradients(series, f2="f1")
    kappa, tau = curvature_torsion(omega_n, r0, F.col("f"), F.col("f1"), F.col("f2"))
    return series.with_columns(kappa=kappa, tau=tau)


def colour(floor_db: float = -80.0, chroma: str = "chroma") -> dict[str, Column]:
    """Hue and saturation of the chroma vector, brightness of the loudness."""
    value = (F.col("a") - F.lit(floor_db)) / F.lit(0.0 - floor_db)
    return {**circular_colour(F.col(chroma)), "val": F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))}


def derive(
    series: Series,
    *,
    omega_n: float,
    hop_s: float,
    r0: float = 1.0,
    w_amp: float = 1.0,
    w_int: float = 1.0,
    smooth_rows: int = 1,
    edges: str = "clipped",
    floor_db: float = -80.0,
    chroma: str | None = None,
) -> Series:
    """Everything that follows from the stored state; unused columns are pruned by Catalyst."""
    out = force(series, w_amp, w_int, smooth_rows, edges)
    out = bend(climb(out), omega_n, r0).with_columns(**clock(omega_n, hop_s, r0)).with_columns(z=F.col("h"))
    return out.with_columns(**colour(floor_db, chroma)) if chroma else out


def standardise(series: Series, **columns: str) -> Series:
    """``name=value`` pairs: z-scores with the population spread."""
    facts = {}
    for name, value in columns.items():
        facts[f"mu_{name}"] = F.avg(value)
        facts[f"sd_{name}"] = F.stddev_pop(value)
    out = series.stats(**facts)
    z = {k: (F.col(v) - F.col(f"mu_{k}")) / or_one(F.col(f"sd_{k}")) for k, v in columns.items()}
    return out.with_columns(**z)


def volatility(series: Series, hop_s: float, normalised: bool = True) -> DataFrame:
    """One threshold seed per series: phi * spread of the state speed * 20 ms, at least 1e-6."""
    a, i = "a", "i"
    if normalised:
        series = standardise(series, za="a", zi="i")
        a, i = "za", "zi"
    series = gradients(series, va=a, vi=i)
    speed = F.sqrt(F.col("va") * F.col("va") + F.col("vi") * F.col("vi")) / F.lit(hop_s)
    spread = F.coalesce(F.stddev_pop(speed), F.lit(0.0))
    if normalised:
        seed = F.greatest(F.lit(PHI * LATENCY_S) * spread, F.lit(1e-6))
    else:
        seed = F.lit(PHI) * F.greatest(spread * F.lit(LATENCY_S), F.lit(1e-6))
    return series.totals(seed=seed)


def calibration(series: Series, **gates: Column) -> DataFrame:
    """Spread of both derivatives, total and mean force: what the streaming form needs up front. ``gates`` are values that
    hold for a whole series, such as the energy below which a frame is held."""
    out = force(series)
    return out.totals(
        **{name: F.max(gate) for name, gate in gates.items()},
        m=F.count(F.lit(1)),
        s_a=or_one(F.max("s_a")),
        s_i=or_one(F.max("s_i")),
        h_total=F.sum("f"),
        mean_f=F.avg("f"),
    )


def climb_rates(series: Series, split: Column, t: str = "t_h") -> DataFrame:
    """Mean climb increment before and from a split time on (0 when a side is empty)."""
    out = series.around(1, 0, dh=lambda w: F.col("h") - F.lag("h").over(w))
    early = col(t) < split
    return out.totals(
        before=F.coalesce(F.avg(F.when(early, F.col("dh"))), F.lit(0.0)),
        after=F.coalesce(F.avg(F.when(~early, F.col("dh"))), F.lit(0.0)),
    )


def beat_grid(position: Column, beat: Column, loop_beats: float, jump_beats: float) -> dict[str, Column]:
    """Position snapped to the beat, end of a loop from there, and a jump that never goes below 0.

    Without a beat the position stays as it is.
    """
    timed = beat > 0
    snapped = F.when(timed, F.round(position / beat) * beat).otherwise(position)
    return {
        "snapped": snapped,
        "loop_end": snapped + F.when(timed, F.lit(float(loop_beats)) * beat).otherwise(F.lit(0.0)),
        "jumped": F.when(timed, F.greatest(position + F.lit(float(jump_beats)) * beat, F.lit(0.0))).otherwise(position),
    }
