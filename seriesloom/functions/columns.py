"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
PHI = (1.0 + math.sqrt(5.0)) / 2.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decibels(mean_square: Column, floor_db: float = -80.0) -> Column:
    """Loudness of a mean square, guarded twice and floored."""
    level = 20.0 * F.log10(F.sqrt(mean_square + F.lit(EPS)) + F.lit(EPS))
    return F.greatest(level, F.lit(floor_db))


def semitones(frequency: Column, reference: float = 440.0) -> Column:
    return 12.0 * F.log2(F.greatest(frequency, F.lit(EPS)) / F.lit(reference))


def or_one(spread: Column) -> Column:
    """A zero (or missing) spread divides as 1."""
    return F.when(spread == 0, F.lit(1.0)).otherwise(F.coalesce(spread, F.lit(1.0)))


def gradient(value: Column | str, w) -> Column:
    """Central difference inside, one-sided at the ends, 0 for a lone row."""
    v = col(value)
    prev, nxt = F.lag(v).over(w), F.lead(v).over(w)
    return (
        F.when(prev.isNotNull() & nxt.isNotNull(), (nxt - prev) / 2.0)
        .when(nxt.isNotNull(), nxt - v)
        .when(prev.isNotNull(), v - prev)
        .otherwise(F.lit(0.0))
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of the two arrays."""
    size = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda x, y: x * y)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain expression used inside a lambda is evaluated for every element of the array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """Scale to length one; a vector shorter than 1e-10 stays as it is."""
    sized = lambda w: let(
        F.struct(w.alias("v"), F.when(norm(w) > EPS, norm(w)).otherwise(F.lit(1.0)).alias("length")),
        lambda s: F.transform(s["v"], lambda x: x / s["length"]),
    )
    return let(v, sized)


def centred(v: Column) -> Column:
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.size(w)
    return let(
        v,
        lambda w: let(
            F.struct(w.alias("v"), mean(w).alias("mean")), lambda s: F.transform(s["v"], lambda x: x - s["mean"])
        ),
    )


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def circular_colour(chroma: Column) -> dict[str, Column]:
    """Hue (circular mean, 0..1) and saturation (concentration) of a pitch-class vector."""
    angle = lambda i: F.lit(2.0 * math.pi) * i / F.size(chroma)
    c = F.aggregate(F.transform(chroma, lambda x, i: x * F.cos(angle(i))), F.lit(0.0), lambda s, x: s + x)
    s = F.aggregate(F.transform(chroma, lambda x, i: x * F.sin(angle(i))), F.lit(0.0), lambda t, x: t + x)
    total = F.aggregate(chroma, F.lit(0.0), lambda t, x: t + x)
    turn = F.atan2(s, c) / F.lit(2.0 * math.pi)
    return {
        "hue": F.pmod(turn, F.lit(1.0)),
        "sat": F.sqrt(c * c + s * s) / (total + F.lit(EPS)),
    }


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, ... becomes 0, 1, 2, 3, ..."""
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1).cast("long")


def rice_bits(u: Column, k: Column | int) -> Column:
    """Bits of one residual under parameter ``k``; a quotient of 32 or more escapes to 18 raw bits."""
    k = F.lit(k) if isinstance(k, int) else k
    q = F.call_function("shiftright", u, k.cast("int"))
    return F.when(q >= 32, F.lit(50).cast("long")).otherwise(q + 1 + k)


def minutes_seconds(seconds: Column) -> Column:
    whole = F.bround(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long"))


def byte_size(n: Column) -> Column:
    """1,234 B / 1.2 KiB / ... with a ladder of 1024s that stops at GiB."""
    k = 1024.0
    return (
        F.when(n < k, F.format_string("%,d B", n.cast("long")))
        .when(n < k**2, F.format_string("%,.1f KiB", F.bround(n / k, 1)))
        .when(n < k**3, F.format_string("%,.1f MiB", F.bround(n / k**2, 1)))
        .otherwise(F.format_string("%,.1f GiB", F.bround(n / k**3, 1)))
    )


def short_name(path: Column) -> Column:
    """File name without folder, extension and a leading numeric id."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"^\d*_", "")
