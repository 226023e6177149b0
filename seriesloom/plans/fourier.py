"""Discrete Fourier transforms along a series.

A series that fits one task is transformed in one grouped call. A longer one is laid out as a
matrix of about sqrt(N) x sqrt(N): transform the columns, turn by the twiddle factors, transform
the rows. Every group then holds about sqrt(N) values; lengths that are no power of two go through
the chirp identity, which needs only power-of-two transforms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.plans.series import Series
from seriesloom.session import checkpointed

DOUBLE = T.DoubleType()


def _schema(df: DataFrame, keys: list[str], *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])


def power_spectrum(series: Series, values: list[str]) -> DataFrame:
    """``keys, bin, power, length`` for bins 0 .. length // 2, summed over the value columns."""
    keys = list(series.keys)
    out = _schema(series.df, keys, ("bin", T.LongType()), ("power", DOUBLE), ("length", T.LongType()))
    if not series.block:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("n")
            power = sum(np.abs(np.fft.rfft(pdf[v].to_numpy(float))) ** 2 for v in values)
            rows = pd.DataFrame({"bin": np.arange(len(power)), "power": power, "length": len(pdf)})
            for at, key in enumerate(keys):
                rows.insert(at, key, pdf[key].iloc[0])
            return rows

        return series.df.select(*keys, "n", *values).groupBy(*keys).applyInPandas(whole, out)

    slim = Series(series.df.select(*series._cell, "n", *values), series.keys, series.block)
    facts = slim.totals(length=F.max("n") + 1)
    total = None
    for v in values:
        rows = slim.attach(facts).df.select(*keys, "n", "length", F.col(v).alias("re"), F.lit(0.0).alias("im"))
        spec = chirp_transform(rows, keys)
        part = spec.filter(F.col("n") <= F.floor(F.col("length") / 2)).select(
            *keys, F.col("n").alias("bin"), (F.col("re") ** 2 + F.col("im") ** 2).alias("power"), "length"
        )
        total = part if total is None else total.unionByName(part)
    return total.groupBy(*keys, "bin", "length").agg(F.sum("power").alias("power")).select(*out.fieldNames())


def peak_autocorrelation(series: Series, value: str) -> DataFrame:
    """``keys, peak``: the largest autocorrelation over all lags, the zero lag counted as 0."""
    keys = list(series.keys)
    if not series.block:
        out = _schema(series.df, keys, ("peak", DOUBLE))

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("n")[value].to_numpy(float)
            size = 1 << (2 * len(x) - 1).bit_length()
            ac = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)]
            ac[0] = 0.0
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "peak": [float(ac.max())]})

        return series.df.select(*keys, "n", value).groupBy(*keys).applyInPandas(whole, out)

    slim = Series(series.df.select(*series._cell, "n", value), series.keys, series.block)
    rows = slim.attach(slim.totals(length=F.max("n") + 1)).df
    size = _padded(F.col("length") * 2)
    rows = rows.select(*keys, "n", "length", size.alias("size"), F.col(value).alias("re"), F.lit(0.0).alias("im"))
    spec = radix_transform(rows, keys)
    power = spec.withColumn("re", F.col("re") ** 2 + F.col("im") ** 2).withColumn("im", F.lit(0.0))
    lags = radix_transform(power, keys)  # a symmetric input: forward and inverse agree up to the size
    inside = (F.col("n") > 0) & (F.col("n") < F.col("length"))
    best = F.max(F.when(inside, F.col("re") / F.col("size")))
    return lags.groupBy(*keys).agg(F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0)).alias("peak"))


def _padded(length):
    """Smallest power of two not below a length column."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(length.cast("double")))).cast("long")


def radix_transform(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Forward transform of ``keys, n, length, size, re, im`` with ``size`` a power of two.

    Missing rows count as zero. ``n`` of the result is the frequency index 0 .. size - 1.
    """
    half = F.floor(F.log2(F.col("size").cast("double")) / 2)
    rows = rows.withColumn("tall", F.pow(F.lit(2.0), half).cast("long"))
    rows = rows.withColumn("wide", (F.col("size") / F.col("tall")).cast("long"))
    rows = rows.withColumn("column", F.col("n") % F.col("wide"))
    shape = _schema(
        rows, keys, ("line", T.LongType()), ("column", T.LongType()), ("length", T.LongType()),
        ("size", T.LongType()), ("re", DOUBLE), ("im", DOUBLE),
    )

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        tall, wide, size, at = (int(first[c]) for c in ("tall", "wide", "size", "column"))
        x = np.zeros(tall, dtype=complex)
        x[pdf["n"].to_numpy() // wide] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        line = np.arange(tall)
        y = np.fft.fft(x) * np.exp(-2j * np.pi * ((line * at) % size) / size)
        out = {k: first[k] for k in keys}
        out.update(line=line, column=at, length=int(first["length"]), size=size, re=y.real, im=y.imag)
        return pd.DataFrame(out)[shape.fieldNames()]

    result = _schema(
        rows, keys, ("n", T.LongType()), ("length", T.LongType()), ("size", T.LongType()), ("re", DOUBLE), ("im", DOUBLE)
    )

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        size, line = int(first["size"]), int(first["line"])
        tall = 1 << ((size.bit_length() - 1) // 2)
        wide = size // tall
        x = np.zeros(wide, dtype=complex)
        x[pdf["column"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.fft(x)
        out = {k: first[k] for k in keys}
        out.update(n=line + tall * np.arange(wide), length=int(first["length"]), size=size, re=y.real, im=y.imag)
        return pd.DataFrame(out)[result.fieldNames()]

    turned = rows.groupBy(*keys, "column").applyInPandas(columns, shape)
    return checkpointed(turned.groupBy(*keys, "line").applyInPandas(lines, result))


def chirp_transform(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Transform of any length: multiply by a chirp, convolve with its conjugate, multiply again."""
    size = _padded(F.col("length") * 2)
    square = (F.col("n") * F.col("n")) % (F.col("length") * 2)
    phase = F.lit(np.pi) * square / F.col("length")
    c, s = F.cos(phase), F.sin(phase)
    base = rows.select(*keys, "n", "length", size.alias("size"), "re", "im", c.alias("c"), s.alias("s"))
    turned = base.select(
        *keys, "n", "length", "size",
        (F.col("re") * F.col("c") + F.col("im") * F.col("s")).alias("re"),
        (F.col("im") * F.col("c") - F.col("re") * F.col("s")).alias("im"),
    )
    kernel = base.select(*keys, "n", "length", "size", F.col("c").alias("re"), F.col("s").alias("im"))
    mirrored = kernel.filter("n > 0").withColumn("n", F.col("size") - F.col("n"))
    a = radix_transform(turned, keys)
    b = radix_transform(kernel.unionByName(mirrored), keys).select(
        *keys, "n", F.col("re").alias("kre"), F.col("im").alias("kim")
    )
    product = a.join(b, [*keys, "n"]).select(
        *keys, "n", "length", "size",
        (F.col("re") * F.col("kre") - F.col("im") * F.col("kim")).alias("re"),
        (-(F.col("re") * F.col("kim") + F.col("im") * F.col("kre"))).alias("im"),
    )
    back = radix_transform(product, keys).filter(F.col("n") < F.col("length"))
    re, im = F.col("re") / F.col("size"), -F.col("im") / F.col("size")
    square = (F.col("n") * F.col("n")) % (F.col("length") * 2)
    phase = F.lit(np.pi) * square / F.col("length")
    return back.select(
        *keys, "n", "length",
        (re * F.cos(phase) + im * F.sin(phase)).alias("re"),
        (im * F.cos(phase) - re * F.sin(phase)).alias("im"),
    )
