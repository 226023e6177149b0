"""Scans, selection and transforms against plain loops, with one series holding most rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.plans.fourier import chirp_transform, peak_autocorrelation, power_spectrum
from seriesloom.plans.selection import exact_median, pick_rank
from seriesloom.plans.series import dense_series, index_series


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(11)
    parts = []
    for key, size in (("hot", 230), ("cold", 23), ("lone", 1), ("pair", 2)):
        x = rng.normal(size=size)
        x[rng.random(size) < 0.2] = 0.0
        parts.append(pd.DataFrame({"k": key, "at": np.cumsum(rng.integers(1, 9, size)), "x": x}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(params=[7, 1 << 20], ids=["blocked", "plain"])
def series(request, spark, blocks, walk):
    blocks(request.param)
    s = index_series(spark.createDataFrame(walk.sample(frac=1, random_state=3)), ["k"], ["at"])
    assert bool(s.block) == (request.param == 7)
    return s


def by_key(df, walk, column):
    got = df.select("k", F.col("n").alias("row"), F.col(column).alias("got")).toPandas().sort_values(["k", "row"])
    return {k: g["got"].to_numpy() for k, g in got.groupby("k")}, {k: g["x"].to_numpy() for k, g in walk.groupby("k")}


def check(df, walk, column, loop):
    got, xs = by_key(df, walk, column)
    for key, x in xs.items():
        np.testing.assert_allclose(got[key].astype(float), loop(x), atol=1e-9, err_msg=key)


def test_numbering_is_dense(series, walk):
    check(series.df, walk, "n", lambda x: np.arange(len(x)))


def test_running_sum_and_exclusive_max(series, walk):
    out = series.running(total=("sum", F.col("x"))).running(end=-1, top=("max", F.col("x")))
    check(out.df, walk, "total", np.cumsum)
    got, xs = by_key(out.df, walk, "top")
    for key, x in xs.items():
        assert math.isnan(float(got[key][0] if got[key][0] is not None else math.nan))
        np.testing.assert_allclose(got[key][1:].astype(float), np.maximum.accumulate(x)[:-1])


def test_last_value_both_ways(series, walk):
    out = series.running(prev=("last", F.when(F.col("x") > 1, F.col("n"))))
    out = out.running(end=-1, backwards=True, nxt=("last", F.when(F.col("x") > 1, F.col("n"))))

    def before(x):
        return [max((j for j in range(i + 1) if x[j] > 1), default=-1) for i in range(len(x))]

    def ahead(x):
        return [min((j for j in range(i + 1, len(x)) if x[j] > 1), default=-1) for i in range(len(x))]

    filled = out.with_columns(prev=F.coalesce("prev", F.lit(-1)), nxt=F.coalesce("nxt", F.lit(-1))).df
    check(filled, walk, "prev", before)
    check(filled, walk, "nxt", ahead)


def test_reflected_sum(series, walk):
    def loop(x):
        s, out = 0.0, []
        for v in x:
            s = max(0.0, s + v - 0.1)
            out.append(s)
        return out

    check(series.reflected_sum(s=F.col("x") - 0.1).df, walk, "s", loop)


@pytest.mark.parametrize("factor", [0.02, 0.7, 0.999, 1.0])
def test_leaky_sum(series, walk, factor):
    def loop(x):
        e, out = 0.0, []
        for v in x:
            e = factor * e + v
            out.append(e)
        return out

    check(series.leaky_sum(factor, e=F.col("x")).df, walk, "e", loop)


@pytest.mark.parametrize("release", [0.3, 0.97])
def test_peak_hold(series, walk, release):
    def loop(x):
        held, out = 0.0, []
        for v in np.abs(x):
            held = max(v, held * release)
            out.append(held)
        return out

    check(series.peak_hold(release, held=F.abs("x")).df, walk, "held", loop)


def test_around_sees_neighbours_across_blocks(series, walk):
    def loop(x):
        return [x[max(0, i - 9) : i + 4].sum() for i in range(len(x))]

    out = series.around(9, 3, near=lambda w: F.sum("x").over(w.rowsBetween(-9, 3)))
    check(out.df, walk, "near", loop)


def test_whole_series_facts(series, walk):
    check(series.stats(sd=F.stddev_pop("x")).df, walk, "sd", lambda x: np.full(len(x), x.std()))


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_order_statistics(spark, blocks, walk, limit):
    blocks(limit)
    df = spark.createDataFrame(walk)
    got = {r["k"]: r["p"] for r in pick_rank(df, ["k"], "x", F.least(F.floor(F.col("rows") * 0.98), F.col("rows") - 1), "p").collect()}
    mid = {r["k"]: r["m"] for r in exact_median(df, ["k"], "x", "m").collect()}
    for key, g in walk.groupby("k"):
        x = np.sort(g["x"].to_numpy())
        assert got[key] == x[min(int(len(x) * 0.98), len(x) - 1)]
        assert mid[key] == pytest.approx(np.median(x))


@pytest.mark.parametrize("length", [1, 2, 37, 64, 230])
def test_long_transform_of_any_length(spark, length):
    x = np.random.default_rng(length).normal(size=length)
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "n": np.arange(length), "length": length, "re": x, "im": 0.0}))
    got = chirp_transform(rows, ["k"]).toPandas().sort_values("n")
    np.testing.assert_allclose(got["re"] + 1j * got["im"], np.fft.fft(x), atol=1e-8)


def test_spectrum_and_autocorrelation_do_not_depend_on_the_layout(spark, blocks, walk):
    df = spark.createDataFrame(walk[walk.k == "hot"].assign(n=lambda d: np.arange(len(d)))).select("k", "n", "x")
    x = walk[walk.k == "hot"]["x"].to_numpy()
    for limit in (7, 1 << 20):
        blocks(limit)
        s = dense_series(df, ["k"])
        power = power_spectrum(s, ["x"]).toPandas().sort_values("bin")["power"].to_numpy()
        np.testing.assert_allclose(power, np.abs(np.fft.rfft(x)) ** 2, atol=1e-7)
        ac = np.correlate(x, x, "full")[len(x) :]
        assert peak_autocorrelation(s, "x").first()["peak"] == pytest.approx(max(ac.max(), 0.0))
