"""Order statistics against sorting, with outliers, ties and hot groups."""

from random import SystemRandom

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.plans.selection import COARSE, exact_median, pick_ranks, split_evenly


def frame(spark, groups):
    rows = [(k, None if v is None else float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "k string, x double").repartition(4)


def test_one_outlier_leaves_the_cells_even(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, {"a": [*rng.random(5000), 1e9]}).withColumn("copies", F.lit(1).cast("long"))
    sizes = [r["count"] for r in split_evenly(df, ["k"], "x", "cell").groupBy("cell").count().collect()]
    assert sum(sizes) == 5001 and len(sizes) > 0.9 * COARSE**2 and max(sizes) < 4 * 5001 / COARSE**2


@pytest.mark.parametrize("rounds", [1, 2])
def test_ranks_equal_sorting(spark, rounds):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(size=4000), "odd": rng.normal(size=301) * 1e6, "ties": rng.integers(0, 3, 1000), "one": [5.0], "two": [1.0, 2.0],
        "outliers": [*rng.random(2000), 1e9, -1e300, 1e300], "nulls": [None, 3.0, None, 1.0], "none": [None], "steps": np.repeat(np.arange(700), 3),
    }
    ranks = {"low": F.lit(0), "p98": F.least(F.floor(F.col("rows") * 0.98), F.col("rows") - 1), "top": F.col("rows") - 1, "out": F.col("rows")}
    got = {r["k"]: r for r in pick_ranks(frame(spark, groups), ["k"], "x", ranks, rounds).collect()}
    middle = {r["k"]: r["m"] for r in exact_median(frame(spark, groups), ["k"], "x", "m").collect()}
    assert set(got) == set(middle) == set(groups) - {"none"}
    for k in got:
        v = np.sort([x for x in groups[k] if x is not None])
        assert (got[k]["low"], got[k]["top"], got[k]["out"]) == (v[0], v[-1], None)
        assert got[k]["p98"] == v[min(int(len(v) * 0.98), len(v) - 1)] and middle[k] == np.median(v)


def test_planning_runs_no_job(spark):
    df = frame(spark, {"a": range(100)})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    exact_median(df, ["k"], "x", "m")
    assert len(tracker.getJobIdsForGroup("planning")) == 0


@pytest.mark.parametrize("rounds", [1, 2])
def test_ranks_do_not_depend_on_the_sketch(spark, monkeypatch, rounds):
    """A sketch gives other splitters each time it is computed, here on purpose."""
    real = F.percentile_approx
    shift = F.udf(lambda cuts: sorted(c + SystemRandom().gauss(0, 0.2) for c in cuts), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *args: shift(real(*args)))
    groups = {k: np.random.default_rng(k).normal(size=3000) for k in range(4)}
    ranks = {"p50": F.floor(F.col("rows") * 0.5), "p98": F.floor(F.col("rows") * 0.98)}
    got = {int(r["k"]): r for r in pick_ranks(frame(spark, groups), ["k"], "x", ranks, rounds).collect()}
    assert {k: (r["p50"], r["p98"]) for k, r in got.items()} == {k: tuple(np.sort(v)[[1500, 2940]]) for k, v in groups.items()}
