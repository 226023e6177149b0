"""Revolutions of series that fit a task: one exchange, no joins, the same rows as the form for long ones."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.operators import health
from seriesloom.workload import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_bursts_that_fit_fold_without_joins(spark, monkeypatch):
    monkeypatch.setattr(health, "FOLD_STEP", 7)
    rng = np.random.default_rng(6)
    parts = []
    for k, size in enumerate((1, 5, 900, 2000)):
        phi = np.arange(size) / 23.7
        rev = np.floor(phi).astype("int64")
        parts.append(pd.DataFrame({"k": k, "n": np.arange(size), "x": rng.normal(size=size), "rev": rev + (rev > 3), "frac": phi % 1}))
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))
    one = health.phase_average(df, ["k"], F.lit(16), fits=True)
    assert "Join" not in one._jdf.queryExecution().executedPlan().toString()
    got, want = (x.orderBy("k", "n").toPandas() for x in (one, health.phase_average(df, ["k"], F.lit(16))))
    assert got.columns.tolist() == ["k", "n", "x", "rev", "frac", "pred"] and len(got) == 2906
    np.testing.assert_allclose(got["pred"], want.set_index(["k", "n"]).loc[list(zip(got["k"], got["n"]))]["pred"], atol=1e-9)


def test_a_bin_without_known_samples_keeps_its_value(spark):
    rows = [(1, 0, 2.0, 0, 0.0), (1, 1, None, 1, 0.0), (1, 2, 6.0, 2, 0.0), (1, 3, 0.0, 3, 0.0)]
    df = spark.createDataFrame(rows, "k long, n long, x double, rev long, frac double")
    got = health.phase_average(df, ["k"], F.lit(4), fits=True).orderBy("n").collect()
    assert np.allclose([r["pred"] for r in got], [0.0, 2.0, 2.0, 2.0 + (6.0 - 2.0) / 3])


def test_revolutions_take_one_exchange(spark):
    for name in ("a3_steady_rate", "b4_revolution_states", "b5_coding_cost", "w16_phase_average"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1, name
