"""Faults that showed on larger tables: ties, many files, many policies, long holds."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import aggregates, features, health, keyframes, similarity
from seriesloom.plans import relay
from seriesloom.plans.series import dense_series
from seriesloom.streaming import ingest, manifest, settled


def test_kurtosis_of_two_and_three_values_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in range(200) for v in np.round(rng.uniform(1, 500, 2 + k % 2), 2)]
    stats = aggregates.burst_statistics(F.col("v"))
    got = spark.createDataFrame(rows, "k long, v double").groupBy("k").agg(stats["kurtosis"].alias("kurtosis")).collect()
    assert all(r["kurtosis"] == (1.5 if r["k"] % 2 else 1.0) for r in got)


def test_a_folder_of_more_files_than_a_batch_is_drained(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(7):
        (tmp_path / "in" / f"f{k}.txt").write_text("x" * k)
    store = str(tmp_path / "store")
    keep = lambda batch: batch.select("path", "length")
    for _ in range(2):
        ingest.watch_folder(spark, str(tmp_path / "in"), store, str(tmp_path / "run"), keep, "*.txt", settle=0.1, prefixes=2, per_batch=3)
        rows = manifest.read_store(spark, store, T.StructType.fromDDL("path string, length long")).collect()
        assert sorted((r["path"], r["length"]) for r in rows) == [(f"f{k}.txt", k) for k in range(7)]
    assert settled.releases(f"{tmp_path}/run/files") == [3, 3, 1]


def test_many_policies_of_short_and_long_series(spark, monkeypatch):
    monkeypatch.setattr(keyframes, "LANE_POINTS", 64)
    rng = np.random.default_rng(4)
    rows = [(k, n, float(a), float(i)) for k, size in enumerate((1, 2, 30, 5000, 31)) for n, (a, i) in enumerate(rng.normal(size=(size, 2)).cumsum(0))]
    s = dense_series(spark.createDataFrame(rows, "k long, n long, a double, i double"), ["k"])
    rails = [(0.5, 1.0, 2.0, 0.9), (1.0, 0.3, 0.6, 0.5), (2.0, float("inf"), 0.4, 1.0)]
    policy = spark.createDataFrame([(k, *r) for k in range(5) for r in rails], "k long, kappa double, tau_event double, tau_max double, leak double")
    many = keyframes.keyframes(s, policy, ("kappa",))
    assert "FlatMapGroups" not in many._jdf.queryExecution().toString()  # no group for each series and policy
    got = {tuple(r) for r in many.select("k", "kappa", "n", "rail").collect()}
    want = set()
    for kappa, *_ in rails:
        one = keyframes.keyframes(s, policy.filter(F.col("kappa") == kappa).drop("kappa"))
        want |= {(r["k"], kappa, r["n"], r["rail"]) for r in one.collect()}
    assert got == want


def test_a_level_is_held_as_exactly_after_many_rows(spark):
    release, size = math.exp(-0.05 / 0.3), 300_000
    x = np.random.default_rng(5).uniform(0.1, 1, size)
    x[::3] = 0.0
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "n": np.arange(size), "x": x}))
    out = dense_series(rows, ["k"]).peak_hold(release, held=F.col("x")).df.toPandas().sort_values("n")
    held, want = 0.0, []
    for v in x:
        held = max(v, held * release)
        want.append(held)
    np.testing.assert_allclose(out["held"].to_numpy(), want, rtol=2e-14)


def test_a_burst_without_spread_has_no_kurtosis(spark):
    rows = spark.createDataFrame([(1, [7]), (2, [5, 5, 5]), (3, [1, 3, 3, 9]), (4, [0, 0])], "k int, x array<int>")
    got = {r[0]: r[1:] for r in rows.select("k", *health.plain_indicators(F.col("x")).values()).collect()}
    assert got[1] == (7 / 32768, None, 1.0) and got[2] == (5 / 32768, None, 1.0) and got[4] == (0.0, None, None)
    d = np.array([1, 3, 3, 9]) - 4
    np.testing.assert_allclose(got[3], (5 / 32768, (d**4).mean() / (d**2).mean() ** 2, 9 / 5))


def test_vectors_leave_a_task_in_bounded_pieces(spark, monkeypatch):
    for name, value in (("CHUNK", 40), ("SLICE", 16), ("VISITS", 32)):
        monkeypatch.setattr(similarity, name, value)
    v = np.random.default_rng(6).normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "id long, v array<double>")
    s = v @ v.T
    got = {(r["id"], r["other"]) for r in similarity.similar_pairs(items, 0.6).collect()}
    assert got == {(a, b) for a, b in zip(*np.nonzero(s >= 0.6)) if a < b}
    np.fill_diagonal(s, -1)
    top = {(r["id"], r["rank"]): r["other"] for r in similarity.top_matches(items, 2).collect()}
    best = np.argsort(-s, axis=1)
    assert top == {(a, k + 1): best[a, k] for a in range(400) for k in range(2)}
    cells = [{"cell": c, "radius": 2.0} for c in range(8)]
    pieces = list(similarity._visits(pd.DataFrame({"id": range(400), "v": list(v)}), v[:8], cells, similarity._FixedReach(2.0)))
    assert max(map(len, pieces)) <= 32 and sum(map(len, pieces)) == 8 * 400


def test_a_chain_goes_through_its_task_by_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.createDataFrame([(k, n) for k in range(3) for n in range(170 * k + 1)], "k long, n long")
        emits = relay.Emits(T.StructType.fromDDL("total long, held long"))

        def rule(pdf, state):
            total = pdf["n"].cumsum() + (state[0] if state else 0)
            return pd.DataFrame({"total": total, "held": len(pdf)}), [int(total.iloc[-1])]

        close = lambda state: pd.DataFrame({"total": [-state[0]], "held": [0]})
        got = relay.run_rule(dense_series(rows, ["k"]), rule, emits, close, serial=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, t) for k in range(3) for t in [*np.cumsum(range(170 * k + 1)), -sum(range(170 * k + 1))]]
    assert sorted((r["k"], r["total"]) for r in got) == sorted(want) and max(r["held"] for r in got) <= 50


def test_recordings_are_written_from_arrow_batches(tmp_path):
    """A writer that takes rows makes a Python number of every sample of a batch, nine times its bytes."""
    import tracemalloc

    import pyarrow as pa

    from seriesloom.sources.pcm import PcmWriter

    frames = 1 << 20
    names, types = ["series_id", "channel", "chunk", "start", "x", "channels", "frames"], ["string", "int32", "int32", "int64", None, "int32", "int64"]
    samples = np.arange(frames, dtype=np.int32) % 30_000
    x = pa.ListArray.from_arrays(pa.array(np.arange(17, dtype=np.int32) * 65_536), pa.array(samples))
    at = np.arange(16)
    columns = [["one"] * 16, [0] * 16, at, at * 65_536, None, [1] * 16, [frames] * 16]
    arrays = [x if t is None else pa.array(c, pa.type_for_alias(t)) for c, t in zip(columns, types)]
    tracemalloc.start()
    PcmWriter({"path": str(tmp_path), "sr": "8000", "bits": "16"}, names).write(iter([pa.RecordBatch.from_arrays(arrays, names)]))
    assert tracemalloc.get_traced_memory()[1] < 4 * frames
    tracemalloc.stop()
    assert (tmp_path / "one.wav").read_bytes()[44:] == samples.astype("<i2").tobytes()


def test_bursts_are_stacked_in_bounded_pieces():
    pdf = pd.DataFrame({"x": list(np.arange(2000 * 512).reshape(2000, 512)), "sr": 64.0})
    found = list(features.stacks(pdf))
    assert max(x.size for _, x, _ in found) <= features.STACK
    assert (np.concatenate([x for _, x, _ in found]) == np.stack(pdf["x"])).all()


def test_bars_meet_their_lags_in_bounded_pieces():
    """A bar of 64 samples against 33 lags: a batch of 10,000 bars was 169 MB for each copy of it."""
    parts = list(features.pieces(pd.DataFrame({"x": range(10_000)}), 64 * 33))
    assert max(map(len, parts)) * 64 * 33 <= features.STACK and sum(map(len, parts)) == 10_000


def test_rice_bits_of_all_revolutions_come_at_once():
    rng = np.random.default_rng(5)
    values, cuts = rng.integers(-40_000, 40_000, 3000) // rng.integers(1, 3000, 3000), np.array([0, 1, 300, 812, 1068, 3000])

    def block(part):
        u = [2 * v if v >= 0 else -2 * v - 1 for v in part.tolist()]
        return 5 + min(sum(50 if v >> k >= 32 else (v >> k) + 1 + k for v in u) for k in range(17))

    plain = [sum(block(values[at : min(at + 256, hi)]) for at in range(lo, hi, 256)) for lo, hi in zip(cuts[:-1], cuts[1:])]
    assert health._rice_bits(values, cuts).tolist() == plain
