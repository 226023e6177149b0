"""Keyframes, monitor, coding cost, speed and near-duplicate rules on small made-up signals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import dedup, health
from seriesloom.operators import dynamics as dyn
from seriesloom.operators import features as feat
from seriesloom.operators import keyframes as keys
from seriesloom.operators import similarity as sim
from seriesloom.plans.series import dense_series

HOP_S = 1024 / 44100


def state(spark, a, i=None):
    i = np.zeros(len(a)) if i is None else i
    return spark.createDataFrame(pd.DataFrame({"series_id": "s", "n": np.arange(len(a)), "a": a, "i": i}))


def pick(spark, a, i=None, omega=2 * math.pi * 120 / 240, **mult):
    s = dense_series(state(spark, a, i), ["series_id"])
    policy = keys.seeded_policy(dyn.volatility(s, HOP_S), omega, HOP_S, **mult)
    rows = keys.keyframes(s, policy).toPandas().sort_values("n")
    return rows, policy.first()


def test_constant_state_has_one_key(spark):
    rows, _ = pick(spark, np.full(2000, -20.0), np.full(2000, 5.0))
    assert rows["n"].tolist() == [0] and rows["rail"].tolist() == ["start"]


def test_slow_sine_fires_no_event(spark):
    t = np.arange(8000) * HOP_S
    rows, _ = pick(spark, -30 + 10 * np.sin(2 * np.pi * t / 60), event=30.0, hard=60.0)
    assert (rows["rail"] == "event").sum() == 0


def test_step_fires_on_the_step(spark):
    a = np.where(np.arange(4000) < 2000, -40.0, -10.0)
    rows, _ = pick(spark, a)
    assert 2000 in rows["n"].tolist() and len(rows) <= 3


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_random_walk_stays_within_the_bound(spark, blocks, block):
    blocks(block)
    rng = np.random.default_rng(11)
    a, i = np.cumsum(rng.normal(size=6000)), np.cumsum(rng.normal(size=6000))
    rows, policy = pick(spark, a, i)
    za, zi = (a - a.mean()) / a.std(), (i - i.mean()) / i.std()
    held = np.maximum.accumulate(np.where(np.isin(np.arange(6000), rows["n"]), np.arange(6000), 0))
    assert np.hypot(za - za[held], zi - zi[held]).max() <= policy["tau_max"] + 1e-12
    # brute force over the whole series
    leak, out, ref, ex, ey = policy["leak"], [0], 0, 0.0, 0.0
    for m in range(1, 6000):
        ex, ey = leak * ex + za[m] - za[m - 1], leak * ey + zi[m] - zi[m - 1]
        if math.hypot(za[m] - za[ref], zi[m] - zi[ref]) > policy["tau_max"] or math.hypot(ex, ey) > policy["tau_event"]:
            out.append(m)
            ref, ex, ey = m, 0.0, 0.0
    assert abs(len(out) - len(rows)) <= 2  # equal up to the last digits of the thresholds
    assert len(set(out) ^ set(rows["n"])) <= 4


def test_static_state_is_a_circle(spark):
    s = dyn.derive(dense_series(state(spark, np.full(50, -20.0)), ["series_id"]), omega_n=0.3, hop_s=1.0, r0=2.0)
    out = s.df.toPandas()
    np.testing.assert_allclose(out["kappa"], 0.5)
    np.testing.assert_allclose(out["tau"], 0.0)
    np.testing.assert_allclose(out["h"], 0.0)
    np.testing.assert_allclose(out["x"] ** 2 + out["y"] ** 2, 4.0)


def test_gradient_of_squares(spark):
    s = dyn.gradients(dense_series(state(spark, np.arange(5.0) ** 2), ["series_id"]), d="a")
    assert [r["d"] for r in s.df.orderBy("n").collect()] == [1.0, 2.0, 4.0, 6.0, 7.0]


def test_zero_padded_smoothing_is_a_convolution(spark):
    x = np.random.default_rng(2).normal(size=40)
    for k in (2, 3, 4, 5):
        s = dyn.smooth(dense_series(state(spark, x), ["series_id"]), "y", "a", k, "zero")
        got = [r["y"] for r in s.df.orderBy("n").collect()]
        np.testing.assert_allclose(got, np.convolve(x, np.ones(k) / k, mode="same"))


# -- bursts -------------------------------------------------------------------------------------
def burst(n=20480, sr=20480.0, f=33.1, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / sr
    x = sum(4000 / k * np.sin(2 * np.pi * k * f * t + k) for k in (1, 2, 3, 4)) + rng.normal(0, 80, n)
    x[::997] += 3000
    return np.clip(np.round(x), -32768, 32767).astype(np.int64)


def test_speed_is_found_without_a_tachometer():
    for f in (31.7, 33.1, 34.4):
        found, drift = feat.refine_speed(burst(f=f).astype(float), 20480.0, 33.0, 0.05)
        assert abs(found / f - 1) < 2e-4 and abs(drift) < 0.05


def test_meter_is_exact_without_a_bound_and_bounded_with_one():
    x = burst()
    revs, worst = health.meter_burst(x, 20480.0, 33.1, 0.0, 1)
    assert worst == 0.0 and revs["n_samples"].sum() == len(x)
    assert (revs["n_samples"][:-1] - 20480 / 33.1).abs().max() <= 1
    q = health.quantiser_step(0.001)
    bounded, worst = health.meter_burst(x, 20480.0, 33.1, 0.0, q)
    assert 0 < worst <= 0.001 and bounded["bits"].sum() < revs["bits"].sum()


def test_meter_equals_a_sample_loop():
    x = burst(n=4096, f=60.0)
    sr, f, grid = 20480.0, 60.0, 256
    pool, acc, weight, bits, cur, block, done, rows = np.zeros(grid), np.zeros(grid), np.zeros(grid), 0, 0, [], 0, []

    def flush(block):
        u = [2 * v if v >= 0 else -2 * v - 1 for v in block]
        return 5 + min(sum(50 if (w >> k) >= 32 else (w >> k) + 1 + k for w in u) for k in range(17)) if u else 0

    for at in range(len(x)):
        phi = f * at / sr
        rev = int(math.floor(max(phi, 0)))
        if rev != cur:
            bits += flush(block)
            rows.append(bits)
            bits, block, cur, done = 0, [], rev, done + 1
            hit = weight > 1e-12
            pool[hit] += max(1 / done, 1 / 64) * (acc[hit] / weight[hit] - pool[hit])
            acc[:], weight[:] = 0, 0
        g = (phi - math.floor(phi)) * grid
        j0, u = int(g) % grid, g - math.floor(g)
        j1 = (j0 + 1) % grid
        p = pool[j0] * (1 - u) + pool[j1] * u
        block.append(int(x[at]) - int(math.copysign(math.floor(abs(p) + 0.5), p)))
        if len(block) == 256:
            bits += flush(block)
            block = []
        for j, w in ((j0, 1 - u), (j1, u)):
            acc[j] += x[at] * w
            weight[j] += w
    rows.append(bits + flush(block))
    assert health.meter_burst(x, sr, f, 0.0, 1)[0]["bits"].tolist() == rows


def test_phase_average_of_a_long_burst_equals_the_short_form(spark, blocks, monkeypatch):
    x = burst(n=4096, f=60.0).astype(float)
    turns = pd.DataFrame({"k": 1, "n": np.arange(4096), "x": x})
    phi = turns["n"] * 60.0 / 20480.0
    turns["rev"], turns["frac"] = np.floor(phi).astype("int64"), phi - np.floor(phi)
    df = spark.createDataFrame(turns)
    short = health.phase_average(df, ["k"], F.lit(64)).select("n", "pred").toPandas().sort_values("n")
    monkeypatch.setattr(health, "FOLD_REVS", 3)
    blocks(5)
    long = health.phase_average(df, ["k"], F.lit(64)).select("n", "pred").toPandas().sort_values("n")
    np.testing.assert_allclose(long["pred"], short["pred"], atol=1e-8)


def test_envelope_shows_the_modulation():
    n, sr = 8192, 20480.0
    t = np.arange(n) / sr
    x = (1 + 0.8 * np.cos(2 * np.pi * 40 * t)) * np.sin(2 * np.pi * 3000 * t)
    env = feat._envelope(x, sr, 0.2, 0.6)
    mags = feat._burst_magnitudes(env - env.mean())
    assert abs(np.argmax(mags) * sr / n - 40) <= sr / n


def test_kurtosis_of_known_shapes(spark):
    from seriesloom.operators.aggregates import burst_statistics

    sine = np.sin(2 * np.pi * np.arange(10_000) / 100)
    flat = (np.arange(10_000) + 0.5) / 10_000
    df = spark.createDataFrame(pd.DataFrame({"k": ["sine"] * 10_000 + ["flat"] * 10_000, "x": np.concatenate([sine, flat])}))
    got = {r["k"]: r["kurtosis"] for r in df.groupBy("k").agg(*[v.alias(k) for k, v in burst_statistics(F.col("x")).items()]).collect()}
    assert got["sine"] == pytest.approx(1.5, abs=0.01) and got["flat"] == pytest.approx(1.8, abs=0.01)


def test_alarm_on_a_step_and_none_on_a_flat_series(spark):
    rng = np.random.default_rng(5)
    t = np.arange(200) * 0.1
    noise = rng.normal(0, 0.01, 200)
    rows = pd.concat(
        [pd.DataFrame({"m": m, "n": np.arange(200), "t_h": t, "value": 1 + noise + (step & (t >= 15)) * 1.0}) for m, step in (("flat", False), ("step", True))]
    )
    got = {r["m"]: r["t_alarm"] for r in health.first_alarm(dense_series(spark.createDataFrame(rows), ["m"])).collect()}
    assert got["flat"] is None and got["step"] == pytest.approx(15.0)


# -- monitor ------------------------------------------------------------------------------------
def life(kind, snaps=140, revs=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(snaps):
        level = 0.0
        if kind == "growing" and n >= 60:
            level = 0.4 * 2 ** ((n - 60) / 12)
        if kind == "plateau" and n >= 60:
            level = 3.0
        t = n / 6.0 + np.arange(revs) / 20000
        rows.append({"m": kind, "n": n, "rev_t": t.tolist(), "rev_bits": (5 + 0.1 * (rng.normal(size=revs) * (1.0 if n < 30 else 0.5) + level)).tolist()})
    return pd.DataFrame(rows)


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_monitor_disposes_growth_plateau_and_health(spark, blocks, block):
    blocks(block)
    lives = pd.concat([life("growing"), life("plateau"), life("healthy")])
    snaps = spark.createDataFrame(lives)
    events = health.monitor(dense_series(snaps, ["m"]), 30).toPandas().sort_values("t_detect_h")
    by = {m: g for m, g in events.groupby("m")}
    assert "healthy" not in by
    grown = by["growing"]
    assert grown["disposition"].tolist()[-1] == "maintenance" and len(grown) <= 2
    assert grown["doubling_h"].dropna().iloc[-1] < 12 and 5 < grown["t_onset_h"].iloc[0] <= grown["t_detect_h"].iloc[0]
    assert by["plateau"]["disposition"].tolist() == ["absorbed"]
    assert by["plateau"]["plateau_sigma"].iloc[0] == pytest.approx(3.0, abs=0.4)


def test_verdict_matches_the_window_form(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for c in range(60):
        size = int(rng.integers(1, 40))
        d = np.abs(rng.normal(3, 2, size)) * np.exp(np.arange(size) * rng.choice([0.0, 0.03, 0.12]))
        t = np.arange(size) / 6.0
        found = None
        for end in range(2, size + 1):
            found = health.verdict(t[:end].tolist(), d[:end].tolist(), False)
            if found:
                break
        found = found or health.verdict(t.tolist(), d.tolist(), True)
        want[c] = (found["disposition"], round(found.get("plateau_sigma") or 0, 6), round(found.get("growth_per_h") or 0, 6))
        rows += [{"c": c, "ord": k + 1, "t_h": t[k], "d": d[k]} for k in range(size)]
    got = health.dispositions(spark.createDataFrame(pd.DataFrame(rows)), ["c"]).collect()
    assert {r["c"]: (r["disposition"], round(r["plateau_sigma"] or 0, 6), round(r["growth_per_h"] or 0, 6)) for r in got} == want


def test_component_and_angle(spark):
    spec = health.BEARINGS[1]
    mag = np.full(512, 1.0)
    for order in (spec[3], spec[3] - 1, spec[3] + 1):
        mag[round(order * 30)] = 12.0
    df = spark.createDataFrame([(1, mag.tolist())], "k int, mag array<double>")
    row = health.component_scores(df, "mag", 1.0, F.lit(30.0), spec).first()
    assert row["component"] == "inner race" and row["margin"] > 1.5
    frac = np.linspace(0, 1, 400, endpoint=False)
    env = np.exp(-((((frac - 0.25 + 0.5) % 1) - 0.5) ** 2) / 0.002)
    turns = spark.createDataFrame(pd.DataFrame({"k": 1, "n": np.arange(400), "frac": frac, "env": env}))
    angle = health.impact_angle(dense_series(turns, ["k"])).first()
    assert angle["angle_deg"] == pytest.approx(270.0, abs=0.5) and angle["confidence"] > 0.9


# -- pooling and neighbours ---------------------------------------------------------------------
@pytest.mark.parametrize("block", [17, 1 << 20])
def test_greedy_pool_equals_the_loop(spark, blocks, block):
    blocks(block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 120)] + rng.normal(0, 0.25, (120, 8))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    reps, want = [], []
    for j in range(120):
        scores = [u[j] @ u[r] for r in reps]
        if scores and max(scores) >= 0.95:
            want.append(reps[int(np.argmax(scores))])
        else:
            reps.append(j)
            want.append(j)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "n": np.arange(120), "v": list(map(list, v))}))
    got = dedup.greedy_pool(dense_series(df, ["k"]), 0.95).toPandas().sort_values("n")
    assert got["label"].tolist() == want


def test_bars_rebuild_exactly(spark):
    rng = np.random.default_rng(6)
    a, b, tail = (rng.integers(-1000, 1000, s) for s in (4000, 4000, 123))
    x = np.concatenate([a, b, a, a, b, tail])
    s = dense_series(spark.createDataFrame(pd.DataFrame({"k": "t", "n": np.arange(len(x)), "x": x})), ["k"])
    pool, recall = dedup.pool_bars(dedup.bar_table(s, F.col("x"), 4000), ["k"])
    assert pool.count() == 3 and [r["loop"] for r in recall.orderBy("bar").collect()] == [0, 1, 0, 0, 1, 2]
    rows = s.df.select("k", F.floor(F.col("n") / 4000).alias("first_bar"), (F.col("n") % 4000).alias("at"), "x")
    payload = rows.join(pool.select("k", "first_bar", "loop"), ["k", "first_bar"])
    back = dedup.rebuild(payload.select("k", "loop", "at", "x"), recall, ["k"]).toPandas().sort_values(["bar", "at"])
    assert back["x"].tolist() == x.tolist()


def test_bar_lengths(spark):
    df = spark.createDataFrame([(120.0, 2050)], "bpm double, length long")
    assert df.select(dedup.bar_length(F.col("bpm"), 4, 1000)).first()[0] == 2000
    bars = dedup.bar_bounds(df, F.lit(1000).cast("long")).orderBy("bar").collect()
    assert [(r["start"], r["end"]) for r in bars] == [(0, 1000), (1000, 2000), (2000, 2050)]


def test_aligned_residual_finds_shift_and_gain(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(-3000, 3000, 400)
    x = np.zeros(400, dtype=np.int64)
    x[5:] = np.round(0.5 * y[:-5]).astype(int)
    df = spark.createDataFrame([(1, x.tolist(), y.tolist())], "k int, x array<int>, y array<int>")
    row = dedup.aligned_residuals(df, ["k"], 16).first()
    assert row["lag"] == 5 and row["gain"] == pytest.approx(2048, abs=8) and row["rms_ratio"] < 0.02


@pytest.mark.parametrize("chunk", [20, 1024])
def test_neighbours_are_exact_in_a_crowded_cell(spark, monkeypatch, chunk):
    monkeypatch.setattr(sim, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    crowd = rng.normal(size=16) + rng.normal(0, 0.05, (110, 16))  # one tight group holds a third
    v = np.vstack([crowd, rng.normal(size=(190, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "v": list(map(list, v))}))
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    got = sim.top_matches(items, 4).toPandas().sort_values(["id", "rank"])
    for key, g in got.groupby("id"):
        np.testing.assert_allclose(g["score"], np.sort(s[key])[::-1][:4], atol=1e-12)
    pairs = sim.similar_pairs(items, 0.8).toPandas()
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.8}
    assert set(zip(pairs["id"], pairs["other"])) == want and len(pairs) == len(want)


def test_tempo_pairs_are_the_nearest_of_all(spark, blocks):
    from seriesloom.operators import joins

    rng = np.random.default_rng(11)
    bpm = np.concatenate([np.full(60, 120.0), rng.uniform(60, 180, 90).round(1), [0.0, 300.0, 301.0]])
    rows = [(i, float(b), float(rng.uniform(0, 1e4)), 500.0) for i, b in enumerate(bpm)]
    for limit in (7, 1 << 20):
        blocks(limit)
        df = spark.createDataFrame(rows, "item long, bpm double, pos double, beat double")
        got = joins.tempo_pairs(df, "item", "bpm", "pos", "beat", widest=0.05, top=4)
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        want = set()
        for i, b, *_ in rows:
            near = sorted((abs(c / b - 1.0), j) for j, c, *_ in rows if b > 0 and c > 0 and j != i and abs(c / b - 1.0) <= 0.05)
            want |= {(i, j, rank) for rank, (_, j) in enumerate(near[:4], 1)}
        assert {(r["a_item"], r["b_item"], r["rank"]) for r in got.collect()} == want
