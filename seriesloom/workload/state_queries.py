"""Dynamics, ticks and keyframes over user histories."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions.columns import or_one
from seriesloom.operators import aggregates as agg
from seriesloom.operators import dynamics as dyn
from seriesloom.operators import features as feat
from seriesloom.operators import keyframes as keys
from seriesloom.plans.series import Series
from seriesloom.workload.registry import query
from seriesloom.workload.tables import (
    FORCE, GRADS, HOP_S, OMEGA_N, STATE, TONES, gradient_sql, r4, table, tones, user_rows, user_state,
)

R = "round({}, 4) AS {}"


@query("w1_strongest_moments", f"""WITH {FORCE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f DESC, n) AS rank FROM climb WHERE a > -40)
SELECT user_id, n, round(f, 4) AS f, round(h, 4) AS h, rank FROM ranked WHERE rank <= 3""")
def strongest_moments(spark, sf_dir):
    series = dyn.climb(dyn.force(user_state(spark, sf_dir)))
    top = agg.top_moments(series.df, ["user_id"], "f", 3, audible=F.col("a") > -40)
    return top.select("user_id", "n", r4("f", "f"), r4("h", "h"), "rank")


@query("d1_smooth_modes", f"""WITH {STATE}
SELECT user_id, n,
  round(avg(a) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS clipped5,
  round(avg(a) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 4) AS clipped4,
  round(avg(a) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS symmetric4,
  round(sum(a) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 4) AS zero4
FROM state""")
def smooth_modes(spark, sf_dir):
    s = user_state(spark, sf_dir)
    for name, k, edges in [("clipped5", 5, "clipped"), ("clipped4", 4, "clipped"), ("symmetric4", 4, "symmetric"), ("zero4", 4, "zero")]:
        s = dyn.smooth(s, name, "a", k, edges)
    return s.select("user_id", "n", *[r4(c, c) for c in ("clipped5", "clipped4", "symmetric4", "zero4")])


@query("d2_gradients", f"""WITH {STATE},
g1 AS (SELECT user_id, n, {gradient_sql('a')} AS d1 FROM state),
g2 AS (SELECT *, {gradient_sql('d1')} AS d2 FROM g1),
g3 AS (SELECT *, {gradient_sql('d2')} AS d3 FROM g2)
SELECT user_id, n, round(d1, 4) AS d1, round(d2, 4) AS d2, round(d3, 4) AS d3 FROM g3""")
def gradients(spark, sf_dir):
    s = user_state(spark, sf_dir)
    s = dyn.gradients(s, d1="a")
    s = dyn.gradients(s, d2="d1")
    s = dyn.gradients(s, d3="d2")
    return s.select("user_id", "n", r4("d1", "d1"), r4("d2", "d2"), r4("d3", "d3"))


@query("d3_force_norm", f"WITH {FORCE} SELECT user_id, n, round(f, 4) AS f FROM force")
def force_norm(spark, sf_dir):
    return dyn.force(user_state(spark, sf_dir)).select("user_id", "n", r4("f", "f"))


@query("d4_climb", f"WITH {FORCE} SELECT user_id, n, round(h, 4) AS h FROM climb")
def climb(spark, sf_dir):
    return dyn.climb(dyn.force(user_state(spark, sf_dir))).select("user_id", "n", r4("h", "h"))


@query("d5_clock_position", f"""WITH {STATE},
meta AS (SELECT user_id, 60.0 + user_id % 90 AS bpm, 2 * pi() * (60.0 + user_id % 90) / (60.0 * 4) * 1024 / 44100 AS w
         FROM (SELECT DISTINCT user_id FROM state))
SELECT user_id, n, round(n * 1024 / 44100.0, 4) AS t, round(w * n, 4) AS alpha,
       round(cos(w * n), 4) AS x, round(sin(w * n), 4) AS y
FROM state JOIN meta USING (user_id)""")
def clock_position(spark, sf_dir):
    s = user_state(spark, sf_dir)
    meta = s.df.select("user_id").distinct().withColumn("bpm", F.lit(60.0) + F.col("user_id") % 90)
    s = s.attach(meta)
    s = s.with_columns(w=dyn.angular_step(F.col("bpm"), 4, 1024, 44100))
    s = s.with_columns(**dyn.clock(F.col("w"), F.lit(1024 / 44100)))
    return s.select("user_id", "n", *[r4(c, c) for c in ("t", "alpha", "x", "y")])


BEND = FORCE + f""",
b1 AS (SELECT *, {gradient_sql('f')} AS f1 FROM climb),
b2 AS (SELECT *, {gradient_sql('f1')} AS f2 FROM b1),
common AS (SELECT *, power({OMEGA_N}, 4) + {OMEGA_N} * {OMEGA_N} * f * f + f1 * f1 AS c, {OMEGA_N} * {OMEGA_N} + f * f AS speed FROM b2),
bend AS (SELECT *, {OMEGA_N} * sqrt(c) / power(speed, 1.5) AS kappa,
                {OMEGA_N} * ({OMEGA_N} * {OMEGA_N} * f + f2) / greatest(c, 1e-10) AS tau FROM common)"""


@query("d6_curvature_torsion", f"WITH {BEND} SELECT user_id, n, round(kappa, 4) AS kappa, round(tau, 4) AS tau FROM bend")
def curvature_torsion(spark, sf_dir):
    s = dyn.bend(dyn.force(user_state(spark, sf_dir)), OMEGA_N)
    return s.select("user_id", "n", r4("kappa", "kappa"), r4("tau", "tau"))


COLOUR = """
angles AS (SELECT label, n, a, unnest(range(12)) AS k, unnest(chroma) AS c FROM tones),
turned AS (SELECT label, n, max(a) AS a, sum(c * cos(2 * pi() * k / 12)) AS cc, sum(c * sin(2 * pi() * k / 12)) AS ss, sum(c) AS total
           FROM angles GROUP BY 1, 2),
hues AS (SELECT *, atan2(ss, cc) / (2 * pi()) AS turn FROM turned)"""


@query("d7_colour", f"""WITH {TONES}, {COLOUR}
SELECT label, n, round(turn - floor(turn), 4) AS hue, round(sqrt(cc * cc + ss * ss) / (total + 1e-10), 4) AS sat,
       round(least(greatest((a + 80) / 80, 0), 1), 4) AS val FROM hues""")
def colours(spark, sf_dir):
    s = tones(spark, sf_dir).with_columns(**dyn.colour())
    return s.select("label", "n", r4("hue", "hue"), r4("sat", "sat"), r4("val", "val"))


@query("d8_derived_view", f"""WITH {BEND}
SELECT user_id, n, round(n * 1.0::DOUBLE, 4) AS t, round(da, 4) AS da, round(di, 4) AS di, round(f, 4) AS f, round(h, 4) AS h,
  round(cos({OMEGA_N} * n), 4) AS x, round(sin({OMEGA_N} * n), 4) AS y, round(h, 4) AS z,
  round(kappa, 4) AS kappa, round(tau, 4) AS tau FROM bend""")
def derived_view(spark, sf_dir):
    s = dyn.derive(user_state(spark, sf_dir), omega_n=OMEGA_N, hop_s=HOP_S)
    return s.select("user_id", "n", *[r4(c, c) for c in ("t", "da", "di", "f", "h", "x", "y", "z", "kappa", "tau")])


Z = STATE + """,
moments AS (SELECT user_id, avg(a) AS mu_a, avg(i) AS mu_i, stddev_pop(a) AS sd_a, stddev_pop(i) AS sd_i FROM state GROUP BY 1),
z AS (SELECT s.*, (a - mu_a) / CASE WHEN sd_a = 0 THEN 1 ELSE sd_a END AS za,
             (i - mu_i) / CASE WHEN sd_i = 0 THEN 1 ELSE sd_i END AS zi, sd_a, sd_i
      FROM state s JOIN moments USING (user_id))"""


@query("d9_zscores", f"WITH {Z} SELECT user_id, n, round(za, 4) AS za, round(zi, 4) AS zi FROM z")
def zscores(spark, sf_dir):
    s = dyn.standardise(user_state(spark, sf_dir), za="a", zi="i")
    return s.select("user_id", "n", r4("za", "za"), r4("zi", "zi"))


SEED = Z + f""",
v AS (SELECT user_id, n, {gradient_sql('za')} AS va, {gradient_sql('zi')} AS vi FROM z),
seeds AS (SELECT user_id, greatest((1 + sqrt(5)) / 2 * 0.020 * stddev_pop(sqrt(va * va + vi * vi) / {HOP_S}), 1e-6) AS seed
          FROM v GROUP BY 1)"""


@query("d10_volatility_seed", f"""WITH {SEED},
raw AS (SELECT user_id, {gradient_sql('a')} AS va, {gradient_sql('i')} AS vi FROM state),
plain AS (SELECT user_id, (1 + sqrt(5)) / 2 * greatest(0.020 * stddev_pop(sqrt(va * va + vi * vi) / {HOP_S}), 1e-6) AS raw_seed FROM raw GROUP BY 1)
SELECT user_id, round(seed, 6) AS seed, round(raw_seed, 6) AS raw_seed FROM seeds JOIN plain USING (user_id)""")
def volatility_seed(spark, sf_dir):
    s = user_state(spark, sf_dir)
    raw = dyn.volatility(s, HOP_S, normalised=False).withColumnRenamed("seed", "raw_seed")
    out = dyn.volatility(s, HOP_S).join(raw, "user_id")
    return out.select("user_id", F.round("seed", 6).alias("seed"), F.round("raw_seed", 6).alias("raw_seed"))


@query("d11_calibration", f"""WITH {FORCE}
SELECT user_id, count(*) AS m, round(max(CASE WHEN s_a = 0 THEN 1 ELSE s_a END), 4) AS s_a,
  round(max(CASE WHEN s_i = 0 THEN 1 ELSE s_i END), 4) AS s_i, round(sum(f), 4) AS h_total, round(avg(f), 4) AS mean_f
FROM force GROUP BY 1""")
def calibration(spark, sf_dir):
    out = dyn.calibration(user_state(spark, sf_dir))
    return out.select("user_id", "m", *[r4(c, c) for c in ("s_a", "s_i", "h_total", "mean_f")])


@query("d12_climb_before_after", f"""WITH {FORCE},
steps AS (SELECT user_id, n, h - lag(h) OVER (PARTITION BY user_id ORDER BY n) AS dh FROM climb)
SELECT user_id, round(coalesce(avg(dh) FILTER (n < 30), 0), 4) AS before_split,
       round(coalesce(avg(dh) FILTER (NOT n < 30), 0), 4) AS after_split FROM steps GROUP BY 1""")
def climb_before_after(spark, sf_dir):
    s = dyn.climb(dyn.force(user_state(spark, sf_dir))).with_columns(t_h=F.col("n").cast("double"))
    out = dyn.climb_rates(s, F.lit(30.0))
    return out.select("user_id", r4("before", "before_split"), r4("after", "after_split"))


W64 = 2 * math.pi / 64


@query("d13_machine_dynamics", f"""WITH revs AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) - 1 AS n,
         20 * log10(greatest(value / 1000, 1e-9)) AS a,
         12 * log2(greatest(CAST(json_extract(props, '$.k') AS INTEGER) * 10.0, 1.0) / 1000) AS i FROM events),
smooth AS (SELECT user_id, n,
   avg(a) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sa,
   avg(i) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS si FROM revs),
g AS (SELECT *, {gradient_sql('sa')} AS da, {gradient_sql('si')} AS di FROM smooth),
s AS (SELECT user_id, stddev_pop(da) AS s_a, stddev_pop(di) AS s_i FROM g GROUP BY 1),
f AS (SELECT user_id, n, sqrt(power(da / CASE WHEN s_a = 0 THEN 1 ELSE s_a END, 2)
       + power(1.3 * di / CASE WHEN s_i = 0 THEN 1 ELSE s_i END, 2)) AS f FROM g JOIN s USING (user_id)),
c AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS h, {gradient_sql('f')} AS f1 FROM f)
SELECT user_id, n, round(h, 4) AS h,
  round({W64!r} * sqrt(power({W64!r}, 4) + power({W64!r}, 2) * f * f + f1 * f1) / power(power({W64!r}, 2) + f * f, 1.5), 4) AS kappa
FROM c""")
def machine_dynamics(spark, sf_dir):
    from seriesloom.plans.series import index_series

    rows = table(spark, sf_dir, "events").select(
        "user_id",
        F.col("ts").cast("date").alias("snap"),
        "event_id",
        (20.0 * F.log10(F.greatest(F.col("value") / 1000, F.lit(1e-9)))).alias("a"),
        (12.0 * F.log2(F.greatest(F.get_json_object("props", "$.k").cast("int") * 10.0, F.lit(1.0)) / 1000)).alias("i"),
    )
    s = index_series(rows, ["user_id"], ["snap", "event_id"])
    s = dyn.derive(s, omega_n=W64, hop_s=1.0, w_int=1.3, smooth_rows=5)
    return s.select("user_id", "n", r4("h", "h"), r4("kappa", "kappa"))


# -- ticks --------------------------------------------------------------------------------------
EPS_H = 3.0
TICKS = """
crossed AS MATERIALIZED (SELECT *, h - coalesce(lag(h) OVER k, 0) AS gain, lag(n) OVER k IS NULL OR lead(n) OVER k IS NULL AS edge
            FROM laddered WINDOW k AS (PARTITION BY user_id, eps ORDER BY n)),
walk AS (SELECT user_id, eps, n, gain >= eps AS fires, gain - CASE WHEN gain >= eps THEN eps ELSE 0 END AS held FROM crossed WHERE n = 0
  UNION ALL SELECT c.user_id, c.eps, c.n, w.held + c.gain >= c.eps, w.held + c.gain - CASE WHEN w.held + c.gain >= c.eps THEN c.eps ELSE 0 END
  FROM walk w JOIN crossed c ON c.user_id = w.user_id AND c.eps = w.eps AND c.n = w.n + 1),
flags AS (SELECT c.*, edge OR fires AS tick FROM crossed c JOIN walk w ON w.user_id = c.user_id AND w.eps = c.eps AND w.n = c.n),
ticks AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY user_id, eps ORDER BY n), 0) AS step_rows FROM flags WHERE tick)"""
ONE_EPS = FORCE + f", laddered AS (SELECT *, {EPS_H} AS eps FROM climb)," + TICKS


@query("w2_energy_ticks", f"WITH RECURSIVE {ONE_EPS} SELECT user_id, n, round(h, 4) AS h, step_rows FROM ticks")
def energy_ticks(spark, sf_dir):
    s = dyn.climb(dyn.force(user_state(spark, sf_dir)))
    ticks = keys.tick_rows(keys.energy_ticks(s, F.lit(EPS_H)))
    return ticks.select("user_id", "n", r4("h", "h"), "step_rows")


@query("w3_tick_error", f"""WITH RECURSIVE {ONE_EPS},
spans AS (SELECT user_id, n AS n0, h AS h0, lead(n) OVER k AS n1, lead(h) OVER k AS h1 FROM ticks WINDOW k AS (PARTITION BY user_id ORDER BY n)),
both_ AS (SELECT l.user_id, l.n, l.h, n0, h0, coalesce(n1, n0) AS n1, coalesce(h1, h0) AS h1
          FROM climb l ASOF JOIN spans s ON l.user_id = s.user_id AND l.n >= s.n0),
u AS (SELECT *, CASE WHEN n1 > n0 THEN (n - n0) / (n1 - n0)::DOUBLE ELSE 0 END AS u FROM both_)
SELECT user_id, round(max(abs(h - (h0 + u * (h1 - h0)))), 4) AS max_dh,
  round(max(sqrt(power(cos({OMEGA_N} * n) - (cos({OMEGA_N} * n0) + u * (cos({OMEGA_N} * n1) - cos({OMEGA_N} * n0))), 2)
               + power(sin({OMEGA_N} * n) - (sin({OMEGA_N} * n0) + u * (sin({OMEGA_N} * n1) - sin({OMEGA_N} * n0))), 2))), 4) AS max_xy,
  max(n1 - n0) AS max_step_rows, round({OMEGA_N}::DOUBLE * max(n1 - n0), 4) AS max_dalpha FROM u GROUP BY 1""")
def tick_error(spark, sf_dir):
    s = dyn.climb(dyn.force(user_state(spark, sf_dir)))
    out = keys.tick_error(keys.energy_ticks(s, F.lit(EPS_H)), OMEGA_N)
    return out.select("user_id", r4("max_dh", "max_dh"), r4("max_xy", "max_xy"), "max_step_rows", r4("max_dalpha", "max_dalpha"))


MULTIPLES = [2.0, 5.0, 10.0, 20.0]


@query("w4_tick_sweep", f"""WITH RECURSIVE {FORCE},
means AS (SELECT user_id, avg(f) AS mean_f FROM force GROUP BY 1),
laddered AS (SELECT c.*, k AS eps_k, k * mean_f AS eps FROM climb c JOIN means USING (user_id),
             (SELECT unnest([2.0, 5.0, 10.0, 20.0])::DOUBLE AS k)), {TICKS}
SELECT user_id, eps_k, count(*) AS ticks, max(step_rows) AS widest FROM ticks GROUP BY 1, 2""")
def tick_sweep(spark, sf_dir):
    s = dyn.climb(dyn.force(user_state(spark, sf_dir))).stats(mean_f=F.avg("f"))
    s = s.split_by("eps_k", MULTIPLES)
    ticks = keys.tick_rows(keys.energy_ticks(s, F.col("eps_k") * F.col("mean_f")))
    return ticks.groupBy("user_id", "eps_k").agg(F.count(F.lit(1)).alias("ticks"), F.max("step_rows").alias("widest"))


# -- keyframes ----------------------------------------------------------------------------------
POLICY = SEED + """,
policy AS (SELECT user_id, 3.0 * seed AS tau_event, 6.0 * seed AS tau_max, exp(-16.0 * 0.02) AS leak, 16.0::DOUBLE * 0.02 AS lam FROM seeds)"""
# The two rails as a recursive walk: one step per row, all users side by side.
RAILS = """
walk AS (
  SELECT user_id, n, za, zi, za AS rx, zi AS ry, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey, 'start' AS rail FROM z WHERE n = 0
  UNION ALL
  SELECT user_id, n, za, zi,
         CASE WHEN rail IS NULL THEN rx ELSE za END, CASE WHEN rail IS NULL THEN ry ELSE zi END,
         CASE WHEN rail IS NULL THEN ex ELSE 0.0 END, CASE WHEN rail IS NULL THEN ey ELSE 0.0 END, rail
  FROM (
    SELECT s.user_id, s.n, s.za, s.zi, w.rx, w.ry, p.leak * w.ex + (s.za - w.za) AS ex, p.leak * w.ey + (s.zi - w.zi) AS ey,
      CASE WHEN sqrt(power(s.za - w.rx, 2) + power(s.zi - w.ry, 2)) > p.tau_max THEN 'hard'
           WHEN sqrt(power(p.leak * w.ex + (s.za - w.za), 2) + power(p.leak * w.ey + (s.zi - w.zi), 2)) > p.tau_event THEN 'event' END AS rail
    FROM walk w JOIN z s ON s.user_id = w.user_id AND s.n = w.n + 1 JOIN policy p ON p.user_id = w.user_id)),
picked AS (SELECT user_id, n, rail FROM walk WHERE rail IS NOT NULL)"""
SCALED = POLICY.replace("3.0 * seed AS tau_event", "60.0 * seed AS tau_event").replace("6.0 * seed AS tau_max", "90.0 * seed AS tau_max")


def _policy(s: Series, event: float = 3.0, hard: float = 6.0):
    return keys.seeded_policy(dyn.volatility(s, HOP_S), 0.02, HOP_S, event=event, hard=hard)


@query("w8_seeded_policy", f"""WITH {POLICY}
SELECT user_id, round(tau_event, 6) AS tau_event, round(tau_max, 6) AS tau_max, round(lam, 6) AS lam, round(leak, 6) AS leak FROM policy""")
def seeded_policy(spark, sf_dir):
    p = _policy(user_state(spark, sf_dir))
    return p.select("user_id", *[F.round(c, 6).alias(c) for c in ("tau_event", "tau_max", "lam", "leak")])


@query("w5_two_rail_keyframes", f"WITH RECURSIVE {SCALED}, {RAILS} SELECT user_id, n, rail FROM picked")
def two_rail_keyframes(spark, sf_dir):
    s = user_state(spark, sf_dir)
    return keys.keyframes(s, _policy(s, 60.0, 90.0)).select("user_id", "n", "rail")


@query("w6_keyframe_rows", f"""WITH RECURSIVE {SCALED}, {RAILS},
g AS (SELECT *, {gradient_sql('a')} AS da, {gradient_sql('i')} AS di FROM state),
sp AS (SELECT user_id, stddev_pop(da) AS s_a, stddev_pop(di) AS s_i FROM g GROUP BY 1),
fo AS (SELECT g.*, sqrt(power(da / CASE WHEN s_a = 0 THEN 1 ELSE s_a END, 2) + power(di / CASE WHEN s_i = 0 THEN 1 ELSE s_i END, 2)) AS f
       FROM g JOIN sp USING (user_id)),
cl AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS h FROM fo)
SELECT c.user_id, c.n AS frame, 1.0::DOUBLE AS r, round({OMEGA_N} * c.n - floor({OMEGA_N} * c.n / (2 * pi())) * 2 * pi(), 4) AS theta,
       round(h, 4) AS z, round(a, 4) AS a, round(i, 4) AS i
FROM cl c SEMI JOIN picked p ON p.user_id = c.user_id AND p.n = c.n""")
def keyframe_rows(spark, sf_dir):
    s = user_state(spark, sf_dir)
    picked = keys.keyframes(s, _policy(s, 60.0, 90.0))
    derived = dyn.derive(s, omega_n=OMEGA_N, hop_s=HOP_S).df
    out = keys.key_rows(picked, derived, ["user_id"])
    return out.select("user_id", "frame", "r", *[r4(c, c) for c in ("theta", "z", "a", "i")])


@query("w7_hard_rail_only", f"""WITH RECURSIVE {SEED},
policy AS (SELECT user_id, CAST('inf' AS DOUBLE) AS tau_event, 1.5 AS tau_max, 1.0 AS leak FROM seeds), {RAILS}
SELECT user_id, n, rail FROM picked""")
def hard_rail_only(spark, sf_dir):
    s = user_state(spark, sf_dir)
    policy = keys.hard_rail_policy(s.df.select("user_id").distinct(), 1.5)
    return keys.keyframes(s, policy).select("user_id", "n", "rail")


@query("w9_leaky_sum", f"""WITH RECURSIVE {Z},
steps AS (SELECT user_id, n, za - coalesce(lag(za) OVER (PARTITION BY user_id ORDER BY n), za) AS step FROM z),
walk AS (SELECT user_id, n, step AS e FROM steps WHERE n = 0
         UNION ALL SELECT s.user_id, s.n, 0.8 * w.e + s.step FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n + 1)
SELECT user_id, n, round(e, 4) AS e FROM walk""")
def leaky_sum(spark, sf_dir):
    s = dyn.standardise(user_state(spark, sf_dir), za="a", zi="i")
    s = s.around(1, 0, step=lambda w: F.coalesce(F.col("za") - F.lag("za").over(w), F.lit(0.0)))
    return s.leaky_sum(0.8, e=F.col("step")).select("user_id", "n", r4("e", "e"))


SIGNUPS = Z + """,
keyed AS (SELECT *, n = 0 OR event_type = 'signup' AS is_key FROM z),
held AS (SELECT *, last_value(CASE WHEN is_key THEN a END IGNORE NULLS) OVER k AS key_a,
                last_value(CASE WHEN is_key THEN i END IGNORE NULLS) OVER k AS key_i
         FROM keyed WINDOW k AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
errs AS (SELECT *, sqrt(power((a - key_a) / CASE WHEN sd_a = 0 THEN 1 ELSE sd_a END, 2)
                      + power((i - key_i) / CASE WHEN sd_i = 0 THEN 1 ELSE sd_i END, 2)) AS err FROM held)"""


def _signup_keys(spark, sf_dir) -> Series:
    s = user_state(spark, sf_dir, "event_type")
    return s.with_columns(is_key=(F.col("n") == 0) | (F.col("event_type") == "signup"))


@query("w10_hold_error", f"WITH {SIGNUPS} SELECT user_id, n, round(err, 4) AS err FROM errs")
def hold_error(spark, sf_dir):
    return keys.hold_error(_signup_keys(spark, sf_dir)).select("user_id", "n", r4("err", "err"))


@query("a8_error_summary", f"""WITH {SIGNUPS}
SELECT user_id, round(max(err), 4) AS err_max, round(avg(err), 4) AS err_mean,
       round(list_sort(list(err))[count(*) // 2 + 1], 4) AS err_mid FROM errs GROUP BY 1""")
def error_summary(spark, sf_dir):
    s = keys.hold_error(_signup_keys(spark, sf_dir))
    out = agg.error_summary(s.df, ["user_id"], "err")
    return out.select("user_id", r4("err_max", "err_max"), r4("err_mean", "err_mean"), r4("err_mid", "err_mid"))


@query("a8_step_summary", f"""WITH RECURSIVE {ONE_EPS}
SELECT user_id, min(step_rows) AS step_min, list_sort(list(step_rows))[count(*) // 2 + 1] AS step_mid, max(step_rows) AS step_max
FROM ticks GROUP BY 1""")
def step_summary(spark, sf_dir):
    s = dyn.climb(dyn.force(user_state(spark, sf_dir)))
    return agg.step_summary(keys.tick_rows(keys.energy_ticks(s, F.lit(EPS_H))), ["user_id"]).select(
        "user_id", "step_min", "step_mid", "step_max"
    )


@query("p4_acceptance", f"""WITH {SIGNUPS},
per AS (SELECT user_id, count(*) / sum(is_key::INT)::DOUBLE AS sparsity, max(err) AS err_max FROM errs GROUP BY 1)
SELECT user_id, sparsity >= 4 AND err_max <= 3.0 AS accepted FROM per""")
def acceptance(spark, sf_dir):
    s = keys.hold_error(_signup_keys(spark, sf_dir))
    per = s.totals(sparsity=F.count(F.lit(1)) / F.sum(F.col("is_key").cast("int")), err_max=F.max("err"))
    return per.select("user_id", ((F.col("sparsity") >= 4) & (F.col("err_max") <= 3.0)).alias("accepted"))


DECILES = FORCE + """,
keyed AS (SELECT *, n = 0 OR event_type = 'signup' AS is_key, count(*) OVER (PARTITION BY user_id) AS total,
                 row_number() OVER (PARTITION BY user_id ORDER BY f, n) - 1 AS place FROM force),
binned AS (SELECT *, CASE WHEN place < (total % 10) * (total // 10 + 1) THEN place // (total // 10 + 1)
                     ELSE total % 10 + (place - (total % 10) * (total // 10 + 1)) // greatest(total // 10, 1) END AS bin FROM keyed),
rates AS (SELECT user_id, bin, avg(is_key::INT) AS rate, count(*) AS rows FROM binned GROUP BY 1, 2)"""


def _deciles(spark, sf_dir):
    s = dyn.force(_signup_keys(spark, sf_dir))
    return agg.decile_rates(s.df.select("user_id", F.col("n").alias("at"), "f", "is_key"), ["user_id"], "f", "at", "is_key")


@query("a6_decile_rates", f"WITH {DECILES} SELECT user_id, CAST(bin AS INTEGER) AS bin, round(rate, 4) AS rate, rows FROM rates")
def decile_rates(spark, sf_dir):
    return _deciles(spark, sf_dir).select("user_id", "bin", r4("rate", "rate"), "rows")


@query("a7_rates_rising", f"""WITH {DECILES},
nxt AS (SELECT *, lead(rate) OVER (PARTITION BY user_id ORDER BY bin) AS ahead FROM rates)
SELECT user_id, bool_and(coalesce(rate <= ahead + 0.02, true)) AS monotone FROM nxt GROUP BY 1""")
def rates_rising(spark, sf_dir):
    return agg.rising(_deciles(spark, sf_dir), ["user_id"])


GRID_RAILS = (
    RAILS.replace("user_id, n, za, zi, za AS rx", "z.user_id, kappa, event, hard, n, za, zi, za AS rx")
    .replace("'start' AS rail FROM z WHERE n = 0", "'start' AS rail FROM z JOIN policy USING (user_id) WHERE n = 0")
    .replace("SELECT user_id, n, za, zi,\n", "SELECT user_id, kappa, event, hard, n, za, zi,\n")
    .replace("SELECT s.user_id, s.n,", "SELECT s.user_id, p.kappa, p.event, p.hard, s.n,")
    .replace("ON p.user_id = w.user_id)", "ON p.user_id = w.user_id AND p.kappa = w.kappa AND p.event = w.event AND p.hard = w.hard)")
    .replace("SELECT user_id, n, rail FROM walk", "SELECT user_id, kappa, event, hard, n, rail FROM walk")
)


@query("w11_policy_sweep", f"""WITH RECURSIVE {SEED},
grid AS (SELECT k::DOUBLE AS kappa, e::DOUBLE AS event, m::DOUBLE AS hard FROM (SELECT unnest([0.5, 1.0, 2.0]) AS k), (SELECT unnest([1.0, 1.5, 2.0]) AS e), (SELECT unnest([4.0, 6.0]) AS m)
         UNION ALL SELECT 16.0, 3.0, 6.0),
policy AS (SELECT user_id, kappa, event, hard, event * seed AS tau_event, hard * seed AS tau_max, exp(-kappa * 0.02) AS leak FROM seeds, grid), {GRID_RAILS},
sizes AS (SELECT user_id, count(*) AS n_frames FROM state GROUP BY 1)
SELECT user_id, kappa, event, hard, count(*) AS n_keys, CAST(sum((rail = 'event')::INT) AS BIGINT) AS n_event, CAST(sum((rail = 'hard')::INT) AS BIGINT) AS n_hard,
  any_value(n_frames) AS n_frames, round(any_value(n_frames) / count(*)::DOUBLE, 4) AS sparsity FROM picked JOIN sizes USING (user_id) GROUP BY 1, 2, 3, 4""")
def policy_sweep(spark, sf_dir):
    """Every (kappa, event, hard) of the grid plus the default, one report row per user and policy."""
    s = user_state(spark, sf_dir)
    grid = [(k, e, m) for k in (0.5, 1.0, 2.0) for e in (1.0, 1.5, 2.0) for m in (4.0, 6.0)] + [(16.0, 3.0, 6.0)]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kappa"), F.lit(e).alias("event"), F.lit(m).alias("hard")) for k, e, m in grid]))
    policy = dyn.volatility(s, HOP_S).select("user_id", "seed", cells.alias("p")).select("user_id", "seed", "p.*")
    leak = F.exp(-F.col("kappa") * F.lit(0.02 * HOP_S))
    policy = policy.select(
        "user_id", "kappa", "event", "hard",
        (F.col("event") * F.col("seed")).alias("tau_event"), (F.col("hard") * F.col("seed")).alias("tau_max"), leak.alias("leak"),
    )
    picked = keys.keyframes(s, policy, ("kappa", "event", "hard"))
    rows = dyn.force(s).totals(n_frames=F.count(F.lit(1)))
    return (
        picked.groupBy("user_id", "kappa", "event", "hard")
        .agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.sum((F.col("rail") == "event").cast("long")).alias("n_event"),
            F.sum((F.col("rail") == "hard").cast("long")).alias("n_hard"),
        )
        .join(rows, "user_id")
        .withColumn("sparsity", F.round(F.col("n_frames") / F.col("n_keys"), 4))
    )


@query("f17_state_bands", f"""WITH {Z},
w AS (SELECT user_id, n, count(*) OVER (PARTITION BY user_id) AS len, za, zi FROM z),
h AS (SELECT user_id, n, len, za * (0.5 - 0.5 * cos(2 * pi() * n / (len - 1))) AS wa, zi * (0.5 - 0.5 * cos(2 * pi() * n / (len - 1))) AS wi FROM w),
b AS (SELECT DISTINCT user_id, len, unnest(range(1, len // 2 + 1)) AS bin FROM w),
d AS (SELECT user_id, bin, len, power(sum(wa * cos(2 * pi() * ((n * bin) % len) / len)), 2) + power(sum(wa * sin(2 * pi() * ((n * bin) % len) / len)), 2)
        + power(sum(wi * cos(2 * pi() * ((n * bin) % len) / len)), 2) + power(sum(wi * sin(2 * pi() * ((n * bin) % len) / len)), 2) AS p
      FROM h JOIN b USING (user_id, len) GROUP BY 1, 2, 3),
f AS (SELECT user_id, bin * (1.0::DOUBLE / (len * 0.02::DOUBLE)) AS hz, p FROM d)
SELECT user_id, round(coalesce(sum(p) FILTER (hz < 1.0), 0) / sum(p), 4) AS below_bar, round(coalesce(sum(p) FILTER (hz >= 1.0 AND hz < 4.0), 0) / sum(p), 4) AS bar_to_beat,
  round(coalesce(sum(p) FILTER (hz >= 4.0 AND hz < 10.0), 0) / sum(p), 4) AS beat_to_10hz, round(coalesce(sum(p) FILTER (hz >= 10.0), 0) / sum(p), 4) AS above_10hz FROM f GROUP BY 1""")
def state_bands(spark, sf_dir):
    out = feat.state_bands(user_state(spark, sf_dir), hop_s=0.02, omega_bar=2 * math.pi)
    return out.select("user_id", *[r4(c, c) for c in ("below_bar", "bar_to_beat", "beat_to_10hz", "above_10hz")])


@query("p3_audible_rows", f"WITH {STATE} SELECT user_id, event_id, round(a, 4) AS a FROM state WHERE a > -20")
def audible_rows(spark, sf_dir):
    return user_rows(spark, sf_dir).filter("a > -20").select("user_id", "event_id", r4("a", "a"))


@query("p6_stored_columns", f"WITH {STATE} SELECT user_id, n, round(a, 4) AS a, round(i, 4) AS i FROM state")
def stored_columns(spark, sf_dir):
    return user_state(spark, sf_dir).select("user_id", "n", r4("a", "a"), r4("i", "i"))
