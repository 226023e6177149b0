"""Alarms, change detection, dispositions and joins over user histories and their days."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import aggregates as agg
from seriesloom.operators import health, joins
from seriesloom.plans.series import Series, dense_series
from seriesloom.workload.registry import query
from seriesloom.workload.tables import DAYS, STATE, WAVES, days, r4, table, user_rows, user_state, waves


@query("a1_burst_statistics", f"""WITH {DAYS}
SELECT user_id, day, round(rms, 4) AS rms, round(kurtosis, 4) AS kurtosis, round(peak, 4) AS peak, round(crest, 4) AS crest FROM days""")
def burst_statistics(spark, sf_dir):
    return days(spark, sf_dir).select("user_id", "day", *[r4(c, c) for c in ("rms", "kurtosis", "peak", "crest")])


@query("a5_healthy_summary", f"""WITH {DAYS}
SELECT user_id, round(avg(rms) FILTER (t_h <= 240), 4) AS rms_mean, round(avg(crest) FILTER (t_h <= 240), 4) AS crest_mean, round(max(peak), 4) AS peak_worst
FROM days GROUP BY 1""")
def healthy_summary(spark, sf_dir):
    out = agg.healthy_summary(
        days(spark, sf_dir).df, ["user_id"], F.col("t_h") <= 240, {"rms_mean": "rms", "crest_mean": "crest"}, {"peak_worst": "peak"}
    )
    return out.select("user_id", *[r4(c, c) for c in ("rms_mean", "crest_mean", "peak_worst")])


CAP = 168.0
INDICATORS = {"rms": ("RMS", False), "kurtosis": ("kurtosis", False), "crest": ("crest factor", False), "peak": ("peak", True)}
NAMED = """
named AS (SELECT user_id, n, t_h, unnest(['RMS', 'kurtosis', 'crest factor', 'peak']) AS name, unnest([false, false, false, true]) AS informed,
                 unnest([rms, kurtosis, crest, peak]) AS value FROM days)"""
ALARMS = NAMED + f""",
ends AS (SELECT *, max(t_h) OVER k AS t_end, count(*) OVER k AS total FROM named WINDOW k AS (PARTITION BY user_id, name)),
refs AS (SELECT user_id, name, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS refs FROM ends WHERE t_h <= least(0.25 * t_end, {CAP}) GROUP BY 1, 2),
judged AS (SELECT e.*, refs, t_h > least(0.25 * t_end, {CAP}) AND value > mu + 1.0 * greatest(sd, 1e-12 * greatest(abs(mu), 1e-12)) AS over
           FROM ends e LEFT JOIN refs USING (user_id, name)),
streaks AS (SELECT *, min(over::INT) OVER k AS low, count(*) OVER k AS held FROM judged WINDOW k AS (PARTITION BY user_id, name ORDER BY n ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
alarms AS (SELECT user_id, name, any_value(informed) AS informed, min(t_h) FILTER (low = 1 AND held = 2 AND total >= 4 AND refs >= 4) AS t_alarm FROM streaks GROUP BY 1, 2)"""


@query("b9_indicator_table", f"WITH {DAYS}, {NAMED} SELECT user_id, t_h, name, informed, round(value, 4) AS value FROM named")
def indicator_table(spark, sf_dir):
    out = health.indicator_rows(days(spark, sf_dir).df, ["user_id"], "t_h", INDICATORS)
    return out.select("user_id", "t_h", "name", "informed", r4("value", "value"))


def _alarms(spark, sf_dir):
    s = days(spark, sf_dir)
    block = [s.block] if s.block else []
    rows = health.indicator_rows(s.df, [*s.keys, *block, "n"], "t_h", INDICATORS)
    named = Series(rows, ("user_id", "name"), s.block)
    alarms = health.first_alarm(named, k_sigma=1.0, consecutive=2, cap_h=CAP)
    return alarms.join(rows.select("user_id", "name", "informed").distinct(), ["user_id", "name"])


@query("w12_first_alarm", f"WITH {DAYS}, {ALARMS} SELECT user_id, name, t_alarm FROM alarms")
def first_alarm(spark, sf_dir):
    return _alarms(spark, sf_dir).select("user_id", "name", "t_alarm")


@query("b10_alarm_leads", f"""WITH {DAYS}, {ALARMS},
fails AS (SELECT user_id, max(t_h) AS t_fail FROM days GROUP BY 1 HAVING max(kurtosis) > 2)
SELECT a.user_id, name, informed, t_alarm, t_fail - t_alarm AS lead_h FROM alarms a LEFT JOIN fails USING (user_id)""")
def alarm_leads(spark, sf_dir):
    fails = days(spark, sf_dir).totals(t_fail=F.max("t_h"), worst=F.max("kurtosis")).filter("worst > 2").select("user_id", "t_fail")
    out = health.alarm_leads(_alarms(spark, sf_dir), fails, ["user_id"])
    return out.select("user_id", "name", "informed", "t_alarm", "lead_h")


REF = 20
CUSUM = STATE + f""",
refs AS (SELECT user_id, avg(a) AS mu, stddev_pop(a) AS sd FROM state WHERE n < {REF} GROUP BY 1),
z AS (SELECT s.user_id, s.n, (a - mu) / greatest(sd, 1e-9) AS z FROM state s JOIN refs USING (user_id)),
late AS MATERIALIZED (SELECT user_id, n, z, CASE WHEN n < {REF} THEN 0.0 ELSE z - 0.05 END AS step, CASE WHEN n < {REF} THEN 0.0 ELSE z END AS raw FROM z),
walks AS (SELECT user_id, n, z, greatest(0::DOUBLE, step) AS s, greatest(0::DOUBLE, raw) AS w FROM late WHERE n = 0
  UNION ALL SELECT l.user_id, l.n, l.z, greatest(0::DOUBLE, k.s + l.step), greatest(0::DOUBLE, k.w + l.raw)
  FROM walks k JOIN late l ON l.user_id = k.user_id AND l.n = k.n + 1)"""
LIMIT = 3.0


def _scored(spark, sf_dir) -> Series:
    s = health.reference_scores(user_state(spark, sf_dir), "a", REF)
    late = F.col("n") >= REF
    s = s.with_columns(departure=F.col("z"))
    return s.reflected_sum(
        s=F.when(late, F.col("departure") - 0.05).otherwise(F.lit(0.0)), w=F.when(late, F.col("departure")).otherwise(F.lit(0.0))
    )


@query("w13_cusum", f"WITH RECURSIVE {CUSUM} SELECT user_id, n, round(s, 4) AS s, round(w, 4) AS w FROM walks")
def cusum(spark, sf_dir):
    return _scored(spark, sf_dir).select("user_id", "n", r4("s", "s"), r4("w", "w"))


DETECT = CUSUM + f""",
firsts AS (SELECT user_id, min(n) AS detect_n FROM walks WHERE s >= {LIMIT} GROUP BY 1),
rises AS (SELECT user_id, n, w > 0 AND coalesce(lag(w) OVER (PARTITION BY user_id ORDER BY n), 0) <= 0 AS rise FROM walks),
found AS (SELECT f.user_id, detect_n, coalesce(max(r.n) FILTER (r.rise), detect_n) AS onset_n FROM firsts f JOIN rises r ON r.user_id = f.user_id AND r.n <= detect_n GROUP BY 1, 2)"""


def _found(spark, sf_dir):
    s = _scored(spark, sf_dir).with_columns(t_h=F.col("n").cast("double"))
    return s, health.detections(s, threshold=LIMIT)


@query("w14_onset_estimate", f"WITH RECURSIVE {DETECT} SELECT user_id, detect_n, onset_n FROM found")
def onset_estimate(spark, sf_dir):
    return _found(spark, sf_dir)[1].select("user_id", "detect_n", "onset_n")


DISPOSE = DETECT + """,
cands AS (SELECT z.user_id, z.n - detect_n + 1 AS ord, CAST(z.n AS DOUBLE) AS t, z AS d FROM z JOIN found USING (user_id) WHERE z.n >= detect_n AND z.n - detect_n + 1 <= 30),
m AS (SELECT *, sum(d) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS last,
  greatest(CASE WHEN ord - 6 >= 3 THEN sum(d) OVER (w ROWS BETWEEN 8 PRECEDING AND 6 PRECEDING) / 3
                ELSE sum(CASE WHEN ord <= 3 THEN d END) OVER (w ROWS UNBOUNDED PRECEDING) / 3 END, 0.05) AS prev,
  avg(d) OVER (w ROWS UNBOUNDED PRECEDING) AS mean, regr_slope(ln(greatest(d, 0.05)), t) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS slope,
  lead(ord) OVER w IS NULL AS at_end FROM cands WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
v AS (SELECT *, ord >= 12 AND NOT (last / prev >= 1.25 AND ord < 30) AS decided, ord < 4 OR (last / prev < 1.25 AND last < 30) AS absorbed FROM m),
pick AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS k FROM v WHERE decided OR at_end),
verdicts AS (SELECT user_id, ord AS decided_at, NOT decided AS forced, CASE WHEN absorbed THEN 'absorbed' ELSE 'maintenance' END AS disposition,
  CASE WHEN absorbed THEN CASE WHEN ord < 4 THEN mean ELSE last END END AS plateau_sigma,
  CASE WHEN NOT absorbed THEN greatest(coalesce(slope, 1e-6), 1e-6) END AS growth_per_h, last, t FROM pick WHERE k = 1)"""


def _verdicts(spark, sf_dir):
    s, found = _found(spark, sf_dir)
    cands = s.attach(found.select("user_id", "detect_n")).df.filter(F.col("n") >= F.col("detect_n"))
    cands = cands.select("user_id", (F.col("n") - F.col("detect_n") + 1).alias("ord"), "t_h", F.col("departure").alias("d"))
    return health.dispositions(cands, ["user_id"]), found


@query("b11_dispositions", f"""WITH RECURSIVE {DISPOSE}
SELECT user_id, decided_at, forced, disposition, round(plateau_sigma, 4) AS plateau_sigma, round(growth_per_h, 6) AS growth_per_h,
  CASE WHEN growth_per_h > 1e-5 THEN round(ln(2) / growth_per_h, 2) END AS doubling_h FROM verdicts""")
def dispositions(spark, sf_dir):
    out, _ = _verdicts(spark, sf_dir)
    doubling = F.when(F.col("growth_per_h") > 1e-5, F.round("doubling_h", 2))
    return out.select(
        "user_id", "decided_at", "forced", "disposition", r4("plateau_sigma", "plateau_sigma"),
        F.round("growth_per_h", 6).alias("growth_per_h"), doubling.alias("doubling_h"),
    )


@query("s11_event_json", f"""WITH RECURSIVE {DISPOSE},
e AS (SELECT user_id, detect_n, onset_n, disposition, plateau_sigma, growth_per_h, ln(2) / growth_per_h AS doubling,
      t + greatest(ln(100 / greatest(last, 1e-9)) / growth_per_h, 0) AS service FROM verdicts JOIN found USING (user_id))
SELECT user_id, printf('{{"object":"defect_event","row_n":%d,"t_detect_h":%.4f,"t_onset_est_h":%.4f,"component":"outer race",', detect_n, detect_n::DOUBLE, onset_n::DOUBLE)
  || printf('"component_margin":1.00,"angle_deg_from_load_zone":null,"angle_confidence":0.00,"departure_sigma":%.1f,', coalesce(plateau_sigma, 0.0))
  || CASE WHEN disposition = 'maintenance' THEN printf('"disposition":"maintenance_request","growth_per_h":%.4f,"doubling_h":%.2f,"service_by_h":%.2f}}', growth_per_h, doubling, service)
          ELSE printf('"disposition":"absorbed_stable","plateau_sigma":%.1f}}', plateau_sigma) END AS event FROM e""")
def event_json(spark, sf_dir):
    """Disposed candidates as one JSON object each."""
    verdicts, found = _verdicts(spark, sf_dir)
    rows = verdicts.join(found, "user_id").select(
        "user_id",
        F.col("t_detect").alias("t_detect_h"),
        F.col("detect_n").alias("detect_rev"),
        F.col("t_onset").alias("t_onset_h"),
        F.lit("outer race").alias("component"),
        F.lit(1.0).alias("margin"),
        F.lit(None).cast("double").alias("angle_deg"),
        F.lit(0.0).alias("angle_confidence"),
        F.coalesce("plateau_sigma", F.lit(0.0)).alias("departure_sigma"),
        "disposition", "plateau_sigma", "growth_per_h", "doubling_h", "service_by_h",
    )
    return rows.select("user_id", health.event_json().alias("event"))


SNAPSHOT = 4


def monitor_snapshots(spark, sf_dir) -> Series:
    """Machines are users, a snapshot is a run of four events, each event a revolution."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9)
    rows = user_state(spark, sf_dir, "ts", "value").df.withColumn("t_h", hours)
    runs = rows.groupBy("user_id", F.floor(F.col("n") / SNAPSHOT).alias("snap"))
    packed = runs.agg(F.array_sort(F.collect_list(F.struct("n", "t_h", "value"))).alias("p"))
    snaps = packed.select(
        "user_id",
        F.col("snap").alias("n"),
        F.transform("p", lambda p: p["t_h"]).alias("rev_t"),
        F.transform("p", lambda p: p["value"]).alias("rev_bits"),
    )
    return dense_series(snaps, ["user_id"])


@query("b12_monitor")
def monitor(spark, sf_dir):
    out = health.monitor(monitor_snapshots(spark, sf_dir), reference_snapshots=4)
    numbers = ("t_detect_h", "t_onset_h", "departure_sigma", "plateau_sigma", "growth_per_h")
    return out.select("user_id", "detect_rev", "disposition", *[r4(c, c) for c in numbers])


# -- joins --------------------------------------------------------------------------------------
@query("j1_as_of_join", """WITH keys AS (SELECT user_id, ts, event_id AS key_event, value AS key_value FROM events WHERE event_type = 'signup')
SELECT e.user_id, e.event_id, k.key_event, k.key_value FROM events e ASOF LEFT JOIN keys k ON e.user_id = k.user_id AND e.ts >= k.ts""")
def as_of_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    keys = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("key_event"), F.col("value").alias("key_value"))
    out = joins.as_of(events.select("user_id", "ts", "event_id"), keys, ["user_id"], ["ts"], ["key_event", "key_value"])
    return out.select("user_id", "event_id", "key_event", "key_value")


@query("j1_held_rebuild", f"""WITH {STATE},
keys AS (SELECT user_id, n AS frame, a AS key_a, i AS key_i FROM state WHERE n = 0 OR event_type = 'signup')
SELECT s.user_id, s.n, round(k.key_a, 4) AS a_rec, round(k.key_i, 4) AS i_rec FROM state s ASOF JOIN keys k ON s.user_id = k.user_id AND s.n >= k.frame""")
def held_rebuild(spark, sf_dir):
    rows = user_state(spark, sf_dir, "event_type").df
    keys = rows.filter("n = 0 OR event_type = 'signup'").select("user_id", F.col("n").alias("frame"), "a", "i")
    out = joins.held_rebuild(keys, rows.select("user_id", "n"), ["user_id"])
    return out.select("user_id", "n", r4("a_rec", "a_rec"), r4("i_rec", "i_rec"))


@query("j2_two_sided_blend", f"""WITH {STATE},
keys AS (SELECT user_id, n AS frame, a AS key_a FROM state WHERE n = 0 OR event_type = 'signup'),
spans AS (SELECT *, lead(frame) OVER k AS f1, lead(key_a) OVER k AS a1 FROM keys WINDOW k AS (PARTITION BY user_id ORDER BY frame))
SELECT s.user_id, s.n, round(key_a + CASE WHEN f1 > frame THEN (s.n - frame) / (f1 - frame)::DOUBLE ELSE 0 END * (coalesce(a1, key_a) - key_a), 4) AS a_rec
FROM state s ASOF JOIN spans k ON s.user_id = k.user_id AND s.n >= k.frame""")
def two_sided_blend(spark, sf_dir):
    s = user_state(spark, sf_dir, "event_type")
    is_key = (F.col("n") == 0) | (F.col("event_type") == "signup")
    return joins.bracket(s, is_key, "a").select("user_id", "n", r4("a_rec", "a_rec"))


@query("j5_rows_at_keys", f"""WITH {STATE} SELECT user_id, n, round(a, 4) AS a FROM state s
SEMI JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON o.o_custkey = s.user_id AND o.orders > s.n""")
def rows_at_keys(spark, sf_dir):
    """State rows whose position is below the user's number of orders."""
    rows = user_state(spark, sf_dir).df
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("orders"))
    out = rows.join(counts, (rows["user_id"] == counts["user_id"]) & (counts["orders"] > rows["n"]), "left_semi")
    return out.select("user_id", "n", r4("a", "a"))


# -- event-time frames --------------------------------------------------------------------------
FRAMES = """WITH s AS (SELECT user_id, event_type, value, unnest(generate_series(time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 18 HOURS, time_bucket(INTERVAL 6 HOURS, ts), INTERVAL 6 HOURS)) AS start FROM events)
SELECT event_type, start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY 1, 2"""


@query("st5_sliding_frames", FRAMES)
def sliding_frames(spark, sf_dir):
    from seriesloom.streaming.frames import sliding_frames as frames

    return frames(table(spark, sf_dir, "events"), "24 hours", "6 hours").select(
        "event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events", r4("total", "total")
    )


@query("st5_tumbling_frames", """SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_frames(spark, sf_dir):
    from seriesloom.streaming.frames import sliding_frames as frames

    return frames(table(spark, sf_dir, "events"), "6 hours", "6 hours").select(
        "event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events", r4("total", "total")
    )


SESSIONS = """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""


@query("st6_sessions", SESSIONS)
def sessions(spark, sf_dir):
    from seriesloom.streaming.frames import sessions as split

    return split(table(spark, sf_dir, "events"), "12 hours").select(
        "user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events", r4("total", "total")
    )


@query("s14_inventory", f"""WITH {STATE},
k AS (SELECT user_id, count(*) AS n_keys FROM state WHERE n = 0 OR event_type = 'signup' GROUP BY 1),
s AS (SELECT user_id, count(*) AS n_frames, max(n) + 1 AS last_frame FROM state GROUP BY 1)
SELECT user_id, n_frames, last_frame, n_keys, round(n_frames / n_keys::DOUBLE, 4) AS sparsity, n_keys * 24 AS key_bytes,
  round(n_keys * 24 / 1024.0 / (n_frames * 1.0 / 60), 4) AS kb_per_min FROM s JOIN k USING (user_id)""")
def inventory(spark, sf_dir):
    rows = user_state(spark, sf_dir, "event_type").df
    out = agg.inventory(rows, rows.filter("n = 0 OR event_type = 'signup'"), ["user_id"], 1.0)
    return out.select("user_id", "n_frames", "last_frame", "n_keys", r4("sparsity", "sparsity"), "key_bytes", r4("kb_per_min", "kb_per_min"))


@query("s15_logical_sizes", f"""WITH {WAVES}
SELECT l_suppkey, count(*) AS n_frames, 1025 AS n_bins, count(*) * 8 AS state_bytes, count(*) * 56 AS stored_bytes, count(*) * 4 * 1025 AS stft_bytes,
  round(count(*) * 4 * 1025 / (count(*) * 8)::DOUBLE, 4) AS ratio_state, round(count(*) * 4 * 1025 / (count(*) * 56)::DOUBLE, 4) AS ratio_stored FROM waves GROUP BY 1""")
def logical_sizes(spark, sf_dir):
    out = agg.logical_sizes(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 2048)
    return out.withColumn("ratio_state", F.round("ratio_state", 4)).withColumn("ratio_stored", F.round("ratio_stored", 4))


@query("f20_resonance", """WITH u AS (SELECT DISTINCT user_id, 80.0 + user_id % 200 AS f0 FROM events),
h AS (SELECT user_id, f0, k, k * f0 AS fr, power(k, -1.0) AS amp FROM u, (SELECT unnest(range(1, 9)) AS k))
SELECT user_id, round(sum(amp * (1.0 * exp(-power(fr - 500, 2) / (2.0 * 80 * 80)) + 0.6 * exp(-power(fr - 1200, 2) / (2.0 * 120 * 120)))), 6) AS level FROM h GROUP BY 1""")
def resonance(spark, sf_dir):
    from seriesloom.operators import features as feat

    rows = table(spark, sf_dir, "events").select("user_id", (F.lit(80.0) + F.col("user_id") % 200).alias("f0")).distinct()
    tones = feat.harmonics(rows, F.col("f0"), 8, 1.0)
    level = F.col("amplitude") * feat.resonance(F.col("frequency"), [(500, 80, 1.0), (1200, 120, 0.6)])
    return tones.groupBy("user_id").agg(F.round(F.sum(level), 6).alias("level"))


@query("f23_grid_search", f"""WITH {STATE},
g AS (SELECT user_id, c, avg(power(a - c, 2)) AS loss FROM state, (SELECT unnest(range(-40, 45, 5)) AS c) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY loss, c) AS k FROM g)
SELECT user_id, CAST(c AS DOUBLE) AS c, round(loss, 4) AS loss FROM best WHERE k = 1""")
def grid_search(spark, sf_dir):
    """Level that fits a user's loudness best; all candidates are sums of one aggregate."""
    from seriesloom.operators import features as feat

    grid = [float(c) for c in range(-40, 45, 5)]
    rows = user_rows(spark, sf_dir).select("user_id", "a")
    out = feat.grid_search(rows, ["user_id"], "c", grid, lambda c: F.avg(F.pow(F.col("a") - c, 2)))
    return out.select("user_id", "c", r4("loss", "loss"))


@query("f23_local_minima", f"""WITH {STATE},
g AS (SELECT user_id, c, avg(abs(abs(a) - abs(c)) * (1 + 0.1 * (c % 3))) AS loss FROM state, (SELECT unnest(range(0, 45, 1)) AS c) GROUP BY 1, 2),
n AS (SELECT *, lag(loss) OVER k AS before, lead(loss) OVER k AS ahead FROM g WINDOW k AS (PARTITION BY user_id ORDER BY c))
SELECT user_id, CAST(c AS DOUBLE) AS c, round(loss, 4) AS loss FROM n WHERE loss < before AND loss < ahead""")
def local_minima(spark, sf_dir):
    from seriesloom.operators import features as feat

    grid = [float(c) for c in range(0, 45)]
    rows = user_rows(spark, sf_dir).select("user_id", "a")
    loss = lambda c: F.avg(F.abs(F.abs("a") - F.abs(F.lit(c))) * (1 + 0.1 * (c % 3)))
    out = feat.local_minima(feat.candidate_losses(rows, ["user_id"], "c", grid, loss), ["user_id"], "c", "loss")
    return out.select("user_id", "c", r4("loss", "loss"))
