"""Framing, spectra, revolutions, coding cost, bars and verification over supplier waveforms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import decibels
from seriesloom.operators import aggregates as agg
from seriesloom.operators import dedup, health, joins, verify
from seriesloom.operators import dynamics as dyn
from seriesloom.operators import features as feat
from seriesloom.plans.series import Series
from seriesloom.sources import recordings
from seriesloom.workload.registry import query
from seriesloom.workload.tables import WAVES, r4, table, waves

WIN, HOP = 32, 16
FRAMES = f"""
lens AS (SELECT l_suppkey, count(*) AS length FROM waves GROUP BY 1),
starts AS (SELECT l_suppkey, unnest(range(0, (length - {WIN}) // {HOP} + 1)) AS frame FROM lens WHERE length >= {WIN}),
framed AS (SELECT s.l_suppkey, s.frame, w.n - s.frame * {HOP} AS j, w.x FROM starts s JOIN waves w
           ON w.l_suppkey = s.l_suppkey AND w.n >= s.frame * {HOP} AND w.n < s.frame * {HOP} + {WIN})"""


@query("f1_overlapping_frames", f"WITH {WAVES}, {FRAMES} SELECT l_suppkey, frame, CAST(j AS INTEGER) AS j, x FROM framed")
def overlapping_frames(spark, sf_dir):
    return feat.frame_rows(waves(spark, sf_dir), WIN, HOP).select("l_suppkey", "frame", "j", "x")


@query("f2_windowed_frames", f"""WITH {WAVES}, {FRAMES}
SELECT l_suppkey, frame AS n, round(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {WIN - 1}))), 4) AS audio_sum,
       round(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {WIN}))), 4) AS burst_sum FROM framed GROUP BY 1, 2""")
def windowed_frames(spark, sf_dir):
    rows = feat.frame_arrays(waves(spark, sf_dir), WIN, HOP)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "l_suppkey",
        "n",
        r4(total(feat.windowed(F.col("x"), WIN)), "audio_sum"),
        r4(total(feat.windowed(F.col("x"), WIN, periodic=True)), "burst_sum"),
    )


DFT = FRAMES + f""",
parts AS (SELECT l_suppkey, frame AS n, bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {WIN - 1})) * cos(2 * pi() * bin * j / {WIN})) AS re,
                 sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {WIN - 1})) * sin(2 * pi() * bin * j / {WIN})) AS im
          FROM framed, (SELECT unnest(range({WIN // 2 + 1})) AS bin) GROUP BY 1, 2, 3),
spectra AS (SELECT l_suppkey, n, bin, sqrt(re * re + im * im) AS mag FROM parts)"""


@query("f3_magnitude_spectra", f"WITH {WAVES}, {DFT} SELECT l_suppkey, n, bin, round(mag, 4) AS mag FROM spectra")
def magnitude_spectra(spark, sf_dir):
    spectrum = feat.magnitudes(WIN)
    rows = feat.frame_arrays(waves(spark, sf_dir), WIN, HOP).select("l_suppkey", "n", F.posexplode(spectrum("x")).alias("bin", "mag"))
    return rows.withColumn("mag", F.round("mag", 4))


@query("f3_named_bins", f"WITH {WAVES}, {DFT} SELECT l_suppkey, n, bin, round(mag, 4) AS mag FROM spectra WHERE bin IN (1, 2, 5)")
def named_bins(spark, sf_dir):
    bins = [1, 2, 5]
    mags = feat.dft_magnitudes(F.col("x"), WIN, bins)
    rows = feat.frame_arrays(waves(spark, sf_dir), WIN, HOP).withColumn("mags", mags)
    pairs = F.inline(F.array(*[F.struct(F.lit(b).alias("bin"), F.col("mags")[i].alias("mag")) for i, b in enumerate(bins)]))
    return rows.select("l_suppkey", "n", pairs).withColumn("mag", F.round("mag", 4))


@query("f4_frame_loudness", f"""WITH {WAVES}, {FRAMES}
SELECT l_suppkey, frame AS n, round(greatest(20 * log10(sqrt(avg(x / 128 * x / 128) + 1e-10) + 1e-10), -80), 4) AS a FROM framed GROUP BY 1, 2""")
def frame_loudness(spark, sf_dir):
    s = waves(spark, sf_dir).with_columns(x=F.col("x") / 128)
    return feat.frame_loudness(s, WIN, HOP).select("l_suppkey", "n", r4("a", "a"))


@query("a11_wave_overview", f"""WITH {WAVES},
lens AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS length FROM waves),
b AS (SELECT *, CASE WHEN length <= 50 THEN n ELSE n // greatest(length // 50, 1) END AS bucket FROM lens)
SELECT l_suppkey, bucket, CASE WHEN any_value(length) <= 50 THEN min(x) ELSE least(0, min(x)) END AS lo,
       CASE WHEN any_value(length) <= 50 THEN max(x) ELSE greatest(0, max(x)) END AS hi
FROM b WHERE length <= 50 OR bucket < 50 GROUP BY 1, 2""")
def wave_overview(spark, sf_dir):
    return agg.overview(waves(spark, sf_dir), "x", 50)


@query("a2_crossing_rate", f"""WITH {WAVES},
s AS (SELECT l_suppkey, n, CASE WHEN x >= 0 THEN 1 ELSE -1 END AS sign FROM waves),
f AS (SELECT l_suppkey, sign <> lag(sign) OVER (PARTITION BY l_suppkey ORDER BY n) AS flip FROM s)
SELECT l_suppkey, count(*) AS n_samples, round(0.5 * sum(flip::INT) * 64 / count(*), 4) AS zcr_hz FROM f GROUP BY 1""")
def crossing_rate(spark, sf_dir):
    return agg.crossing_rate(waves(spark, sf_dir), "x", 64.0).select("l_suppkey", "n_samples", r4("zcr_hz", "zcr_hz"))


# -- revolutions --------------------------------------------------------------------------------
SR, F0, DRIFT, GRID = 64.0, 2.0, 0.001, 32
TURNS = f"""
sized AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS length FROM waves),
phase AS (SELECT *, {F0} * (n / {SR}) + 0.5 * {DRIFT} * (n / {SR}) * (n / {SR} - length / {SR}) AS phi FROM sized),
turns AS (SELECT l_suppkey, n, x, pcm, CAST(floor(greatest(phi, 0)) AS BIGINT) AS rev, phi - floor(phi) AS frac FROM phase)"""


def _turns(spark, sf_dir) -> Series:
    s = waves(spark, sf_dir).stats(length=F.count(F.lit(1)))
    return s.with_columns(**health.revolutions(F.col("length"), F.lit(F0), F.lit(DRIFT), F.lit(SR)))


@query("w15_revolution_index", f"WITH {WAVES}, {TURNS} SELECT l_suppkey, rev, count(*) AS samples, round(sum(frac), 4) AS turned FROM turns GROUP BY 1, 2")
def revolution_index(spark, sf_dir):
    rows = _turns(spark, sf_dir).df
    return rows.groupBy("l_suppkey", "rev").agg(F.count(F.lit(1)).alias("samples"), r4(F.sum("frac"), "turned"))


# The fold over revolutions as a recursion: one step per revolution, all (series, bin) side by side.
AVERAGE = f"""
splat AS (SELECT l_suppkey, rev, CAST(floor(frac * {GRID}) AS BIGINT) % {GRID} AS bin, x * (1 - (frac * {GRID} - floor(frac * {GRID}))) AS wx, 1 - (frac * {GRID} - floor(frac * {GRID})) AS wt FROM turns
          UNION ALL SELECT l_suppkey, rev, (CAST(floor(frac * {GRID}) AS BIGINT) % {GRID} + 1) % {GRID}, x * (frac * {GRID} - floor(frac * {GRID})), frac * {GRID} - floor(frac * {GRID}) FROM turns),
means AS (SELECT l_suppkey, rev, bin, sum(wx) / nullif(CASE WHEN sum(wt) > 1e-12 THEN sum(wt) ELSE 0 END, 0) AS v FROM splat GROUP BY 1, 2, 3),
ordinals AS (SELECT l_suppkey, rev, row_number() OVER (PARTITION BY l_suppkey ORDER BY rev) AS r FROM (SELECT DISTINCT l_suppkey, rev FROM turns)),
grid AS (SELECT o.l_suppkey, o.rev, o.r, b.bin, m.v FROM ordinals o CROSS JOIN (SELECT unnest(range({GRID})) AS bin) b
         LEFT JOIN means m ON m.l_suppkey = o.l_suppkey AND m.rev = o.rev AND m.bin = b.bin),
pool AS (SELECT l_suppkey, bin, CAST(1 AS BIGINT) AS r, rev, 0.0::DOUBLE AS prior, coalesce(v, 0.0) AS after FROM grid WHERE r = 1
         UNION ALL SELECT g.l_suppkey, g.bin, g.r, g.rev, p.after, CASE WHEN g.v IS NULL THEN p.after ELSE p.after + greatest(1.0 / g.r, 1.0 / 64) * (g.v - p.after) END
         FROM pool p JOIN grid g ON g.l_suppkey = p.l_suppkey AND g.bin = p.bin AND g.r = p.r + 1),
lookup AS (SELECT *, CAST(floor(frac * {GRID}) AS BIGINT) % {GRID} AS j0, frac * {GRID} - floor(frac * {GRID}) AS u FROM turns),
predicted AS (SELECT t.l_suppkey, t.n, t.rev, t.x, a.prior * (1 - u) + b.prior * u AS pred FROM lookup t
  JOIN pool a ON a.l_suppkey = t.l_suppkey AND a.rev = t.rev AND a.bin = t.j0
  JOIN pool b ON b.l_suppkey = t.l_suppkey AND b.rev = t.rev AND b.bin = (t.j0 + 1) % {GRID})"""


def _predicted(spark, sf_dir):
    s = _turns(spark, sf_dir)
    rows = s.df.select("l_suppkey", "n", "x", "rev", "frac")
    return health.phase_average(rows, ["l_suppkey"], F.lit(GRID), fits=not s.block)


@query("w16_phase_average", f"WITH RECURSIVE {WAVES}, {TURNS}, {AVERAGE} SELECT l_suppkey, n, rev, round(pred, 4) AS pred FROM predicted")
def phase_average(spark, sf_dir):
    return _predicted(spark, sf_dir).select("l_suppkey", "n", "rev", r4("pred", "pred"))


RICE = TURNS + """,
deltas AS (SELECT *, pcm - coalesce(lag(pcm) OVER (PARTITION BY l_suppkey ORDER BY n), 0) AS d FROM turns),
placed AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey, rev ORDER BY n) - 1) // 256 AS part, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u FROM deltas),
costs AS (SELECT l_suppkey, rev, part, k, 5 + sum(CASE WHEN (u >> k) >= 32 THEN 50 ELSE (u >> k) + 1 + k END) AS bits
          FROM (SELECT *, CAST(u AS BIGINT) AS uu FROM placed), (SELECT unnest(range(17))::INTEGER AS k) GROUP BY 1, 2, 3, 4),
least_ AS (SELECT l_suppkey, rev, part, min(bits) AS bits FROM costs GROUP BY 1, 2, 3),
coded AS (SELECT l_suppkey, rev, CAST(sum(bits) AS BIGINT) AS bits FROM least_ GROUP BY 1, 2)"""


def _turn():
    return Window.partitionBy("l_suppkey", "rev").orderBy("n")


def _coded(spark, sf_dir):
    """Samples with their residual and their place in their revolution, and whether every series fits one task."""
    s = _turns(spark, sf_dir)
    s = s.around(1, 0, d=lambda w: F.col("pcm") - F.coalesce(F.lag("pcm").over(w), F.lit(0)))
    if not s.block:  # a revolution lies where its series does, so its rows need no exchange of their own
        rows = s.df.withColumn("pos", F.row_number().over(_turn()) - 1)
    else:
        first = s.df.groupBy("l_suppkey", "rev").agg(F.min("n").alias("first"))
        rows = s.df.join(first, ["l_suppkey", "rev"]).withColumn("pos", F.col("n") - F.col("first"))
    return rows, not s.block


@query("b5_coding_cost", f"WITH {WAVES}, {RICE} SELECT l_suppkey, rev, bits FROM coded")
def coding_cost(spark, sf_dir):
    return health.rice_cost(_coded(spark, sf_dir)[0], ["l_suppkey", "rev"], "pos", "d")


REVS = RICE + f""",
crossings AS (SELECT *, CASE WHEN (CASE WHEN x >= 0 THEN 1 ELSE -1 END) <> lag(CASE WHEN x >= 0 THEN 1 ELSE -1 END) OVER (PARTITION BY l_suppkey, rev ORDER BY n) THEN 1 ELSE 0 END AS flip FROM turns),
revs AS (SELECT c.l_suppkey, c.rev, count(*) AS n_samples, sqrt(avg(x * x)) / 32768 AS rms_fs, 0.5 * sum(flip) * {SR} / count(*) AS zcr_hz, any_value(d.bits) AS bits
         FROM crossings c JOIN coded d USING (l_suppkey, rev) GROUP BY 1, 2)"""


def _revs(spark, sf_dir) -> Series:
    from seriesloom.plans.series import dense_series

    rows, fits = _coded(spark, sf_dir)
    if fits:
        sign = F.when(F.col("x") >= 0, 1).otherwise(-1)
        facts = {"flips": (sign != F.lag(sign).over(_turn())).cast("int"), "energy": F.col("x") * F.col("x")}
        rows = rows.select("l_suppkey", "n", "rev", "pos", "d", *[c.alias(k) for k, c in facts.items()])
        known = F.col("energy").isNotNull().cast("int")
        sums = {"n_samples": F.lit(1), "known": known, **{k: F.col(k) for k in facts}}
        revs = health.rice_cost(rows, ["l_suppkey", "rev"], "pos", "d", **sums)
        revs = revs.select(
            "l_suppkey",
            F.col("rev").alias("n"),
            "n_samples",
            F.coalesce(F.lit(0.5) * F.col("flips") * SR / F.col("n_samples"), F.lit(0.0)).alias("zcr_hz"),
            (F.sqrt(F.try_divide("energy", "known")) / 32768).alias("rms_fs"),
            "bits",
            F.lit(0.0).alias("t_h"),
        )
        return dense_series(revs, ["l_suppkey"], layout="plain")  # no more revolutions than samples
    bits = health.rice_cost(rows, ["l_suppkey", "rev"], "pos", "d")
    keep = rows.select("l_suppkey", "rev", F.col("pos").alias("n"), "x")
    by_rev = dense_series(keep, ["l_suppkey", "rev"])
    rate = agg.crossing_rate(by_rev, "x", SR)
    level = keep.groupBy("l_suppkey", "rev").agg((F.sqrt(F.avg(F.col("x") * F.col("x"))) / 32768).alias("rms_fs"))
    revs = rate.join(level, ["l_suppkey", "rev"]).join(bits, ["l_suppkey", "rev"])
    revs = revs.withColumn("zcr_hz", F.coalesce("zcr_hz", F.lit(0.0))).withColumnRenamed("rev", "n").withColumn("t_h", F.lit(0.0))
    return dense_series(revs, ["l_suppkey"])


@query("b4_revolution_states", f"""WITH {WAVES}, {REVS}
SELECT l_suppkey, rev, round(coalesce(sum(n_samples / {SR} / 3600) OVER (PARTITION BY l_suppkey ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS t,
  round(20 * log10(greatest(rms_fs, 1e-9)), 4) AS a, round(12 * log2(greatest(zcr_hz, 1) / 1000), 4) AS i, round(bits / n_samples, 4) AS bits_per_sample FROM revs""")
def revolution_states(spark, sf_dir):
    s = health.revolution_states(_revs(spark, sf_dir), SR)
    return s.select("l_suppkey", F.col("n").alias("rev"), F.round("t", 6).alias("t"), r4("a", "a"), r4("i", "i"), r4("bits_per_sample", "bits_per_sample"))


@query("a3_steady_rate", f"WITH {WAVES}, {REVS} SELECT l_suppkey, round(sum(bits) FILTER (rev >= 8) / sum(n_samples) FILTER (rev >= 8), 4) AS bits_per_sample FROM revs GROUP BY 1")
def steady_rate(spark, sf_dir):
    out = agg.steady_rate(_revs(spark, sf_dir), "bits", "n_samples")
    return out.select("l_suppkey", r4("bits_per_sample", "bits_per_sample"))


@query("b3_impact_angle", f"""WITH {WAVES}, {TURNS},
e AS (SELECT *, abs(x) AS env, avg(abs(x)) OVER (PARTITION BY l_suppkey) AS floor_ FROM turns),
w AS (SELECT *, power(greatest(env - floor_, 0), 2) AS wt FROM e),
s AS (SELECT l_suppkey, sum(wt * cos(2 * pi() * frac)) AS c, sum(wt * sin(2 * pi() * frac)) AS s, sum(wt) AS total FROM w GROUP BY 1),
d AS (SELECT *, -degrees(atan2(s, c)) AS deg FROM s)
SELECT l_suppkey, round(deg - floor(deg / 360) * 360, 4) AS angle_deg, round(sqrt(c * c + s * s) / total, 4) AS confidence FROM d""")
def impact_angle(spark, sf_dir):
    rows = _turns(spark, sf_dir).with_columns(env=F.abs("x"))
    return health.impact_angle(rows).select("l_suppkey", r4("angle_deg", "angle_deg"), r4("confidence", "confidence"))


def _bursts(spark, sf_dir, size: int = 512):
    """Waveforms cut into bursts of ``size`` samples; the last one of a series may be shorter."""
    rows = waves(spark, sf_dir).df.withColumn("snap", F.floor(F.col("n") / size)).groupBy("l_suppkey", "snap")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("n", "pcm"))).alias("packed"))
    return packed.select(
        "l_suppkey", "snap", F.transform("packed", lambda p: p["pcm"]).alias("x"), F.lit(SR).alias("sr"), F.lit(F0).alias("f_nominal")
    )


BURSTS = """
cut AS (SELECT l_suppkey, n // 512 AS snap, n % 512 AS pos, pcm, count(*) OVER (PARTITION BY l_suppkey, n // 512) AS held FROM waves),
bursts AS (SELECT l_suppkey, snap, pos, pcm, held FROM cut)"""


@query("f18_band_envelopes", f"""WITH {WAVES}, {BURSTS},
k AS (SELECT unnest(range(0, 257)) AS k),
band AS (SELECT * FROM bursts, k WHERE k <= held // 2 AND k * ({SR} / held) >= 0.2::DOUBLE * {SR} / 2 AND k * ({SR} / held) <= 0.6::DOUBLE * {SR} / 2),
spec AS (SELECT l_suppkey, snap, held, k, sum(pcm * cos(2 * pi() * ((pos * k) % held) / held)) AS re, -sum(pcm * sin(2 * pi() * ((pos * k) % held) / held)) AS im FROM band GROUP BY 1, 2, 3, 4),
back AS (SELECT b.l_suppkey, b.snap, b.pos, coalesce(sum(2 * (re * cos(2 * pi() * ((b.pos * k) % b.held) / b.held) - im * sin(2 * pi() * ((b.pos * k) % b.held) / b.held))) / any_value(b.held), 0) AS re,
         coalesce(sum(2 * (re * sin(2 * pi() * ((b.pos * k) % b.held) / b.held) + im * cos(2 * pi() * ((b.pos * k) % b.held) / b.held))) / any_value(b.held), 0) AS im
         FROM bursts b LEFT JOIN spec s ON s.l_suppkey = b.l_suppkey AND s.snap = b.snap GROUP BY 1, 2, 3)
SELECT l_suppkey, snap, CAST(pos AS INTEGER) AS at_pos, round(sqrt(re * re + im * im), 4) AS level FROM back""")
def band_envelopes(spark, sf_dir):
    envelope = feat.band_envelope()
    rows = _bursts(spark, sf_dir).withColumn("env", envelope(F.col("x").cast("array<double>"), "sr"))
    return rows.select("l_suppkey", "snap", F.posexplode("env").alias("at_pos", "level")).withColumn("level", F.round("level", 4))


@query("f19_shaft_speed")
def shaft_speed(spark, sf_dir):
    return feat.shaft_speed(_bursts(spark, sf_dir)).select("l_suppkey", "snap", r4("f_hz", "f_hz"), F.round("drift", 6).alias("drift"))


@query("b6_b7_b8_snapshot_metrics")
def snapshot_metrics(spark, sf_dir):
    out = health.snapshot_metrics(_bursts(spark, sf_dir), watch_order=3.5848)
    return out.select("l_suppkey", "snap", *[r4(c, c) for c in health.METRIC_FIELDS], F.size("revs").alias("revs"))


@query("b8_plain_indicators", f"""WITH {WAVES}, {BURSTS}
SELECT l_suppkey, snap, round(sqrt(avg(pcm * pcm)) / 32768, 6) AS rms_fs, round(kurtosis_pop(pcm) + 3, 4) AS kurtosis,
  round(max(abs(pcm)) / sqrt(avg(pcm * pcm)), 4) AS crest FROM bursts GROUP BY 1, 2""")
def plain_indicators(spark, sf_dir):
    found = health.plain_indicators(F.col("x"))
    out = _bursts(spark, sf_dir).select("l_suppkey", "snap", *[c.alias(k) for k, c in found.items()])
    return out.select("l_suppkey", "snap", F.round("rms_fs", 6).alias("rms_fs"), r4("kurtosis", "kurtosis"), r4("crest", "crest"))


@query("a10_condition_ranking")
def condition_ranking(spark, sf_dir):
    out = health.snapshot_metrics(_bursts(spark, sf_dir), watch_order=3.5848)
    per = out.groupBy("l_suppkey").agg(F.avg("bits_exact").alias("bits"), F.avg("kurtosis").alias("kurtosis"), F.max("line_strength").alias("line"))
    return per.select("l_suppkey", r4("bits", "bits"), r4("kurtosis", "kurtosis"), r4("line", "line")).orderBy(F.col("line").desc(), "l_suppkey")


# -- bars and content ---------------------------------------------------------------------------
TREE = """
l1 AS (SELECT l_suppkey, n // 4096 AS part, sha256(string_agg(CAST({value} AS VARCHAR), ',' ORDER BY n)) AS hash FROM {rows} GROUP BY 1, 2),
l2 AS (SELECT l_suppkey, part // 4096 AS part, sha256(string_agg(hash, ',' ORDER BY part)) AS hash FROM l1 GROUP BY 1, 2),
l3 AS (SELECT l_suppkey, sha256(string_agg(hash, ',' ORDER BY part)) AS content_hash FROM l2 GROUP BY 1)"""


@query("h1_content_hash", f"WITH {WAVES}, {TREE.format(value='pcm', rows='waves')} SELECT l_suppkey, content_hash FROM l3")
def content_hash(spark, sf_dir):
    return dedup.content_hash(waves(spark, sf_dir).df, ["l_suppkey"], F.col("pcm"))


@query("h1_range_hash", f"""WITH {WAVES}
SELECT l_suppkey, n // 8 AS bar, sha256(string_agg(CAST(pcm AS VARCHAR), ',' ORDER BY n)) AS hash FROM waves GROUP BY 1, 2""")
def range_hash(spark, sf_dir):
    return dedup.bar_table(waves(spark, sf_dir), F.col("pcm"), 8).select("l_suppkey", "bar", "hash")


SPB = 6
POOL = f"""
bits AS (SELECT l_suppkey, n, n // {SPB} AS bar, CASE WHEN q > 25 THEN 1 ELSE 0 END AS v FROM waves),
bars AS (SELECT l_suppkey, bar, count(*) AS len, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY n)) AS hash FROM bits GROUP BY 1, 2),
tagged AS (SELECT *, CASE WHEN len = {SPB} THEN hash ELSE 'tail-' || bar END AS tag FROM bars),
firsts AS (SELECT l_suppkey, tag, min(bar) AS first_bar FROM tagged GROUP BY 1, 2),
pool AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_bar) - 1 AS loop FROM firsts),
recall AS (SELECT t.l_suppkey, t.bar, p.loop, t.len, t.bar = p.first_bar AS first FROM tagged t JOIN pool p USING (l_suppkey, tag))"""


def _recall(spark, sf_dir):
    s = waves(spark, sf_dir)
    bars = dedup.bar_table(s, F.when(F.col("q") > 25, 1).otherwise(0), SPB)
    return s, *dedup.pool_bars(bars, ["l_suppkey"])


@query("h2_bar_recall", f"WITH {WAVES}, {POOL} SELECT l_suppkey, bar, loop, len, first FROM recall")
def bar_recall(spark, sf_dir):
    return _recall(spark, sf_dir)[2]


@query("h2_bar_pool", f"WITH {WAVES}, {POOL} SELECT l_suppkey, loop, first_bar FROM pool")
def bar_pool(spark, sf_dir):
    return _recall(spark, sf_dir)[1].select("l_suppkey", "loop", "first_bar")


@query("j8_rebuild_from_pool", f"WITH {WAVES}, {POOL} SELECT l_suppkey, n, v FROM bits")
def rebuild_from_pool(spark, sf_dir):
    s, pool, recall = _recall(spark, sf_dir)
    rows = s.df.select(
        "l_suppkey", F.floor(F.col("n") / SPB).alias("first_bar"), (F.col("n") % SPB).alias("at"), F.when(F.col("q") > 25, 1).otherwise(0).alias("v")
    )
    payload = rows.join(pool.select("l_suppkey", "first_bar", "loop"), ["l_suppkey", "first_bar"]).drop("first_bar")
    out = dedup.rebuild(payload, recall, ["l_suppkey"])
    return out.select("l_suppkey", (F.col("bar") * SPB + F.col("at")).alias("n"), "v")


@query("a4_dedup_report", f"""WITH {WAVES}, {POOL}
SELECT l_suppkey, count(*) AS total_bars, CAST(sum(first::INT) AS BIGINT) AS unique_bars, CAST(count(*) - sum(first::INT) AS BIGINT) AS duplicate_bars,
  round((count(*) - sum(first::INT)) / count(*), 4) AS dedup_ratio, CAST(sum(len) * 4 AS BIGINT) AS bytes_full,
  CAST(sum(CASE WHEN first THEN len ELSE 0 END) * 4 AS BIGINT) AS bytes_pool, round(1 - sum(CASE WHEN first THEN len ELSE 0 END) / sum(len), 4) AS saving
FROM recall GROUP BY 1""")
def dedup_report(spark, sf_dir):
    out = dedup.dedup_report(_recall(spark, sf_dir)[2], ["l_suppkey"], 4)
    return out.withColumn("dedup_ratio", F.round("dedup_ratio", 4)).withColumn("saving", F.round("saving", 4))


@query("w18_bar_bounds", f"""WITH {WAVES},
lens AS (SELECT l_suppkey, count(*) AS length, 60.0 + l_suppkey % 90 AS bpm FROM waves GROUP BY 1),
spb AS (SELECT *, CAST(round_even(4 * 60.0 / bpm * 10, 0) AS BIGINT) AS spb FROM lens),
s AS (SELECT *, unnest(range(0, length, spb)) AS start FROM spb)
SELECT l_suppkey, start // spb AS bar, start, least(start + spb, length) AS "end" FROM s""")
def bar_bounds(spark, sf_dir):
    lens = waves(spark, sf_dir).totals(length=F.count(F.lit(1))).withColumn("bpm", F.lit(60.0) + F.col("l_suppkey") % 90)
    bars = dedup.bar_bounds(lens, dedup.bar_length(F.col("bpm"), 4, 10))
    return bars.select("l_suppkey", "bar", "start", "end")


@query("v1_content_mismatches", f"""WITH {WAVES},
other AS (SELECT l_suppkey, n, CASE WHEN q > 40 AND n = 10 THEN pcm + 1 ELSE pcm END AS pcm FROM waves),
a AS (SELECT l_suppkey, n // 4096 AS part, sha256(string_agg(CAST(pcm AS VARCHAR), ',' ORDER BY n)) AS h FROM waves GROUP BY 1, 2),
b AS (SELECT l_suppkey, n // 4096 AS part, sha256(string_agg(CAST(pcm AS VARCHAR), ',' ORDER BY n)) AS h FROM other GROUP BY 1, 2)
SELECT l_suppkey, part, a.h AS left_hash, b.h AS right_hash FROM a FULL JOIN b USING (l_suppkey, part) WHERE a.h IS DISTINCT FROM b.h""")
def content_mismatches(spark, sf_dir):
    left = waves(spark, sf_dir).df.select("l_suppkey", "n", "pcm", "q")
    changed = (F.col("q") > 40) & (F.col("n") == 10)
    right = left.withColumn("pcm", F.when(changed, F.col("pcm") + 1).otherwise(F.col("pcm")))
    return verify.content_mismatches(left, right, ["l_suppkey"], F.col("pcm"))


@query("v2_log_spectral_distance", f"""WITH {WAVES}, {FRAMES},
pair AS (SELECT l_suppkey, frame, j, x AS xa, round(x / 8) * 8 AS xb FROM framed),
parts AS (SELECT l_suppkey, frame, bin, sum(xa * w * c) AS ra, sum(xa * w * s) AS ia, sum(xb * w * c) AS rb, sum(xb * w * s) AS ib FROM (
  SELECT l_suppkey, frame, bin, xa, xb, 0.5 - 0.5 * cos(2 * pi() * j / {WIN - 1}) AS w, cos(2 * pi() * bin * j / {WIN}) AS c, sin(2 * pi() * bin * j / {WIN}) AS s
  FROM pair, (SELECT unnest(range({WIN // 2 + 1})) AS bin)) GROUP BY 1, 2, 3)
SELECT l_suppkey, round(sqrt(avg(power(20 * log10(sqrt(ra * ra + ia * ia) + 1e-6) - 20 * log10(sqrt(rb * rb + ib * ib) + 1e-6), 2))), 4) AS distance_db FROM parts GROUP BY 1""")
def log_spectral_distance(spark, sf_dir):
    s = waves(spark, sf_dir)
    coarse = s.with_columns(x=F.round(F.col("x") / 8) * 8)
    return verify.log_spectral_distance(s, coarse, WIN, HOP).select("l_suppkey", r4("distance_db", "distance_db"))


@query("v3_relative_l2", f"WITH {WAVES} SELECT l_suppkey, round(sqrt(sum(power(x - round(x / 8) * 8, 2)) / sum(power(round(x / 8) * 8, 2))), 4) AS rel_l2 FROM waves GROUP BY 1")
def relative_l2(spark, sf_dir):
    rows = waves(spark, sf_dir).df
    return verify.relative_l2(rows, ["l_suppkey"], F.col("x"), F.round(F.col("x") / 8) * 8).withColumn("rel_l2", F.round("rel_l2", 4))


@query("h9_aligned_residuals", f"""WITH {WAVES},
b AS (SELECT l_suppkey, n // 64 AS bar, n % 64 AS at, pcm, count(*) OVER (PARTITION BY l_suppkey, n // 64) AS held FROM waves),
full_ AS (SELECT * FROM b WHERE held = 64),
pairs AS (SELECT DISTINCT x.l_suppkey, x.bar FROM full_ x JOIN full_ y ON x.l_suppkey = y.l_suppkey AND y.bar = x.bar - 1),
xc AS (SELECT p.l_suppkey, p.bar, l.lag, sum(x.pcm::BIGINT * y.pcm) AS c, sum(y.pcm::BIGINT * y.pcm) AS yy FROM pairs p, (SELECT unnest(range(-16, 17)) AS lag) l, full_ x, full_ y
       WHERE x.l_suppkey = p.l_suppkey AND x.bar = p.bar AND y.l_suppkey = p.l_suppkey AND y.bar = p.bar - 1 AND y.at = x.at - l.lag GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, bar ORDER BY c DESC, CASE WHEN lag >= 0 THEN lag ELSE 100 + lag END) AS k FROM xc),
g AS (SELECT l_suppkey, bar, lag, CAST(round_even(least(greatest(CASE WHEN yy > 0 THEN c / yy::DOUBLE ELSE 0 END, -2), 2) * 4096, 0) AS BIGINT) AS gain FROM best WHERE k = 1),
r AS (SELECT g.l_suppkey, g.bar, g.lag, g.gain, x.pcm, x.pcm - CAST(floor((g.gain * coalesce(y.pcm, 0) + 2048) / 4096.0) AS BIGINT) AS res
      FROM g JOIN full_ x ON x.l_suppkey = g.l_suppkey AND x.bar = g.bar LEFT JOIN full_ y ON y.l_suppkey = g.l_suppkey AND y.bar = g.bar - 1 AND y.at = x.at - g.lag)
SELECT l_suppkey, bar, lag, gain, round(sqrt(avg(res * res)) / CASE WHEN avg(pcm * pcm) > 0 THEN sqrt(avg(pcm * pcm)) ELSE 1 END, 4) AS rms_ratio FROM r GROUP BY 1, 2, 3, 4""")
def aligned_residuals(spark, sf_dir):
    """Every bar of 64 samples against the bar before it, within 16 samples of shift."""
    rows = waves(spark, sf_dir).df.withColumn("bar", F.floor(F.col("n") / 64)).groupBy("l_suppkey", "bar")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("n", "pcm"))).alias("p")).filter(F.size("p") == 64)
    bars = packed.select("l_suppkey", "bar", F.transform("p", lambda p: p["pcm"]).alias("x"))
    before = bars.select("l_suppkey", (F.col("bar") + 1).alias("bar"), F.col("x").alias("y"))
    out = dedup.aligned_residuals(bars.join(before, ["l_suppkey", "bar"]), ["l_suppkey", "bar"], 16)
    return out.withColumn("rms_ratio", F.round("rms_ratio", 4))


@query("h9_known_lag_gain", f"""WITH {WAVES}
SELECT a.l_suppkey, a.n // 64 AS bar, round(sum(a.pcm * b.pcm) / sum(b.pcm * b.pcm), 4) AS gain
FROM waves a JOIN waves b ON a.l_suppkey = b.l_suppkey AND b.n = a.n - 64 GROUP BY 1, 2""")
def known_lag_gain(spark, sf_dir):
    rows = waves(spark, sf_dir).df.select("l_suppkey", "n", F.col("pcm").cast("double").alias("a"))
    other = rows.select("l_suppkey", (F.col("n") + 64).alias("n"), F.col("a").alias("b"))
    both = rows.join(other, ["l_suppkey", "n"]).withColumn("bar", F.floor(F.col("n") / 64))
    return dedup.known_lag_gain(both, ["l_suppkey", "bar"], "a", "b").withColumn("gain", F.round("gain", 4))


@query("w17_beat_grid", """WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS pos, 100.0 * (l_suppkey % 5) AS beat FROM lineitem),
q AS (SELECT *, CASE WHEN beat > 0 THEN round(pos / beat) * beat ELSE pos END AS snapped FROM p)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(snapped, 2) AS snapped, round(snapped + 4 * beat, 2) AS loop_end,
  round(CASE WHEN beat > 0 THEN greatest(pos - 16 * beat, 0) ELSE pos END, 2) AS jumped FROM q""")
def beat_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("pos"), (F.col("l_suppkey") % 5 * 100.0).alias("beat")
    )
    grid = dyn.beat_grid(F.col("pos"), F.col("beat"), loop_beats=4, jump_beats=-16)
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", *[F.round(v, 2).alias(k) for k, v in grid.items()])


@query("j9_tempo_match", """WITH o AS (
  SELECT o_custkey, o_orderkey, o_totalprice AS pos, 90.0 + o_orderkey % 60 AS bpm, 100.0 + o_orderkey % 7 AS beat,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT a.o_orderkey, b.bpm / a.bpm AS rate, a.beat AS beat,
  ((b.pos - floor(b.pos / b.beat) * b.beat) / b.beat - (a.pos - floor(a.pos / a.beat) * a.beat) / a.beat) * a.beat AS delta
  FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.k = a.k + 1),
r AS (SELECT *, CASE WHEN abs(rate - 1) <= 0.10 THEN 0.10::DOUBLE WHEN abs(rate - 1) <= 0.16 THEN 0.16::DOUBLE ELSE 1.0::DOUBLE END AS rate_range FROM p)
SELECT o_orderkey, round(rate, 4) AS rate, rate_range, round(greatest(-1, least(1, (rate - 1) / rate_range)), 4) AS fader,
  round(CASE WHEN delta > beat / 2 THEN delta - beat WHEN delta < -beat / 2 THEN delta + beat ELSE delta END, 4) AS delta FROM r""")
def tempo_match(spark, sf_dir):
    """Each order against the customer's next one: two decks in a row."""
    from seriesloom.plans.series import index_series

    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderdate",
        "o_orderkey",
        F.col("o_totalprice").alias("a_pos"),
        (F.lit(90.0) + F.col("o_orderkey") % 60).alias("a_bpm"),
        (F.lit(100.0) + F.col("o_orderkey") % 7).alias("a_beat"),
    )
    s = index_series(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    s = s.around(0, 1, **{f"b_{c}": (lambda w, c=c: F.lead(f"a_{c}").over(w)) for c in ("pos", "bpm", "beat")})
    out = joins.tempo_match(s.df.filter("b_bpm IS NOT NULL"))
    return out.select("o_orderkey", r4("rate", "rate"), "rate_range", r4("fader", "fader"), r4("delta", "delta"))


@query("s6_count_scale", f"""WITH {WAVES},
step AS (SELECT greatest((max(l_suppkey) + 1) // 40, 1) AS step FROM waves),
probe AS (SELECT abs(x) AS m, row_number() OVER (ORDER BY abs(x)) - 1 AS place, count(*) OVER () AS total FROM waves, step WHERE l_suppkey % step = 0),
scale AS (SELECT 0.95 * 32767 / greatest(max(m), 1e-9) AS scale FROM probe WHERE place = CAST(floor(total * 0.999) AS BIGINT))
SELECT l_suppkey, n, CAST(greatest(least(round(x * scale), 32767), -32768) AS INTEGER) AS counts FROM waves, scale""")
def count_scale(spark, sf_dir):
    rows = waves(spark, sf_dir).df.select("l_suppkey", "n", "x")
    scale = recordings.count_scale(rows, "l_suppkey", "x")
    return rows.select("l_suppkey", "n", recordings.to_counts(F.col("x"), scale).alias("counts"))


@query("s6_peak_scale", f"""WITH {WAVES}, s AS (SELECT *, 0.95 * 32767 / greatest(max(abs(x)) OVER (PARTITION BY l_suppkey), 1e-9) AS scale FROM waves)
SELECT l_suppkey, n, CAST(greatest(least(round(x * scale), 32767), -32768) AS INTEGER) AS counts FROM s""")
def peak_scale(spark, sf_dir):
    rows = recordings.peak_scale(waves(spark, sf_dir), "x").df
    return rows.select("l_suppkey", "n", recordings.to_counts(F.col("x"), F.col("scale")).alias("counts"))


@query("j10_meta_join", f"""WITH {WAVES}
SELECT l_suppkey, n, n_name, round(n * (0.01 + n_nationkey * 0.001)::DOUBLE, 4) AS alpha
FROM waves JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def meta_join(spark, sf_dir):
    meta = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias("l_suppkey"), "n_name", (F.lit(0.01) + F.col("n_nationkey") * 0.001).alias("w"))
    s = waves(spark, sf_dir).attach(meta)
    return s.select("l_suppkey", "n", "n_name", r4(F.col("w") * F.col("n"), "alpha"))


@query("j9_tempo_pairs", """WITH i AS (SELECT c_custkey AS item, 90.0::DOUBLE + (c_custkey * 37 % 600) / 10.0::DOUBLE AS bpm, c_acctbal + 1000 AS pos, 100.0::DOUBLE + c_custkey % 7 AS beat FROM customer),
p AS (SELECT a.item, b.item AS partner, b.bpm / a.bpm AS rate, a.beat, row_number() OVER (PARTITION BY a.item ORDER BY abs(b.bpm / a.bpm - 1.0), b.item) AS rank,
  ((b.pos - floor(b.pos / b.beat) * b.beat) / b.beat - (a.pos - floor(a.pos / a.beat) * a.beat) / a.beat) * a.beat AS delta
  FROM i a JOIN i b ON a.item <> b.item AND abs(b.bpm / a.bpm - 1.0) <= 0.1)
SELECT item, partner, rank, round(rate, 4) AS rate, round((rate - 1) / 0.1, 4) AS fader,
  round(CASE WHEN delta > beat / 2 THEN delta - beat WHEN delta < -beat / 2 THEN delta + beat ELSE delta END, 4) AS delta FROM p WHERE rank <= 3""")
def tempo_pairs(spark, sf_dir):
    """Customers as recordings: the three that each can be locked to with the least change of rate."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.lit(90.0) + (F.col("c_custkey") * 37 % 600) / F.lit(10.0)).alias("bpm"),
        (F.col("c_acctbal") + 1000).alias("pos"),
        (F.lit(100.0) + F.col("c_custkey") % 7).alias("beat"),
    )
    out = joins.tempo_pairs(rows, "c_custkey", "bpm", "pos", "beat")
    return out.select(F.col("a_item").alias("item"), F.col("b_item").alias("partner"), "rank", r4("rate", "rate"), r4("fader", "fader"), r4("delta", "delta"))
