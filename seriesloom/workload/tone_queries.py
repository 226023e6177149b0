"""Spectra, pitch classes, envelopes, signatures and neighbours over the embedding table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions.columns import centred, dot, doubles, unit
from seriesloom.operators import aggregates as agg
from seriesloom.operators import dedup, health
from seriesloom.operators import features as feat
from seriesloom.operators import joins
from seriesloom.operators import similarity as sim
from seriesloom.plans.series import Series
from seriesloom.workload.registry import query
from seriesloom.workload.tables import BIN_HZ, BINS, TONES, TONES_LONG, gradient_sql, r4, table, tones, tones_long

LOW_HZ = 50.0  # bin width of the band queries, so that every band but the top one has bins


@query("f5_spectral_centre", f"""WITH {TONES_LONG},
tot AS (SELECT label, n, sum(mag) AS energy, sum(mag * bin * {BIN_HZ}) AS moment FROM bins GROUP BY 1, 2),
med AS (SELECT label, median(energy) FILTER (energy > 0) AS mid FROM tot GROUP BY 1),
p AS (SELECT label, n, CASE WHEN energy > 0.95 * coalesce(mid, 0) THEN 12 * log2(greatest(moment / energy, 1e-10) / 440) END AS pitch
      FROM tot JOIN med USING (label))
SELECT label, n, round(coalesce(last_value(pitch IGNORE NULLS) OVER (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING), 0), 4) AS i,
       pitch IS NOT NULL AS valid FROM p""")
def spectral_centre(spark, sf_dir):
    s = feat.spectral_centre(tones(spark, sf_dir), BIN_HZ, gate=0.95)
    return s.select("label", "n", r4("i", "i"), "valid")


@query("d11_gated_calibration", f"""WITH {TONES_LONG},
tot AS (SELECT label, n, sum(mag) AS energy, sum(mag * bin * {BIN_HZ}) AS moment FROM bins GROUP BY 1, 2),
med AS (SELECT label, 0.95 * coalesce(median(energy) FILTER (energy > 0), 0) AS energy_thresh FROM tot GROUP BY 1),
p AS (SELECT label, n, energy_thresh, CASE WHEN energy > energy_thresh THEN 12 * log2(greatest(moment / energy, 1e-10) / 440) END AS pitch FROM tot JOIN med USING (label)),
state AS (SELECT label, n, a, energy_thresh, coalesce(last_value(pitch IGNORE NULLS) OVER (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS i FROM p JOIN tones USING (label, n)),
grads AS (SELECT *, {gradient_sql('a', 'label')} AS da, {gradient_sql('i', 'label')} AS di FROM state),
spread AS (SELECT label, CASE WHEN stddev_pop(da) = 0 THEN 1 ELSE stddev_pop(da) END AS s_a, CASE WHEN stddev_pop(di) = 0 THEN 1 ELSE stddev_pop(di) END AS s_i FROM grads GROUP BY 1)
SELECT label, round(max(energy_thresh), 4) AS energy_thresh, count(*) AS m, round(max(s_a), 4) AS s_a, round(max(s_i), 4) AS s_i,
  round(sum(sqrt(power(da / s_a, 2) + power(di / s_i, 2))), 4) AS h_total, round(avg(sqrt(power(da / s_a, 2) + power(di / s_i, 2))), 4) AS mean_f
FROM grads JOIN spread USING (label) GROUP BY 1""")
def gated_calibration(spark, sf_dir):
    out = feat.frame_calibration(tones(spark, sf_dir), BIN_HZ, gate=0.95)
    return out.select("label", "m", *[r4(c, c) for c in ("energy_thresh", "s_a", "s_i", "h_total", "mean_f")])


WEIGHTS = f"""
grid AS (SELECT b AS bin, pc, 12 * log2(b * {BIN_HZ} / 440) - pc AS d FROM (SELECT unnest(range(1, 64)) AS b), (SELECT unnest(range(12)) AS pc)),
ring AS (SELECT bin, pc, d - floor(d / 12) * 12 AS r FROM grid),
raw AS (SELECT bin, pc, exp(-power(least(r, 12 - r), 2) / (2 * 0.5 * 0.5)) AS w FROM ring),
weights AS (SELECT bin, pc, w / greatest(sum(w) OVER (PARTITION BY bin), 1e-10) AS w FROM raw)"""


@query("f6_f7_soft_chroma", f"""WITH {TONES_LONG}, {WEIGHTS}
SELECT label, n, pc, round(sum(w * mag), 4) AS chroma FROM bins JOIN weights USING (bin) GROUP BY 1, 2, 3""")
def soft_chroma(spark, sf_dir):
    weights = feat.pitch_weights(spark, BINS, BIN_HZ)
    out = feat.chroma_long(tones_long(tones(spark, sf_dir)), weights, ["label"])
    return out.select("label", "n", "pc", r4("chroma", "chroma"))


@query("f7_soft_chroma_matrix", f"""WITH {TONES_LONG}, {WEIGHTS}
SELECT label, n, pc, round(sum(w * mag), 4) AS chroma FROM bins JOIN weights USING (bin) GROUP BY 1, 2, 3""")
def soft_chroma_matrix(spark, sf_dir):
    chroma = feat.soft_chroma(BINS, BIN_HZ)
    rows = tones(spark, sf_dir).df.select("label", "n", F.posexplode(chroma("mag")).alias("pc", "chroma"))
    return rows.select("label", "n", "pc", r4("chroma", "chroma"))


@query("f8_hard_chroma", f"""WITH {TONES_LONG},
p AS (SELECT label, n, CAST(round(12 * log2(bin * {BIN_HZ} / 440)) AS INTEGER) AS p, mag FROM bins WHERE bin > 0)
SELECT label, n, CAST(((p % 12) + 12) % 12 AS INTEGER) AS pc, round(sum(mag), 4) AS chroma FROM p GROUP BY 1, 2, 3""")
def hard_chroma(spark, sf_dir):
    out = feat.hard_chroma(tones_long(tones(spark, sf_dir)), ["label"], BIN_HZ)
    return out.select("label", "n", "pc", r4("chroma", "chroma"))


RANGES = feat.band_ranges(BINS, LOW_HZ)
LEVELS = f"""
edges AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {lo}, {hi})" for b, lo, hi in feat.band_ranges(BINS, LOW_HZ))}) AS t(band, lo, hi)),
frames AS (SELECT DISTINCT label, n FROM bins),
levels AS (SELECT f.label, f.n, e.band, sqrt(coalesce(sum(b.mag * b.mag), 0)) AS level
           FROM frames f CROSS JOIN edges e LEFT JOIN bins b ON b.label = f.label AND b.n = f.n AND b.bin >= e.lo AND b.bin < e.hi
           GROUP BY 1, 2, 3)"""


def _bands(spark, sf_dir) -> Series:
    s = tones(spark, sf_dir)
    return s.with_columns(**feat.band_levels(F.col("mag"), BINS, LOW_HZ))


def _band_series(spark, sf_dir) -> Series:
    s = _bands(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("level")) for b, _, _ in RANGES])
    return Series(s.df.select(*s._cell, "n", F.inline(pairs)), ("label", "band"), s.block)


@query("f9_band_levels", f"WITH {TONES_LONG}, {LEVELS} SELECT label, n, band, round(level, 4) AS level FROM levels")
def band_levels(spark, sf_dir):
    return _band_series(spark, sf_dir).select("label", "n", "band", r4("level", "level"))


@query("j4_range_join_bands", f"""WITH {TONES_LONG},
edges AS (SELECT * FROM (VALUES ('sub', 20.0, 60.0), ('low', 60.0, 250.0), ('mid', 250.0, 2000.0), ('himid', 2000.0, 8000.0), ('hi', 8000.0, 20000.0)) AS t(band, lo, hi))
SELECT label, band, count(*) AS bins, round(sum(mag * mag), 4) AS energy FROM bins JOIN edges ON bin * {LOW_HZ} >= lo AND bin * {LOW_HZ} < hi GROUP BY 1, 2""")
def range_join_bands(spark, sf_dir):
    rows = tones_long(tones(spark, sf_dir))
    rows = rows.withColumn("band", joins.band_of(F.col("bin") * LOW_HZ, feat.BANDS)).filter("band IS NOT NULL")
    return rows.groupBy("label", "band").agg(F.count(F.lit(1)).alias("bins"), r4(F.sum(F.col("mag") * F.col("mag")), "energy"))


NORMED = LEVELS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, band ORDER BY level) - 1 AS place, count(*) OVER (PARTITION BY label, band) AS total FROM levels),
p98 AS (SELECT label, band, level AS p98 FROM ranked WHERE place = least(CAST(floor(total * 0.98) AS BIGINT), total - 1)),
normed AS (SELECT l.label, l.band, l.n, least(level / greatest(p98, 1e-6), 1) AS x FROM levels l JOIN p98 USING (label, band))"""


@query("f10_p98_levels", f"WITH {TONES_LONG}, {NORMED} SELECT label, band, n, round(x, 4) AS x FROM normed")
def p98_levels(spark, sf_dir):
    return feat.normalise_by_p98(_band_series(spark, sf_dir), "x", "level").select("label", "band", "n", r4("x", "x"))


HOP = 0.05
RELEASE = math.exp(-HOP / 0.30)
HELD = NORMED + f""",
held AS (SELECT label, band, n, greatest(x, 0) AS held FROM normed WHERE n = 0
         UNION ALL SELECT x.label, x.band, x.n, greatest(x.x, h.held * {RELEASE!r}) FROM held h JOIN normed x
         ON x.label = h.label AND x.band = h.band AND x.n = h.n + 1)"""


@query("f11_peak_hold", f"WITH RECURSIVE {TONES_LONG}, {HELD} SELECT label, band, n, round(held, 4) AS held FROM held")
def peak_hold(spark, sf_dir):
    s = feat.normalise_by_p98(_band_series(spark, sf_dir), "x", "level").peak_hold(RELEASE, held=F.col("x"))
    return s.select("label", "band", "n", r4("held", "held"))


PAST, RECENT = max(int(0.6 / HOP), 2), max(int(0.2 / HOP), 1)
DROP = HELD + f""",
wide AS (SELECT label, n, max(held) FILTER (band = 'sub') AS sub, max(held) FILTER (band = 'low') AS low,
                max(held) FILTER (band = 'himid') AS himid, max(held) FILTER (band = 'hi') AS hi FROM held GROUP BY 1, 2),
bass AS (SELECT *, 0.4 * sub + 0.6 * low AS bass, greatest(himid, hi) AS top FROM wide),
was AS (SELECT *, CASE WHEN n > {PAST} THEN avg(bass) OVER (PARTITION BY label ORDER BY n ROWS BETWEEN {PAST} PRECEDING AND {RECENT + 1} PRECEDING) ELSE 0 END AS was_bass FROM bass),
fired AS (SELECT *, n > 0 AND was_bass > 0.45 AND bass < 0.85 AND top > 0.18 AS fired FROM was),
hit AS (SELECT *, last_value(CASE WHEN fired THEN n END IGNORE NULLS) OVER (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING) AS hit FROM fired)"""


@query("f12_f13_p5_departure_trigger", f"""WITH RECURSIVE {TONES_LONG}, {DROP}
SELECT label, n, round(was_bass, 4) AS was_bass, fired, round(coalesce(power({math.exp(-HOP / 0.65)!r}, n - hit), 0), 4) AS drop_level FROM hit""")
def departure_trigger(spark, sf_dir):
    s = _bands(spark, sf_dir)
    s = feat.normalise_bands(s, [band for band, _, _ in RANGES])
    s = s.peak_hold(RELEASE, **{band: F.col(band) for band, _, _ in RANGES})
    s = feat.bass_departure(s, HOP, gone=0.85)
    return s.select("label", "n", r4("was_bass", "was_bass"), "fired", r4("drop", "drop_level"))


@query("f14_value_at_position", f"""WITH {TONES},
len AS (SELECT label, count(*) AS length FROM tones GROUP BY 1),
probes AS (SELECT label, n AS probe, least(greatest(n * 1.37 - 2, 0), length - 1) AS f, length FROM tones JOIN len USING (label)),
ends AS (SELECT *, CAST(floor(f) AS BIGINT) AS n0, least(CAST(floor(f) AS BIGINT) + 1, length - 1) AS n1 FROM probes)
SELECT e.label, probe, round(l.a + (h.a - l.a) * (f - n0), 4) AS at_value
FROM ends e JOIN tones l ON l.label = e.label AND l.n = n0 JOIN tones h ON h.label = e.label AND h.n = n1""")
def value_at_position(spark, sf_dir):
    s = tones(spark, sf_dir)
    rows = s.df.select("label", "n", "a")
    probes = rows.select("label", F.col("n").alias("probe"), (F.col("n") * 1.37 - 2).alias("position"))
    out = feat.value_at(rows, probes, ["label"], "position", "a", s.totals(length=F.count(F.lit(1))))
    return out.select("label", "probe", r4("at_value", "at_value"))


ONSET = """
moved AS (SELECT label, n, bin, greatest(mag - lag(mag) OVER (PARTITION BY label, bin ORDER BY n), 0) AS up FROM bins),
flux AS (SELECT label, n, coalesce(sum(up), 0) AS flux FROM moved GROUP BY 1, 2),
onset AS (SELECT label, n, flux - avg(flux) OVER (PARTITION BY label) AS onset FROM flux)"""


@query("f15_onset_strength", f"WITH {TONES_LONG}, {ONSET} SELECT label, n, round(onset, 4) AS onset FROM onset")
def onset_strength(spark, sf_dir):
    return feat.onset_strength(tones(spark, sf_dir)).select("label", "n", r4("onset", "onset"))


FPS = 8.0
LAG_MIN, LAG_MAX = max(1, round(60 * FPS / 200)), round(60 * FPS / 60)


@query("f16_tempo", f"""WITH {TONES_LONG}, {ONSET},
ac AS (SELECT a.label, b.n - a.n AS lag, sum(a.onset * b.onset) AS ac FROM onset a JOIN onset b ON a.label = b.label AND b.n > a.n GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ac DESC, lag) AS place FROM ac WHERE lag BETWEEN {LAG_MIN} AND {LAG_MAX}),
peak AS (SELECT label, greatest(max(ac), 0) AS peak FROM ac GROUP BY 1)
SELECT label, CAST(lag AS INTEGER) AS lag, round(60 * {FPS} / lag, 4) AS bpm, round(ac / (peak + 1e-10), 4) AS confidence
FROM best JOIN peak USING (label) WHERE place = 1""")
def tempo(spark, sf_dir):
    out = feat.tempo(feat.onset_strength(tones(spark, sf_dir)), FPS)
    return out.select("label", "lag", r4("bpm", "bpm"), r4("confidence", "confidence"))


BARS = f"""
lens AS (SELECT label, count(*) * 4 AS length FROM tones GROUP BY 1),
bars AS (SELECT label, length, unnest(range(0, length, 18)) AS start FROM lens),
cut AS (SELECT label, start // 18 AS bar, start, least(start + 18, length) AS stop FROM bars),
covered AS (SELECT label, bar, unnest(range(start // 4, greatest(start // 4 + 1, stop // 4))) AS n FROM cut)"""


def _bars(spark, sf_dir):
    s = tones(spark, sf_dir)
    lengths = s.totals(length=F.count(F.lit(1)) * 4)
    return s, dedup.bar_bounds(lengths, F.lit(18).cast("long"))


@query("j3_interval_join", f"""WITH {TONES}, {BARS} SELECT label, bar, n, vec_id FROM covered JOIN tones USING (label, n)""")
def interval_join(spark, sf_dir):
    s, bars = _bars(spark, sf_dir)
    return joins.interval_join(s.df.select("label", "n", "vec_id"), bars, ["label"], 4).select("label", "bar", "n", "vec_id")


@query("f21_bar_fingerprints", f"""WITH {TONES_LONG}, {BARS}
SELECT label, bar, bin AS pos, round(avg(ln(1 + mag)), 4) AS level FROM covered JOIN bins USING (label, n) GROUP BY 1, 2, 3""")
def bar_fingerprints(spark, sf_dir):
    s, bars = _bars(spark, sf_dir)
    logs = s.df.select("label", "n", F.transform("mag", F.log1p).alias("v"))
    means = agg.mean_vector(joins.interval_join(logs, bars, ["label"], 4), ["label", "bar"], "v", "m")
    return means.select("label", "bar", F.posexplode("m").alias("pos", "level")).withColumn("level", F.round("level", 4))


@query("f22_bar_chroma", f"""WITH {TONES}, {BARS},
c AS (SELECT label, n, unnest(range(12)) AS pos, unnest(chroma) AS c FROM tones)
SELECT label, bar, pos, round(avg(c), 4) AS level FROM covered JOIN c USING (label, n) GROUP BY 1, 2, 3""")
def bar_chroma(spark, sf_dir):
    s, bars = _bars(spark, sf_dir)
    rows = joins.interval_join(s.df.select("label", "n", "chroma"), bars, ["label"], 4)
    means = agg.mean_vector(rows, ["label", "bar"], "chroma", "m")
    return means.select("label", "bar", F.posexplode("m").alias("pos", "level")).withColumn("level", F.round("level", 4))


@query("f19_coarse_speed", f"""WITH {TONES_LONG},
near AS (SELECT b.label, b.n, k.bin AS kb, max(b.mag) AS peak FROM bins b JOIN (SELECT unnest(range(64)) AS bin) k ON b.bin BETWEEN k.bin - 1 AND k.bin + 1
         WHERE k.bin + 1 < 64 GROUP BY 1, 2, 3),
score AS (SELECT label, n, c.b, sum(peak / k.k) AS score FROM near, (SELECT unnest(range(4, 13)) AS b) c, (SELECT unnest(range(1, 5)) AS k) k
          WHERE kb = k.k * c.b GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY label, n ORDER BY score DESC, b) AS place FROM score)
SELECT label, n, b * {BIN_HZ}::DOUBLE AS f_hz, round(score, 4) AS score FROM best WHERE place = 1""")
def coarse_speed(spark, sf_dir):
    out = feat.coarse_speed(tones_long(tones(spark, sf_dir)), ["label", "n"], BIN_HZ, 4, 12, BINS)
    return out.select("label", "n", "f_hz", r4("score", "score"))


# -- signatures and neighbours ------------------------------------------------------------------
UNIT = """
vecs AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
centred AS (SELECT vec_id, label, v, list_transform(v, lambda x: x - list_avg(v)) AS c FROM vecs),
lens AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS len FROM centred),
units AS (SELECT vec_id, label, list_transform(c, lambda x: CASE WHEN len > 1e-10 THEN x / len ELSE x END) AS u FROM lens)"""


def _units(spark, sf_dir):
    v = doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(centred(v)).alias("u"))


@query("x1_centre_normalise", f"WITH {UNIT} SELECT vec_id, unnest(range(64)) AS pos, round(unnest(u), 4) AS x FROM units")
def centre_normalise(spark, sf_dir):
    rows = _units(spark, sf_dir).select("vec_id", F.posexplode("u").alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 4))


@query("x2_consecutive_cosine", f"""WITH {UNIT},
p AS (SELECT vec_id, label, u, lag(u) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM units)
SELECT vec_id, round(list_dot_product(u, before), 4) AS cosine FROM p WHERE before IS NOT NULL""")
def consecutive_cosine(spark, sf_dir):
    s = tones(spark, sf_dir)
    units = _units(spark, sf_dir).select("vec_id", "label", "u")
    rows = Series(s.df.select(*s._cell, "n", "vec_id").join(units, ["label", "vec_id"]), s.keys, s.block)
    rows = rows.around(1, 0, before=lambda w: F.lag("u").over(w))
    return rows.df.filter("before IS NOT NULL").select("vec_id", r4(dot(F.col("u"), F.col("before")), "cosine"))


SIG = """
c AS (SELECT label, n, a, unnest(range(12)) AS pos, unnest(chroma) AS c FROM tones),
prev AS (SELECT *, lag(c) OVER (PARTITION BY label, pos ORDER BY n) AS c0, lag(a) OVER (PARTITION BY label, pos ORDER BY n) AS a0 FROM c),
sm AS (SELECT label, pos, avg(c) AS m FROM prev WHERE a > -24 GROUP BY 1, 2),
mm AS (SELECT label, pos, avg(abs(c - c0)) AS m FROM prev WHERE a > -24 AND a0 > -24 GROUP BY 1, 2),
sc AS (SELECT label, pos, m - avg(m) OVER (PARTITION BY label) AS m FROM sm),
mc AS (SELECT label, pos, m - avg(m) OVER (PARTITION BY label) AS m FROM mm),
shape AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM sc),
motion AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM mc),
joined AS (SELECT label, pos, sqrt(0.6) * x AS x FROM shape UNION ALL SELECT label, pos + 12, sqrt(0.4) * x FROM motion),
sigs AS (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM joined)"""


def _long(df, vector, *keys):
    rows = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 4))


@query("x3_shape_signature", f"WITH {TONES}, {SIG} SELECT label, pos, round(x, 4) AS x FROM shape")
def shape_signature(spark, sf_dir):
    return _long(sim.shape_signature(tones(spark, sf_dir), "chroma", -24.0), "shape", "label")


@query("x4_motion_signature", f"WITH {TONES}, {SIG} SELECT label, pos, round(x, 4) AS x FROM motion")
def motion_signature(spark, sf_dir):
    return _long(sim.motion_signature(tones(spark, sf_dir), "chroma", -24.0), "motion", "label")


@query("x5_blended_signature", f"WITH {TONES}, {SIG} SELECT label, pos, round(x, 4) AS x FROM sigs")
def blended_signature(spark, sf_dir):
    return _long(sim.signatures(tones(spark, sf_dir), "chroma", 12, -24.0), "sig", "label")


@query("x6_profile_scores", f"""WITH {UNIT},
el AS (SELECT vec_id, label, u[1] > 0 AS liked, unnest(range(64)) AS pos, unnest(u) AS x FROM units),
m AS (SELECT label, pos, avg(x) AS m FROM el WHERE liked GROUP BY 1, 2),
prof AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS p FROM m)
SELECT vec_id, label, round(sum(x * p), 4) AS score FROM el JOIN prof USING (label, pos) GROUP BY 1, 2""")
def profile_scores(spark, sf_dir):
    """Every item against the profile of the liked items (first component positive) of its label."""
    units = _units(spark, sf_dir)
    out = sim.scored(units, sim.profiles(units.filter(F.col("u")[0] > 0), ["label"], "u"), ["label"], "u")
    return out.select("vec_id", "label", r4("score", "score"))


PAIRS = UNIT + ", pairs AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.u, b.u) AS score FROM units a JOIN units b ON a.vec_id <> b.vec_id)"


@query("x7_top_matches", f"""WITH {PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM pairs)
SELECT id, other, round(score, 4) AS score, rank FROM ranked WHERE rank <= 3""")
def top_matches(spark, sf_dir):
    items = _units(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("u").alias("v"))
    return sim.top_matches(items, 3).select("id", "other", r4("score", "score"), "rank")


@query("j7_similar_pairs", f"WITH {PAIRS} SELECT id, other, round(score, 4) AS score FROM pairs WHERE score >= 0.35 AND id < other")
def similar_pairs(spark, sf_dir):
    items = _units(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("u").alias("v"))
    return sim.similar_pairs(items, 0.35).select("id", "other", r4("score", "score"))


@query("a9_class_centroids", f"""WITH el AS (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, pos, round(avg(x), 4) AS x FROM el GROUP BY 1, 2""")
def class_centroids(spark, sf_dir):
    return _long(agg.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding", "m"), "m", "label")


# -- near duplicates ----------------------------------------------------------------------------
def _chroma_series(spark, sf_dir) -> Series:
    s = tones(spark, sf_dir)
    rows = s.df.select(F.col("label").alias("series"), *([s.block] if s.block else []), "n", F.col("chroma").alias("v"))
    return Series(rows, ("series",), s.block)


GREEDY = """
vecs AS (SELECT label AS series, n, chroma AS v, list_transform(chroma, lambda x: x / sqrt(list_dot_product(chroma, chroma))) AS u FROM tones),
tried AS (SELECT series, n, v, u, thr FROM vecs, (SELECT unnest([{thresholds}])::DOUBLE AS thr)),
walk AS (SELECT series, thr, n, [struct_pack(rep := n, u := u)] AS reps, n AS label FROM tried WHERE n = 0
  UNION ALL SELECT series, thr, n, CASE WHEN list_max(scores) >= thr THEN reps ELSE list_append(reps, struct_pack(rep := n, u := u)) END,
    CASE WHEN list_max(scores) >= thr THEN reps[list_position(scores, list_max(scores))].rep ELSE n END
  FROM (SELECT t.series, t.thr, t.n, t.u, w.reps, list_transform(w.reps, lambda r: list_dot_product(r.u, t.u)) AS scores
        FROM walk w JOIN tried t ON t.series = w.series AND t.thr = w.thr AND t.n = w.n + 1))"""


@query("h6_greedy_pool", f"WITH RECURSIVE {TONES}, {GREEDY.format(thresholds='0.85')} SELECT series, n, label FROM walk")
def greedy_pool(spark, sf_dir):
    return dedup.greedy_pool(_chroma_series(spark, sf_dir), 0.85)


@query("h7_pooled_residual", f"""WITH {TONES},
el AS (SELECT label, n, unnest(range(12)) AS pos, unnest(chroma) AS x FROM tones),
d AS (SELECT a.label, a.n, sqrt(sum(power(a.x - b.x, 2))) / CASE WHEN sqrt(sum(b.x * b.x)) > 0 THEN sqrt(sum(b.x * b.x)) ELSE 1 END AS r
      FROM el a JOIN el b ON a.label = b.label AND a.pos = b.pos AND b.n = a.n - a.n % 4 WHERE a.n % 4 <> 0 GROUP BY 1, 2)
SELECT label, round(median(r), 4) AS median_residual FROM d GROUP BY 1""")
def pooled_residual(spark, sf_dir):
    rows = tones(spark, sf_dir).df.select("label", "n", F.col("chroma").alias("v"))
    labels = rows.select(F.col("label").alias("series"), "n", (F.col("n") - F.col("n") % 4).alias("label"))
    vectors = rows.select(F.col("label").alias("series"), "n", "v")
    out = dedup.pooled_residual(vectors, labels, ["series"])
    return out.select(F.col("series").alias("label"), r4("median_residual", "median_residual"))


@query("h8_threshold_sweep", f"""WITH RECURSIVE {TONES}, {GREEDY.format(thresholds='0.80, 0.85, 0.90')},
share AS (SELECT series, thr, count(*) AS rows, avg((label <> n)::INT) AS pooled_share FROM walk GROUP BY 1, 2),
el AS (SELECT series, n, unnest(range(12)) AS pos, unnest(v) AS x FROM vecs),
d AS (SELECT w.series, w.thr, w.n, sqrt(sum(power(a.x - b.x, 2))) / sqrt(sum(b.x * b.x)) AS r FROM walk w JOIN el a ON a.series = w.series AND a.n = w.n
      JOIN el b ON b.series = w.series AND b.n = w.label AND b.pos = a.pos WHERE w.label <> w.n GROUP BY 1, 2, 3),
m AS (SELECT series, thr, median(r) AS median_residual FROM d GROUP BY 1, 2)
SELECT series, thr, rows, round(pooled_share, 4) AS pooled_share, round(median_residual, 4) AS median_residual FROM share LEFT JOIN m USING (series, thr)""")
def threshold_sweep(spark, sf_dir):
    out = dedup.threshold_sweep(_chroma_series(spark, sf_dir), [0.80, 0.85, 0.90])
    return out.select("series", "thr", "rows", r4("pooled_share", "pooled_share"), r4("median_residual", "median_residual"))


@query("h10_null_matches", f"""WITH {TONES},
l AS (SELECT label AS series, n, CASE WHEN n % 3 = 0 THEN n ELSE n - n % 3 END AS label FROM tones),
c AS (SELECT *, coalesce(count(*) FILTER (label = n) OVER (PARTITION BY series ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM l),
p AS (SELECT series, n, label, ((n * 2654435761 + {7 * 40503 + 12345}) % 2147483648) % earlier AS pick FROM c WHERE label <> n AND earlier > 0)
SELECT p.series, p.n, p.label, k.n AS control FROM p JOIN c k ON k.series = p.series AND k.label = k.n AND k.earlier = p.pick""")
def null_matches(spark, sf_dir):
    s = tones(spark, sf_dir)
    label = F.when(F.col("n") % 3 == 0, F.col("n")).otherwise(F.col("n") - F.col("n") % 3)
    rows = s.df.select(F.col("label").alias("series"), *([s.block] if s.block else []), "n", label.alias("label"))
    return dedup.null_matches(Series(rows, ("series",), s.block), 7)


# -- lines and components on given spectra ------------------------------------------------------
SHAFT = 4.0
SPEC = health.BEARINGS[0]


def _line(order: float) -> str:
    lo, hi = max(1, math.floor(order * SHAFT * 0.975)), min(math.ceil(order * SHAFT * 1.025), BINS - 1)
    return "0.0" if lo >= hi else f"list_max(mag[{lo + 1}:{hi + 1}]) / greatest(list_sort(mag[2:64])[32], 1e-12)"


@query("b1_line_strength", f"WITH {TONES} SELECT label, n, round({_line(SPEC[2])}, 4) AS outer_line, round({_line(SPEC[5])}, 4) AS cage_line FROM tones")
def line_strength(spark, sf_dir):
    line = lambda order: health.line_strength(F.col("mag"), 1.0, F.lit(order * SHAFT))
    return tones(spark, sf_dir).select("label", "n", r4(line(SPEC[2]), "outer_line"), r4(line(SPEC[5]), "cage_line"))


@query("b2_component_ranking", f"""WITH {TONES},
s AS (SELECT label, n, unnest(['outer race', 'inner race', 'rolling element', 'cage']) AS component, unnest([0, 1, 2, 3]) AS place,
  unnest([{_line(SPEC[2])}, {_line(SPEC[3])} + 0.5 * ({_line(SPEC[3] - 1)} + {_line(SPEC[3] + 1)}),
          {_line(SPEC[4])} + 0.5 * ({_line(2 * SPEC[4])}), {_line(SPEC[5])}]) AS score FROM tones),
r AS (SELECT *, row_number() OVER (PARTITION BY label, n ORDER BY score DESC, place) AS rank FROM s)
SELECT a.label, a.n, a.component, round(a.score, 4) AS score, round(a.score / greatest(b.score, 1e-12), 4) AS margin
FROM r a JOIN r b ON a.label = b.label AND a.n = b.n AND a.rank = 1 AND b.rank = 2""")
def component_ranking(spark, sf_dir):
    out = health.component_scores(tones(spark, sf_dir).df, "mag", 1.0, F.lit(SHAFT), SPEC)
    return out.select("label", "n", "component", r4("score", "score"), r4("margin", "margin"))
