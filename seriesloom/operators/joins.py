"""Order-aware joins: as-of, two-sided as-of, interval, range and tempo pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.plans.series import Series, index_series


def as_of(rows: DataFrame, keys_df: DataFrame, on: list[str], order: list[str], value_columns: list[str]) -> DataFrame:
    """Every row of ``rows`` with the values of the latest key at or before it.

    One union and one running scan instead of a theta join: keys sort before rows on equal order,
    and a long series is scanned block by block. ``order`` must be unique within each input.
    """
    at = [f"at_{c}" for c in order]
    placed = [F.col(c).alias(a) for c, a in zip(order, at)]
    rest = [c for c in rows.columns if c not in (*on, *order)]
    marks = keys_df.select(*on, *placed, F.lit(0).alias("side"), F.struct(*value_columns).alias("held"))
    points = rows.select(*on, *placed, F.lit(1).alias("side"), F.struct(*rest, F.lit(True).alias("present")).alias("row"))
    merged = index_series(marks.unionByName(points, allowMissingColumns=True), on, [*at, "side"])
    scanned = merged.running(seen=("last", F.col("held"))).df.filter("side = 1")
    return scanned.select(
        *on,
        *[F.col(a).alias(c) for c, a in zip(order, at)],
        *[F.col(f"row.{c}").alias(c) for c in rest],
        *[F.col(f"seen.{c}").alias(c) for c in value_columns],
    )


def bracket(series: Series, is_key: Column, *values: str) -> Series:
    """Both neighbouring keys of each row and the linear blend of ``values`` between them.

    Adds ``<value>_rec``. After the last key the value is held, before the first it is missing.
    """
    packed = F.when(is_key, F.struct("n", *values))
    out = series.running(back=("last", packed)).running(end=-1, backwards=True, ahead=("last", packed))
    span = F.col("ahead.n") - F.col("back.n")
    u = F.when(span > 0, (F.col("n") - F.col("back.n")) / span).otherwise(F.lit(0.0))
    blended = {
        f"{v}_rec": F.col(f"back.{v}")
        + u * (F.coalesce(F.col(f"ahead.{v}"), F.col(f"back.{v}")) - F.col(f"back.{v}"))
        for v in values
    }
    return out.with_columns(**blended)


def frames_of_bars(bars: DataFrame, hop: int) -> DataFrame:
    """One row per (bar, frame): frames [start // hop, max(first + 1, end // hop))."""
    first = F.floor(F.col("start") / hop)
    last = F.greatest(first + 1, F.floor(F.col("end") / hop)) - 1
    return bars.withColumn("n", F.explode(F.sequence(first, last)))


def interval_join(rows: DataFrame, bars: DataFrame, on: list[str], hop: int) -> DataFrame:
    """Frames to the bars that cover them, as an equi-join on the frame number."""
    return rows.join(frames_of_bars(bars, hop), [*on, "n"])


def band_of(value: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Name of the half-open band [lo, hi) that holds a value: a range join against fixed edges."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(edges):
        out = F.when((value >= lo) & (value < hi), F.lit(name)).otherwise(out)
    return out


def tempo_match(
    pairs: DataFrame, mine: str = "a", other: str = "b", ranges: tuple[float, ...] = (0.10, 0.16, 1.0)
) -> DataFrame:
    """Rate and phase shift that lock one recording to another.

    Expects ``<side>_bpm``, ``<side>_beat`` (samples per beat) and ``<side>_pos`` for both sides.
    The rate range is the smallest that holds the needed rate; the phase is folded to half a beat.
    """
    f = lambda side, what: F.col(f"{side}_{what}")
    rate = f(other, "bpm") / f(mine, "bpm")
    need = F.abs(rate - 1.0)
    chosen = F.lit(ranges[-1])
    for r in reversed(ranges[:-1]):
        chosen = F.when(need <= r, F.lit(r)).otherwise(chosen)
    phase = lambda side: F.pmod(f(side, "pos"), f(side, "beat")) / f(side, "beat")
    beat = f(mine, "beat")
    delta = (phase(other) - phase(mine)) * beat
    delta = F.when(delta > beat / 2, delta - beat).when(delta < -beat / 2, delta + beat).otherwise(delta)
    usable = (f(mine, "bpm") > 0) & (f(other, "bpm") > 0)
    return pairs.filter(usable).select(
        "*",
        rate.alias("rate"),
        chosen.alias("rate_range"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (rate - 1.0) / chosen)).alias("fader"),
        delta.alias("delta"),
    )


def tempo_pairs(
    items: DataFrame, item: str, bpm: str, pos: str, beat: str, widest: float = 0.10, top: int = 3
) -> DataFrame:
    """For every item the ``top`` others whose tempo needs the least change of rate, of at most ``widest``, and how to lock
    onto them (see ``tempo_match``). Order: change of rate, then item; items are unique.

    The least changes are among the nearest tempos, so tempos are the rows of one ordered series: each stands for the
    ``top + 1`` first of its items and looks at ``top`` neighbours on either side. An item then takes the best list of its
    tempo without itself. So a common tempo is one row, no bucket of pairs is formed, and work is items times ``top``.
    Items without a positive tempo have no partners.
    """
    rows = items.where(F.col(bpm) > 0).select(
        F.col(item).alias("item"), F.col(bpm).cast("double").alias("bpm"), F.col(pos).alias("pos"), F.col(beat).alias("beat")
    )
    first = F.row_number().over(Window.partitionBy("bpm").orderBy("item"))
    firsts = rows.withColumn("_place", first).where(F.col("_place") <= top + 1)
    tempos = firsts.groupBy("bpm").agg(F.collect_list(F.struct("item", "pos", "beat")).alias("held")).withColumn("scale", F.lit(0))
    tempos = index_series(tempos, ["scale"], ["bpm"])
    near = tempos.around(top, top, near=lambda w: F.collect_list(F.struct("bpm", "held")).over(w.rowsBetween(-top, top))).df
    near = near.select("bpm", F.explode("near").alias("t")).select("bpm", F.col("t.bpm").alias("b_bpm"), F.explode("t.held").alias("b"))
    need = F.abs(F.col("b_bpm") / F.col("bpm") - 1.0)
    offers = near.withColumn("need", need).where(F.col("need") <= widest)
    best = F.collect_list(F.struct("need", F.col("b.item").alias("b_item"), "b_bpm", F.col("b.pos").alias("b_pos"), F.col("b.beat").alias("b_beat")))
    offers = offers.groupBy("bpm").agg(F.slice(F.sort_array(best), 1, top + 1).alias("offers"))
    mine = [F.col(c).alias(f"a_{c}") for c in ("item", "bpm", "pos", "beat")]
    pairs = rows.join(offers, "bpm").select(*mine, F.slice(F.filter("offers", lambda o: o["b_item"] != F.col("item")), 1, top).alias("offers"))
    pairs = pairs.select(*[c for c in pairs.columns if c != "offers"], F.posexplode("offers").alias("place", "o"))
    return tempo_match(pairs.select("*", (F.col("place") + 1).alias("rank"), "o.*").drop("o", "place"))


def held_rebuild(keys: DataFrame, frames: DataFrame, on: list[str]) -> DataFrame:
    """Zero-order hold of (a, i) from sparse keys onto the full frame grid."""
    marks = keys.select(*on, F.col("frame").alias("n"), F.col("a").alias("a_rec"), F.col("i").alias("i_rec"))
    return as_of(frames, marks, on, ["n"], ["a_rec", "i_rec"])
