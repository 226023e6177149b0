"""Content hashes, exact and near-duplicate pooling of bars, and the residual against a match."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.features import pieces
from seriesloom.plans.selection import exact_median
from seriesloom.plans.series import Series, index_series
from seriesloom.session import block_rows, checkpointed

HASH_FAN = 4096
HASH_DEPTH = 3
BARS_PER_STEP = 4096
MAX_GAIN = 2.0
GAIN_BITS = 12


# -- content hashes -----------------------------------------------------------------------------
def chunk_hashes(samples: DataFrame, keys: list[str], value: Column, order: str = "n", fan: int = HASH_FAN) -> DataFrame:
    """SHA-256 of every run of ``fan`` rows: bounded groups whatever the length of a series."""
    return _hash_level(_parts(samples, keys, value, order, fan), keys).drop("rows")


def _parts(samples: DataFrame, keys: list[str], value: Column, order: str, fan: int) -> DataFrame:
    at = F.col(order)
    return samples.select(
        *keys, F.floor(at / fan).alias("part"), at.alias("at"), value.cast("string").alias("v"), F.lit(1).alias("rows")
    )


def _hash_level(rows: DataFrame, keys: list[str]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("at", "v")))
    joined = F.array_join(F.transform(listed, lambda p: p["v"]), ",")
    return rows.groupBy(*keys, "part").agg(F.sha2(joined, 256).alias("hash"), F.sum("rows").alias("rows"))


def _hash_tree(samples, keys, value, order, fan, depth) -> DataFrame:
    level = _hash_level(_parts(samples, keys, value, order, fan), keys)
    for step in range(depth - 1):
        # The last level takes all that is left, so a series has one hash whatever its length.
        above = (F.floor(F.col("part") / fan) if step < depth - 2 else F.lit(0).cast("long")).alias("part")
        level = _hash_level(level.select(*keys, above, F.col("part").alias("at"), F.col("hash").alias("v"), "rows"), keys)
    return level.select(*keys, F.col("hash").alias("content_hash"), "rows")


def content_hash(
    samples: DataFrame, keys: list[str], value: Column, order: str = "n", fan: int = HASH_FAN, depth: int = HASH_DEPTH
) -> DataFrame:
    """One hash per series: a tree of chunk hashes of fixed depth, independent of the layout.

    The last level joins one hash for every ``fan ** (depth - 1)`` rows (1.7e7 by default), however many there are.
    """
    return _hash_tree(samples, keys, value, order, fan, depth).drop("rows")


# -- bars ---------------------------------------------------------------------------------------
def bar_length(bpm: Column, beats: float, sr: float) -> Column:
    """Samples per bar, rounded half to even; a tempo of 0 or less is an error."""
    exact = F.lit(float(beats)) * 60.0 / bpm * F.lit(float(sr))
    return F.when(bpm > 0, F.bround(exact)).otherwise(F.raise_error(F.lit("bpm must be > 0"))).cast("long")


def bar_bounds(lengths: DataFrame, spb: Column) -> DataFrame:
    """Half-open ``bar, start, end`` tiles of ``length``; the last one may be shorter."""
    rows = lengths.withColumn("spb", spb).filter(F.col("length") > 0)
    last = F.floor((F.col("length") - 1) / F.col("spb"))
    # Two steps, so that a very long series never becomes one very long array.
    rows = rows.withColumn("bar", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(BARS_PER_STEP).cast("long"))))
    rows = rows.withColumn("bar", F.explode(F.sequence(F.col("bar"), F.least(F.col("bar") + BARS_PER_STEP - 1, last))))
    rows = rows.withColumn("start", F.col("bar") * F.col("spb"))
    return rows.withColumn("end", F.least(F.col("start") + F.col("spb"), F.col("length")))


def bar_table(samples: Series, value: Column, spb: int) -> DataFrame:
    """``keys, bar, len, full, hash`` of fixed-length bars, long bars hashed as a tree."""
    rows = samples.df.select(*samples.keys, F.floor(F.col("n") / spb).alias("bar"), (F.col("n") % spb).alias("at"), value.alias("v"))
    keys = [*samples.keys, "bar"]
    depth = 1 if spb <= HASH_FAN else HASH_DEPTH
    hashed = _hash_tree(rows, keys, F.col("v"), "at", HASH_FAN, depth)
    return hashed.select(
        *keys, F.col("rows").alias("len"), (F.col("rows") == spb).alias("full"), F.col("content_hash").alias("hash")
    )


def pool_bars(bars: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exact dedup: ``pool`` (keys, loop, bar, hash, len) in first-seen order and ``recall``.

    Only full bars are shared; a short tail is an entry of its own. The first bar of a hash is a
    map-side minimum, so a hash that fills a third of the table costs one row per task.
    """
    tag = F.when(F.col("full"), F.col("hash")).otherwise(F.concat(F.lit("tail-"), F.col("bar").cast("string")))
    tagged = bars.withColumn("tag", tag)
    firsts = tagged.groupBy(*keys, "tag").agg(
        F.min("bar").alias("first_bar"), F.min("hash").alias("hash"), F.min("len").alias("len")
    )
    pool = index_series(firsts, keys, ["first_bar"]).df.select(
        *keys, F.col("n").alias("loop"), F.col("first_bar"), "tag", "hash", "len"
    )
    recall = tagged.join(pool.select(*keys, "tag", "loop", "first_bar"), [*keys, "tag"])
    recall = recall.select(*keys, "bar", "loop", "len", (F.col("bar") == F.col("first_bar")).alias("first"))
    return pool.drop("tag"), recall


def rebuild(pool_rows: DataFrame, recall: DataFrame, keys: list[str]) -> DataFrame:
    """Pool payload rows (keys, loop, at, ...) back to the original sequence."""
    return recall.select(*keys, "bar", "loop").join(pool_rows, [*keys, "loop"])


def dedup_report(recall: DataFrame, keys: list[str], bytes_per_row: int) -> DataFrame:
    """Totals, unique bars, ratio and bytes saved per series."""
    total, first = F.count(F.lit(1)), F.sum(F.col("first").cast("long"))
    full = F.sum("len") * bytes_per_row
    kept = F.sum(F.when(F.col("first"), F.col("len")).otherwise(0)) * bytes_per_row
    return recall.groupBy(*keys).agg(
        total.alias("total_bars"),
        first.alias("unique_bars"),
        (total - first).alias("duplicate_bars"),
        ((total - first) / total).alias("dedup_ratio"),
        full.alias("bytes_full"),
        kept.alias("bytes_pool"),
        (F.lit(1.0) - kept / full).alias("saving"),
    )


# -- near duplicates ----------------------------------------------------------------------------
def greedy_pool(vectors: Series, threshold: Column | float, vector: str = "v") -> DataFrame:
    """``keys, n, label``: every row joins its best representative at or above the threshold.

    Representatives are the rows that found none; ties keep the earliest. A series that fits one
    task is one grouped call. A longer one goes block by block: the rows of a block are scored
    against the representatives so far in chunk pairs, then settled inside the block.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    keys = list(vectors.keys)
    vectors = vectors.reblocked() if vectors.block else vectors
    rows = vectors.df.select(*vectors._cell, "n", F.col(vector).alias("v"), threshold.cast("double").alias("limit"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("label", T.LongType())])
    none = [F.lit(-1.0).alias("best"), F.lit(-1).cast("long").alias("best_n")]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        units = _unit_rows(pdf["v"])
        ns, thr = pdf["n"].to_numpy(), float(pdf["limit"].iloc[0])
        best, label = pdf["best"].to_numpy().copy(), pdf["best_n"].to_numpy().copy()
        opened: list[int] = []
        for j in range(len(ns)):
            if opened:
                scores = units[opened] @ units[j]
                top = int(np.argmax(scores))
                if scores[top] > best[j]:
                    best[j], label[j] = scores[top], ns[opened[top]]
            if best[j] < thr:
                opened.append(j)
                label[j] = ns[j]
        out = {k: pdf[k].to_numpy() for k in keys}
        return pd.DataFrame({**out, "n": ns, "label": label})

    if not vectors.block:
        return rows.select("*", *none).groupBy(*keys).applyInPandas(settle, schema)

    chunk = min(4096, block_rows(rows.sparkSession))
    rows = checkpointed(rows.withColumn("turn", F.col(vectors.block) + 1))
    turns = rows.agg(F.max("turn")).first()[0] or 0
    labels, reps = None, None
    for turn in range(1, turns + 1):
        block = rows.filter(F.col("turn") == turn)
        if reps is None:
            scored = block.select("*", *none)
        else:
            best = _best_representative(block, reps, keys, chunk)
            scored = block.join(best, [*keys, "n"], "left").withColumns(
                {"best": F.coalesce("best", F.lit(-1.0)), "best_n": F.coalesce("best_n", F.lit(-1).cast("long"))}
            )
        settled = checkpointed(scored.groupBy(*keys).applyInPandas(settle, schema))
        new = block.join(settled.filter("label = n").select(*keys, "n"), [*keys, "n"], "left_semi")
        new = checkpointed(new.select(*keys, "n", "v"))
        labels = settled if labels is None else labels.unionByName(settled)
        reps = new if reps is None else reps.unionByName(new)
    return labels


def _unit_rows(column: pd.Series) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in column])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=m.copy(), where=length > 0)


def _best_representative(block, reps, keys, chunk):
    """Best earlier representative per row, by pairs of bounded chunks (one row out per row and pair)."""
    left = block.withColumn("g", F.floor(F.col("n") / chunk) % F.lit(1 << 20))
    right = index_series(reps.withColumnRenamed("n", "rep"), keys, ["rep"]).df
    right = right.select(*keys, "rep", F.col("v"), F.floor(F.col("n") / chunk).alias("s"))
    pieces = right.groupBy(*keys).agg(F.max("s").alias("last_s"))
    left_ids = left.select(*keys, "g").distinct()
    left = left.join(pieces, keys).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_s"))))
    right = right.join(left_ids, keys)
    schema = T.StructType(
        [block.schema[k] for k in keys]
        + [T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rep", T.LongType())]
    )

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=schema.fieldNames())
        b = b.sort_values("rep")
        s = _unit_rows(a["v"]) @ _unit_rows(b["v"]).T
        top = np.argmax(s, axis=1)
        out = {k: a[k].to_numpy() for k in keys}
        return pd.DataFrame(
            {**out, "n": a["n"].to_numpy(), "score": s[np.arange(len(a)), top], "rep": b["rep"].to_numpy()[top]}
        )

    pair = [*keys, "g", "s"]
    # Both sides descend from the same rows: fresh aliases keep their columns apart.
    left = left.select(*[F.col(c).alias(c) for c in (*pair, "n", "v")]).groupBy(*pair)
    right = right.select(*[F.col(c).alias(c) for c in (*pair, "rep", "v")]).groupBy(*pair)
    found = left.cogroup(right).applyInPandas(score, schema)
    best = F.max(F.struct(F.col("score"), (-F.col("rep")).alias("back"))).alias("b")
    return found.groupBy(*keys, "n").agg(best).select(*keys, "n", F.col("b.score").alias("best"), (-F.col("b.back")).alias("best_n"))


def pooled_residual(vectors: DataFrame, labels: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """Median relative distance of pooled rows to their representative."""
    rows = labels.filter("label <> n").join(vectors.select(*keys, "n", F.col(vector).alias("own")), [*keys, "n"])
    reps = vectors.select(*keys, F.col("n").alias("label"), F.col(vector).alias("rep"))
    rows = rows.join(reps, [*keys, "label"])
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    size = F.sqrt(square(F.col("rep")))
    away = F.sqrt(square(F.zip_with("own", "rep", lambda a, b: a - b)))
    rows = rows.withColumn("residual", away / F.when(size > 0, size).otherwise(F.lit(1.0)))
    return exact_median(rows, keys, "residual", "median_residual")


def threshold_sweep(vectors: Series, thresholds: list[float], vector: str = "v") -> DataFrame:
    """Pooled share and median residual per series and threshold."""
    tried = vectors.split_by("thr", thresholds)
    labels = greedy_pool(tried, F.col("thr"), vector)
    keys = list(tried.keys)
    share = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("label") != F.col("n")).cast("double")).alias("pooled_share")
    )
    return share.join(pooled_residual(tried.df, labels, keys, vector), keys, "left")


# -- aligned residuals --------------------------------------------------------------------------
def shifted(y: np.ndarray, limit: int) -> np.ndarray:
    """All shifts of the rows of ``y`` within +-limit, zeros moving in: (rows, lags, samples), lag 0 first, then
    1, -1, 2, -2 and so on."""
    n = y.shape[1]
    wide = np.pad(y, ((0, 0), (limit, limit)))
    lags = np.array(sorted(range(-limit, limit + 1), key=lambda g: (abs(g), -g)))
    return wide[:, (limit - lags)[:, None] + np.arange(n)], lags


def aligned_residuals(pairs: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Adds ``lag, gain, rms_ratio`` to pairs of integer bars ``x`` (bar) and ``y`` (match).

    The lag is that of the highest correlation, the gain the least-squares one, clipped to +-2 and kept
    to 12 bits, so the prediction stays an integer. Pairs of equal lengths are handled as stacks of bounded size.
    """
    fields = [T.StructField("lag", T.LongType()), T.StructField("gain", T.LongType()), T.StructField("rms_ratio", T.DoubleType())]
    schema = T.StructType([pairs.schema[k] for k in keys] + fields)
    half = 1 << (GAIN_BITS - 1)

    def stack(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        y = np.pad(y[:, : x.shape[1] + limit], ((0, 0), (0, max(0, x.shape[1] - y.shape[1]))))
        moved, lags = shifted(y, limit)
        moved = moved[..., : x.shape[1]]
        match = np.einsum("rn,rln->rl", x.astype(float), moved.astype(float))
        best = match.argmax(1)
        rows = np.arange(len(x))
        chosen = moved[rows, best]
        power = (chosen.astype(float) ** 2).sum(1)
        alpha = np.divide(match[rows, best], power, out=np.zeros(len(x)), where=power > 0)
        gain = np.rint(np.clip(alpha, -MAX_GAIN, MAX_GAIN) * 2 * half).astype(np.int64)
        left = x - ((gain[:, None] * chosen + half) >> GAIN_BITS)
        level = np.sqrt((x.astype(float) ** 2).mean(1))
        ratio = np.sqrt((left.astype(float) ** 2).mean(1)) / np.where(level > 0, level, 1.0)
        return {"lag": lags[best], "gain": gain, "rms_ratio": ratio}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [pdf["x"].map(len), pdf["y"].map(len)]
            for (width, other), rows in pdf.groupby(sizes, sort=False):
                # Every sample of a bar meets all lags.
                for part in pieces(rows, max(width, other) * (2 * limit + 1)):
                    found = stack(*(np.stack(part[c].to_numpy()).astype(np.int64) for c in ("x", "y")))
                    yield part[keys].assign(**found)[schema.fieldNames()]

    return pairs.select(*keys, "x", "y").mapInPandas(each, schema)


def known_lag_gain(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Least-squares gain of aligned long-form samples."""
    return pairs.groupBy(*keys).agg((F.sum(F.col(a) * F.col(b)) / F.sum(F.col(b) * F.col(b))).alias("gain"))


def null_matches(labels: Series, seed: int) -> DataFrame:
    """A pseudo-random earlier canonical row for every pooled row (a control for real matches).

    The pick is arithmetic on (seed, row), so it is the same on every run and on every layout.
    """
    canonical = F.col("label") == F.col("n")
    rows = labels.running(end=-1, earlier=("count", F.when(canonical, F.lit(1))))
    mixed = F.pmod(F.pmod(F.col("n"), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503 + 12345), F.lit(1 << 31))
    pooled = rows.df.filter(~canonical & (F.col("earlier") > 0))
    pooled = pooled.select(*labels.keys, "n", "label", (mixed % F.col("earlier")).alias("pick"))
    ranked = rows.df.filter(canonical).select(*labels.keys, F.coalesce("earlier", F.lit(0)).alias("pick"), F.col("n").alias("control"))
    return pooled.join(ranked, [*labels.keys, "pick"]).select(*labels.keys, "n", "label", "control")
