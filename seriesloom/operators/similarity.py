"""Signatures of series and exact nearest-neighbour search between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import centred, dot, doubles, unit
from seriesloom.operators.aggregates import mean_vector
from seriesloom.plans.series import Series
from seriesloom.session import checkpointed

MAX_PIVOTS = 512
CHUNK = 4096  # rows of a cell that are compared at a time
BUNDLE = 16  # chunks of either side that meet in one group at most
SIDES = 8  # groups that either side of a smaller table is cut into
SLICE = 512  # rows that are compared with a chunk, or with the pivots, at a time
VISITS = 8192  # rows with a vector that leave a task at a time
SLACK = 1e-9  # distances are compared with a margin above their rounding error


# -- signatures ---------------------------------------------------------------------------------
def shape_signature(rows: Series, vector: str, audible: float = -40.0) -> DataFrame:
    """Mean vector over the audible rows, centred and scaled to length one."""
    heard = rows.df.filter(F.col("a") > audible)
    return mean_vector(heard, list(rows.keys), vector, "m").select(*rows.keys, unit(centred(F.col("m"))).alias("shape"))


def motion_signature(rows: Series, vector: str, audible: float = -40.0) -> DataFrame:
    """Mean absolute change between consecutive rows that are both audible, centred, unit length."""
    out = rows.around(1, 0, v0=lambda w: F.lag(vector).over(w), a0=lambda w: F.lag("a").over(w))
    both = out.df.filter((F.col("a") > audible) & (F.col("a0") > audible))
    moved = both.select(*rows.keys, F.zip_with(doubles(F.col(vector)), doubles(F.col("v0")), lambda p, q: F.abs(p - q)).alias("d"))
    return mean_vector(moved, list(rows.keys), "d", "m").select(*rows.keys, unit(centred(F.col("m"))).alias("motion"))


def signatures(rows: Series, vector: str, size: int, audible: float = -40.0, motion_weight: float = 0.4) -> DataFrame:
    """Shape and motion weighted by sqrt(1 - w) and sqrt(w), joined and scaled to length one.

    A series with nothing audible keeps zeros in that half.
    """
    keys = list(rows.keys)
    zeros = F.array_repeat(F.lit(0.0), size)
    listed = rows.df.select(*keys).distinct()
    both = listed.join(shape_signature(rows, vector, audible), keys, "left").join(
        motion_signature(rows, vector, audible), keys, "left"
    )
    part = lambda c, w: F.transform(F.coalesce(F.col(c), zeros), lambda x: x * math.sqrt(w))
    return both.select(*keys, unit(F.concat(part("shape", 1 - motion_weight), part("motion", motion_weight))).alias("sig"))


def profiles(items: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of the liked signatures per group, scaled to length one."""
    return mean_vector(items, keys, vector, "m").select(*keys, unit(F.col("m")).alias("profile"))


def scored(items: DataFrame, profile: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Cosine of every item with the profile of its group."""
    return items.join(profile, keys).withColumn("score", dot(F.col("profile"), F.col(vector)))


# -- exact neighbours ---------------------------------------------------------------------------
def _pivots(items: DataFrame, count: int) -> np.ndarray:
    """A bounded number of vectors (at most 512) picked by a hash of their id."""
    rows = items.orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()
    return np.asarray([r["v"] for r in rows], dtype=np.float64)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (m**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * (m @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _visits(pdf: pd.DataFrame, pivots: np.ndarray, cells: list, reach, bundle: np.ndarray | None = None, ahead: bool = False) -> Iterator[pd.DataFrame]:
    """A query once for each cell that it has to visit, at most ``VISITS`` rows at a time.

    With ``bundle``, the bundle of every pivot's cell, once for each bundle that holds such a cell; ``ahead`` leaves out the
    bundles before its own.
    """
    order, radius = np.array([c["cell"] for c in cells], dtype="int32"), np.array([c["radius"] for c in cells])
    for at in range(0, len(pdf), SLICE):
        part = pdf.iloc[at : at + SLICE]
        away = _distances(np.vstack(part["v"].to_numpy()), pivots)[:, order]
        limit = reach.limit(away, cells)
        row, col = np.nonzero(away - radius[None, :] <= limit[:, None] + SLACK)
        to = order[col]
        if bundle is not None:
            row, to = np.unique(np.stack([row, bundle[to]]), axis=1)
            if ahead:
                later = to >= bundle[part["cell"].to_numpy()][row]
                row, to = row[later], to[later]
        for lo in range(0, len(row), VISITS):
            r, c = row[lo : lo + VISITS], to[lo : lo + VISITS]
            out = part.iloc[r].reset_index(drop=True)
            yield out.assign(**{"cell" if bundle is None else "bundle": c.astype("int32"), "reach": limit[r]})


def _bundles(cells: list, pivots: np.ndarray, most: int) -> np.ndarray:
    """The bundle of every pivot's cell: cells along a walk from pivot to nearest pivot, about ``most`` rows together."""
    out, held = np.full(len(pivots), -1, dtype="int32"), {c["cell"]: c["held"] for c in cells}
    rest, at, number, rows = np.array(list(held)), next(iter(held), 0), 0, 0
    while len(rest):
        at = rest[_distances(pivots[[at]], pivots[rest])[0].argmin()]
        rest = rest[rest != at]
        if rows and rows + held[at] > most:
            number, rows = number + 1, 0
        out[at], rows = number, rows + held[at]
    return out


def _near_groups(items: DataFrame, reach, kernel, ahead: bool = False) -> DataFrame:
    """Scores of every pair that can matter, from groups of bounded size on both sides.

    Vectors live in the cell of their nearest pivot. By the triangle inequality a query with reach
    r only has to compare itself with cells whose ball is closer than r; ``reach(distances, cells)`` gives r per
    query. Cells are bundled, and a vector travels once for each group of a bundle, not for each cell: with bundles of 65,536
    rows the rows moved are those of the table times its 32,768th part. Bundles of any size are cut on both sides.
    """
    total = items.count()
    pivots = _pivots(items, max(1, min(MAX_PIVOTS, total // CHUNK)))
    most = min(BUNDLE * CHUNK, max(CHUNK, total // SIDES))
    id_type = items.schema["id"].dataType
    base = T.StructType([T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                away = _distances(np.vstack(part["v"].to_numpy()), pivots)
                cell = away.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), d=away[np.arange(len(part)), cell])

    # Written once: a vector must have one cell for all that read it, and distances round as rows happen to lie together.
    placed = checkpointed(items.select("id", "v").mapInPandas(place, T.StructType([*base, T.StructField("d", T.DoubleType())])))
    # One row per cell (at most 512): size, radius and the k-th smallest radius for the reach.
    cells = reach.cells(placed)
    bundle = _bundles(cells, pivots, most)
    sizes: dict[int, int] = {}
    for c in cells:
        sizes[int(bundle[c["cell"]])] = sizes.get(int(bundle[c["cell"]]), 0) + c["held"]
    radius = np.zeros(len(pivots))
    for c in cells:
        radius[c["cell"]] = c["radius"]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _visits(pdf[["id", "v", "cell"]], pivots, cells, reach, bundle, ahead)

    def visitors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _visits(pdf[["v", "cell"]], pivots, cells, reach, bundle, ahead):
                yield part.groupby("bundle").size().rename("visitors").reset_index()

    counted = placed.mapInPandas(visitors, "bundle int, visitors long").groupBy("bundle").agg(F.sum("visitors").alias("visitors"))
    visited = {r["bundle"]: r["visitors"] for r in counted.collect()}
    parts = lambda rows: {k: max(1, math.ceil(n / most)) for k, n in rows.items()}
    of = lambda counts: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in counts.items() for x in p]), F.col("bundle")), F.lit(1))
    chunks, waves = (of(parts(x)) if x else F.lit(1) for x in (sizes, visited))
    at = ["bundle", "s", "g"]
    visit_type = T.StructType([*base, T.StructField("bundle", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    queries = placed.mapInPandas(visit, visit_type).withColumn("g", F.pmod(F.xxhash64("id", F.lit(7)), waves).cast("int"))
    queries = queries.withColumn("s", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("corpus", F.lit(False))
    own = F.get(F.array(*[F.lit(n) for n in bundle.tolist()]).cast("array<int>"), F.col("cell"))
    corpus = placed.select("id", "v", "cell", own.alias("bundle"), F.lit(0.0).alias("reach"))
    corpus = corpus.withColumn("s", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    corpus = corpus.withColumn("g", F.explode(F.sequence(F.lit(0), waves - 1))).withColumn("corpus", F.lit(True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for side in (False, True):
                part = batch.filter(pc.equal(batch.column("corpus"), side))
                if part.num_rows:
                    sides[side].append(part)
        if sides[0] and sides[1]:
            yield from kernel(_slices(*map(pa.Table.from_batches, sides), pivots, radius, bundle))

    out = T.StructType([T.StructField("id", id_type), T.StructField("other", id_type), T.StructField("score", T.DoubleType())])
    return queries.unionByName(corpus).select(*at, "corpus", "id", "v", "cell", "reach").groupBy(*at).applyInArrow(score, out)


def _slices(a: pa.Table, b: pa.Table, pivots: np.ndarray, radius: np.ndarray, bundle: np.ndarray) -> Iterator[tuple]:
    """(ids, whether they are at home, pieces) of every ``SLICE`` queries; a piece is (rows, scores, their other ids)."""
    matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    order = np.argsort(b["cell"].to_numpy(), kind="stable")
    x, y, ids, others, cell = matrix(a), matrix(b)[order], a["id"].to_numpy(), b["id"].to_numpy()[order], b["cell"].to_numpy()[order]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    here, reach = cell[starts], a["reach"].to_numpy()
    home = bundle[a["cell"].to_numpy()] == bundle[cell[0]]

    def pieces(lo: int, mine: np.ndarray) -> Iterator[tuple]:
        some = x[lo : lo + SLICE]
        need = _distances(some, pivots[here]) - radius[here] <= reach[lo : lo + SLICE, None] + SLACK
        for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(y)])):
            rows = np.flatnonzero(need[:, k])
            for p in range(start, end if len(rows) else start, CHUNK):
                names = others[p : min(p + CHUNK, end)]
                s = some[rows] @ y[p : min(p + CHUNK, end)].T
                s[mine[rows][:, None] == names[None, :]] = -np.inf
                yield rows, s, names

    for lo in range(0, len(x), SLICE):
        mine = ids[lo : lo + SLICE]
        yield mine, home[lo : lo + SLICE], pieces(lo, mine)


class _NearestReach:
    """Reach of a k-nearest query: some cell is known to hold k other vectors within it."""

    def __init__(self, k: int):
        self.k = k

    def cells(self, placed: DataFrame):
        w = Window.partitionBy("cell").orderBy("d", "id")
        low = placed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= self.k + 1)
        low = low.groupBy("cell").agg(F.max("d").alias("kth"), F.count(F.lit(1)).alias("low"))
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.max("d").alias("radius"))
        return sizes.join(low, "cell").collect()

    def limit(self, away: np.ndarray, cells: list) -> np.ndarray:
        full = [i for i, c in enumerate(cells) if c["low"] > self.k]
        if not full:
            return np.full(len(away), np.inf)
        kth = np.array([cells[i]["kth"] for i in full])
        return (away[:, full] + kth[None, :]).min(axis=1)


class _FixedReach:
    def __init__(self, distance: float):
        self.distance = distance

    def cells(self, placed: DataFrame):
        return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.max("d").alias("radius")).collect()

    def limit(self, away: np.ndarray, cells: list) -> np.ndarray:
        return np.full(len(away), self.distance)


def _batch(ids: np.ndarray, others: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(scores)], ["id", "other", "score"])


def _first(row: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every row, ties to the smaller id."""
    order = np.lexsort((other, -score, row))
    row, score, other = row[order], score[order], other[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], score[keep], other[keep]


def _best(slices: Iterator[tuple], k: int) -> Iterator[pa.RecordBatch]:
    """The k best scores of every query of a group; what can't be among them is dropped piece by piece."""
    for mine, _, pieces in slices:
        found, least, last = None, np.full(len(mine), -np.inf), mine.copy()
        for rows, s, names in pieces:
            floor = least[rows]
            if s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, -k)[:, -k]) if np.isneginf(floor).any() else floor
            r, c = np.nonzero(s >= floor[:, None])
            # Of equal scores only smaller ids can come in once a query has its k.
            real = np.isfinite(s[r, c]) & ((s[r, c] > least[rows[r]]) | (names[c] < last[rows[r]]) | np.isneginf(least[rows[r]]))
            new = rows[r[real]], s[r[real], c[real]], names[c[real]]
            found = _first(*(np.concatenate(p) for p in zip(found, new)), k) if found else _first(*new, k)
            full = np.flatnonzero(np.bincount(found[0], minlength=len(mine)) == k)
            worst = np.searchsorted(found[0], full, side="right") - 1
            least[full], last[full] = found[1][worst], found[2][worst]
        if found and len(found[0]):
            yield _batch(mine[found[0]], found[2], found[1])


def _above(slices: Iterator[tuple], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs ``id < other`` of a group that reach ``least``; a query meets the bundles from its own on."""
    for mine, home, pieces in slices:
        for rows, s, names in pieces:
            r, c = np.nonzero(s >= least)
            a, b, r, score = mine[rows[r]], names[c], rows[r], s[r, c]
            keep = (a < b) | ~home[r]
            a, b, score = a[keep], b[keep], score[keep]
            if len(a):
                yield _batch(np.where(a < b, a, b), np.where(a < b, b, a), score)


def top_matches(items: DataFrame, k: int) -> DataFrame:
    """``id, other, score, rank``: the k best cosines of every unit vector (``id, v``), exactly.

    Every group emits at most k rows per query; ties go to the smaller id.
    """
    found = _near_groups(items, _NearestReach(k), lambda slices: _best(slices, k))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar_pairs(items: DataFrame, min_score: float) -> DataFrame:
    """Pairs ``id < other`` of unit vectors whose cosine reaches ``min_score``, exactly."""
    reach = _FixedReach(math.sqrt(max(0.0, 2.0 - 2.0 * min_score)))
    return _near_groups(items, reach, lambda slices: _above(slices, min_score), ahead=True)
