"""Hard negatives by coordinate pruning: length buckets, sorted coordinate lists, feasible ranges of focus coordinates.

For an anchor q and a least score s, a vector p of a bucket whose longest vector has length m needs a cosine of at
least t = s / (|q| m). Then no coordinate of p's direction can leave the angle acos(t) around q's: with q' = q / |q|
it lies between cos(acos(q'_f) + acos(t)) and cos(acos(q'_f) - acos(t)). In a tile of a bucket, sorted lists turn
such ranges of the anchor's largest coordinates into candidate sets, whose intersection is verified exactly. Anchors
whose ranges rule out little are verified by one matrix product per tile.

The least scores come from rounds: the first compares a few thousand rows, each further one sixteen times more, and
the k-th score found so far is the next round's least score. So a round returns few rows per anchor, however many
rows the table has, and whole buckets that are too short for an anchor aren't sent to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.store import stored
from seriesloom.llm.vectors import usable

RATIO = 0.9  # the shortest length of a bucket over its longest
SEED = 4096  # rows of the first round, more or less
STEP = 16  # how many times more rows each further round compares
TILE = 1 << 16  # most rows, and most anchors, that one task compares
FOCUS = 4  # coordinates of an anchor whose lists are intersected
_PAIRS = 1 << 20  # scores that are held at once
_TOP = np.iinfo(np.int64).max
_HITS = "ask_id long, ask long, j int, vec_id long, score long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-number vectors as bytes (16 bits a component where all fit, else 64), their length and its bucket."""
    for batch in batches:
        blobs, lengths = [], np.zeros(len(batch))
        for i, v in enumerate(batch.column("v")):
            x = v.values.to_numpy()
            lengths[i] = math.sqrt(float((x.astype(np.float64) ** 2).sum()))
            blobs.append(x.astype("<i2" if np.abs(x.astype(np.float64)).max() < 1 << 15 else "<i8").tobytes())
        bucket = np.floor(np.log(np.maximum(lengths, 0.5)) / -math.log(RATIO)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("vec_id", "label", "anchor", "dim")), pa.array(blobs, pa.binary()), pa.array(lengths), pa.array(bucket)],
            ["vec_id", "label", "anchor", "dim", "v", "len", "bucket"],
        )


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim), np.int64)
    for size, kind in ((2, "<i2"), (8, "<i8")):
        at = [i for i, b in enumerate(blobs) if len(b) == size * dim]
        out[at] = np.frombuffer(b"".join(blobs[i] for i in at), kind).reshape(-1, dim)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices; those beyond 64 bits saturate."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    rough = x @ y.T
    most = (np.abs(x).max(initial=0) or 1) * (np.abs(y).max(initial=0) or 1) * max(1, a.shape[1])
    if most < 2.0**52:
        return rough.astype(np.int64)
    exact = a @ b.T  # modulo 2^64, hence exact wherever the result fits
    if most >= 2.0**62:
        exact = np.where(rough >= 2.0**63 - 2.0**20, _TOP, np.where(rough <= -(2.0**63) + 2.0**20, -_TOP, exact))
    return exact


def feasible(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a coordinate of a unit vector whose cosine with a unit vector is at least ``t``,
    where that one's coordinate is ``q``."""
    side = np.sqrt(np.maximum(0, (1 - t * t) * (1 - q * q)))
    return np.where(q < -t, -1.0, q * t - side) - 1e-9, np.where(q > t, 1.0, q * t + side) + 1e-9


def candidates(x: np.ndarray, q: np.ndarray, least: np.ndarray, share: float = 0.25) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, rows): which rows of ``x`` can reach each anchor's least score; anchors that go together share rows.

    The lists of a coordinate are sorted when an anchor first asks for it. The shortest feasible stretch of an
    anchor's focus coordinates gives its candidates, the others' ranges cut them down. Anchors for which no stretch is
    below ``share`` of the rows go together, with all rows.
    """
    length, mine = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(least > 0, least / (mine * length.max(initial=0)), 0.0)
        unit, own = x / np.where(length > 0, length, 1)[:, None], q / np.where(mine > 0, mine, 1)[:, None]
    live = np.flatnonzero(~(t > 1 + 1e-9))  # the others' bucket is too short
    t = np.minimum(t, 1.0)
    focus = np.argsort(-np.abs(own), axis=1, kind="stable")[:, :FOCUS]
    low, high = feasible(np.take_along_axis(own, focus, 1), t[:, None])
    first, after = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(x), np.int64)
    order: dict[int, np.ndarray] = {}
    pruned = np.zeros(len(q), bool)
    pruned[live] = t[live] > 0
    for f in np.unique(focus[pruned]):
        order[f] = np.argsort(unit[:, f], kind="stable")
        ranked = unit[order[f], f]
        i, j = np.nonzero((focus == f) & pruned[:, None])
        first[i, j] = np.searchsorted(ranked, low[i, j], "left")
        after[i, j] = np.searchsorted(ranked, high[i, j], "right")
    count = after - first
    few = pruned & (count.min(1, initial=len(x)) < share * len(x))
    rest = live[~few[live]]
    if len(rest):
        yield rest, np.arange(len(x))
    for i in live[few[live]]:
        best = int(count[i].argmin())
        rows = order[focus[i, best]][first[i, best] : after[i, best]]
        for j in range(focus.shape[1]):
            if j != best and len(rows):
                value = unit[rows, focus[i, j]]
                rows = rows[(value >= low[i, j]) & (value <= high[i, j])]
        if len(rows):
            yield np.array([i]), np.sort(rows)


def _best_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of every row above the lowest integer, ties to the smaller id."""
    none = np.iinfo(np.int64).min
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        keep = (s >= edge[:, None]) & (s > none)
    else:
        keep = s > none
    i, j = np.nonzero(keep)
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k]


def _solver(k: int, same: bool):
    names = ["ask_id", "ask", "j", "vec_id", "score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def solve(group: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in names]
        of_ask = np.asarray(group["ask"].is_valid())
        a, b = group.filter(pa.array(of_ask)), group.filter(pa.array(~of_ask))
        if len(a) and len(b):
            dim = group["dim"][0].as_py()
            q, x = _matrix(a["v"].to_pylist(), dim), _matrix(b["v"].to_pylist(), dim)
            ask, ask_id, ids = a["ask"].to_numpy(), a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            codes = pd.factorize(np.array(a["label"].to_pylist() + b["label"].to_pylist(), object))[0]
            label, other = codes[: len(a)], codes[len(a) :]
            spans = a["spans"].to_pylist()
            width = max(len(s) for s in spans)
            lo, hi, slot = (np.full((len(a), width), v, np.int64) for v in (_TOP, -_TOP, 0))
            for i, s in enumerate(spans):
                for j, r in enumerate(s):
                    slot[i, j], lo[i, j], hi[i, j] = r["j"], r["lo"], r["hi"]
            for some, rows in candidates(x.astype(np.float64), q.astype(np.float64), lo.min(1).astype(np.float64) * (1 - 1e-12)):
                step = max(1, _PAIRS // len(rows))
                for at in range(0, len(some), step):
                    mine = some[at : at + step]
                    s = scores(q[mine], x[rows])
                    barred = (ask_id[mine][:, None] == ids[rows][None, :]) | ((label[mine][:, None] == other[rows][None, :]) != same)
                    for j in range(width):
                        fits = ~barred & (s >= lo[mine, j][:, None]) & (s <= hi[mine, j][:, None])
                        i, c = _best_of(np.where(fits, s, np.iinfo(np.int64).min), ids[rows], k)
                        for column, value in zip(out, (ask_id[mine][i], ask[mine][i], slot[mine[i], j], ids[rows][c], s[i, c])):
                            column.append(value)
        columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), t) for c, t in zip(out, types)]
        return pa.table(columns, names)

    return solve


def _search(asks: DataFrame, spans: DataFrame, rows: DataFrame, total: int, k: int, same: bool, name: str) -> DataFrame:
    """(ask_id, ask, j, vec_id, score, rank): of the rows of the same (or only of other) labels whose score lies in
    span j of an ask, both ends included, the first k by score, ties to the smaller id. Rows that share the ask's id
    are the ask itself."""
    place = ["dim", "label"] if same else ["dim"]
    tile = min(TILE, max(512, total // 16))
    spread = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sized = F.ceil(F.log(spread * total / SEED) / math.log(STEP))
    rounds = max(0, math.ceil(math.log(max(1.0, total / SEED), STEP))) + 1
    rows = rows.withColumn("round", F.greatest(F.lit(0), F.least(F.lit(rounds - 1), F.coalesce(sized, F.lit(0)))).cast("int"))
    blocks = asks.groupBy(place).agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    best = None
    for r in range(rounds):
        least = spans
        if best is not None:
            full = best.groupBy("ask_id", "ask", "j").agg(F.count("*").alias("n"), F.min("score").alias("reached")).where(F.col("n") >= k)
            least = spans.join(full, ["ask_id", "ask", "j"], "left").withColumn("lo", F.greatest("lo", F.coalesce("reached", "lo")))
        least = least.groupBy("ask_id", "ask").agg(F.collect_list(F.struct("j", "lo", "hi")).alias("spans"), F.min("lo").alias("least"))
        some = rows.where(F.col("round") == r)
        tiles = some.groupBy(*place, "bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.max("len").alias("longest"))
        sent = asks.join(least, ["ask_id", "ask"]).join(tiles, place)
        sent = sent.where(F.col("len") * F.col("longest") * (1 + 1e-9) >= F.col("least"))
        sent = sent.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        sent = sent.join(blocks, place).withColumn("block", F.pmod(F.hash("ask"), F.col("blocks")))
        data = some.join(tiles, [*place, "bucket"]).withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.col("tiles")).cast("int"))
        data = data.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sides = sent.select(*place, "bucket", "tile", "block", F.col("ask_id").alias("vec_id"), "ask", *({"label", "dim"} - set(place)), "v", "spans")
        sides = sides.unionByName(data.select(*place, "bucket", "tile", "block", "vec_id", *({"label", "dim"} - set(place)), "v"), allowMissingColumns=True)
        hits = sides.groupBy(*place, "bucket", "tile", "block").applyInArrow(_solver(k, same), _HITS)
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        order = F.row_number().over(Window.partitionBy("ask_id", "ask", "j").orderBy(F.desc("score"), "vec_id"))
        best = stored(hits.withColumn("rank", order).where(F.col("rank") <= k), f"{name}-{r}")
    return best


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is the inner product of ``floor(scale * x)`` with the anchor's. An anchor's positives are its
    first ``positives`` other rows of the same label; for each of them come the first ``negatives`` rows of other labels
    with ``least * positive_score <= 100 * negative_score <= most * positive_score``. Higher scores come first, then
    smaller ids; fewer rows where there are fewer. A negative positive score has no such rows.

    Rows with a null label, a null id, a null or empty vector or a null or non-finite component take no part; vectors
    of different lengths don't meet. Rows that share the anchor's id count as the anchor itself, other repeated rows are
    rows of their own; anchors that repeat id, label and vector are one. Components and scores beyond 64 bits
    saturate. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    fit = usable(F.col(vector)) & F.col(vec_id).isNotNull() & F.col(label).isNotNull()
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(fit).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.size(vector).alias("dim"), whole.alias("v"),
    )
    packed = "vec_id long, label string, anchor boolean, dim int, v binary, len double, bucket int"
    rows = stored(rows.mapInArrow(_pack, packed), "negative-rows")
    total = rows.count()
    key = F.xxhash64("vec_id", "label", "v")
    asks = rows.where("anchor").dropDuplicates(["vec_id", "label", "v"]).select(F.col("vec_id").alias("ask_id"), key.alias("ask"), "label", "dim", "v", "len")
    every = asks.select("ask_id", "ask", F.lit(0).alias("j"), F.lit(-_TOP).alias("lo"), F.lit(_TOP).alias("hi"))
    found = _search(asks, every, rows.drop("anchor"), total, positives, True, "positives")
    found = found.select("ask_id", "ask", (F.col("rank") - 1).cast("int").alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # least * p / 100 upwards and most * p / 100 downwards, without a product that could leave 64 bits
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    lo = hundreds * least + F.expr(f"({least} * pmod(positive_score, 100) + 99) div 100")
    hi = hundreds * most + F.expr(f"({most} * pmod(positive_score, 100)) div 100")
    spans = found.select("ask_id", "ask", "j", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    near = _search(asks, spans, rows.drop("anchor"), total, negatives, False, "negatives")
    near = near.select("ask_id", "ask", "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["ask_id", "ask", "j"]).select(
        F.col("ask_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
