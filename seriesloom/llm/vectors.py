"""Exact joins of vectors: near-duplicates within a metric range and nearest neighbours by Voronoi cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.store import components, stored

CELL = 1024  # vectors that a cell is meant to hold
TILE = 2048  # vectors of either side that one task compares
MAX_PIVOTS = 4096  # larger tables have larger cells, which are cut into more tiles
QUERIES_PER_CELL = 512
BUNDLE = 8  # tiles of queries, and of data, that meet in one task
SLICE = 256  # queries that are compared with a task's data at a time
PIECE = 8192  # rows with a vector that leave a task at a time
_AT_ONCE = 1 << 22  # distances or bounds that a task computes at a time


def usable(v: Column) -> Column:
    """No null, not empty, and all components present and finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares of large nor of small components get lost
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine_hits(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair of rows has a cosine of at least ``least``; pairs on the edge are computed anew one by one."""
    s = _unit(a) @ _unit(b).T
    hits = s >= least
    for i, j in zip(*np.nonzero(np.abs(s - least) < 1e-12)):
        hits[i, j] = float(a[i] @ b[j]) / float(np.sqrt((a[i] @ a[i]) * (b[j] @ b[j]))) >= least
    return hits


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of equal, non-null label with cosine >= ``least``.

    Equal vectors of a label are one class first, so a group of copies is one row of the join. On the unit sphere the
    threshold is a range r of Euclidean distance. Pivots cut each label (and dimension) into cells; by the triangle
    inequality a vector can have neighbours in another cell only within r of the boundary, i.e. if
    (d_other^2 - d_own^2) / (2 d(pivots)) <= r, and is replicated there. Cells are then joined independently, in tiles
    of bounded size; a tile returns link counts and a forest that connects what it found, never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, have no
    links and are their own component. Repeated rows are vectors of their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("class", F.when(fit, F.xxhash64("label", "v")))
    classes = stored(
        rows.where("class IS NOT NULL")
        .groupBy("class", "label", "v")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("dim", F.size("v")),
        "classes",
    )
    pivots = spark.sparkContext.broadcast(_pivots(classes, ["label", "dim"]))  # at most MAX_PIVOTS vectors
    reach = float(np.sqrt(2 - 2 * least)) + 1e-6

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(["label", "dim"], sort=False):
                found = pivots.value.get(key)
                if found is None:
                    yield part.assign(cell=0, home=True)
                    continue
                p = _unit(np.asarray(found))
                x = _unit(_matrix(part["v"]))
                square = np.maximum(0, 2 - 2 * x @ p.T)
                own = square.argmin(1)
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-18))[own]
                near = square - square[np.arange(len(x)), own][:, None] <= 2 * reach * apart + 1e-9
                near[np.arange(len(x)), own] = True
                i, j = np.nonzero(near)
                yield part.iloc[i].assign(cell=j, home=own[i] == j)

    schema = f"class long, label {dict(classes.dtypes)['label']}, v {dict(classes.dtypes)['v']}, rep long, n long, dim int, cell int, home boolean"
    placed = stored(classes.mapInPandas(assign, schema), "cells")
    place = ["label", "dim", "cell"]
    counts = placed.groupBy(place).agg((F.count_if("home") / TILE).cast("int").alias("h_most"), (F.count("*") / TILE).cast("int").alias("c_most"))
    placed = placed.join(counts, place)
    tile = lambda most, salt: F.pmod(F.xxhash64("class", F.lit(salt)), most + 1).cast("int")
    homes = placed.where("home").withColumn("h", tile(F.col("h_most"), 1)).withColumn("c", F.explode(F.sequence(F.lit(0), "c_most")))
    others = placed.withColumn("c", tile(F.col("c_most"), 2)).withColumn("h", F.explode(F.sequence(F.lit(0), "h_most")))
    sides = homes.withColumn("side", F.lit(0)).unionByName(others.withColumn("side", F.lit(1)))
    sides = sides.select(*place, "h", "c", "side", "class", "n", "v")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"class": [], "links": [], "root": []}).astype("int64")
        own, other = a["class"].to_numpy(), b["class"].to_numpy()
        hits = _cosine_hits(_matrix(a["v"]), _matrix(b["v"]), least)
        hits[own[:, None] == other[None, :]] = False
        root_a, root_b, last = own.copy(), other.copy(), None
        top = np.iinfo(np.int64).max
        while last is None or (last != root_a).any():
            last = root_a
            root_a = np.minimum(root_a, np.where(hits, root_b[None, :], top).min(1))
            root_b = np.minimum(root_b, np.where(hits, root_a[:, None], top).min(0))
        out = pd.concat([
            pd.DataFrame({"class": own, "links": hits @ b["n"].to_numpy(), "root": root_a}),
            pd.DataFrame({"class": other, "links": np.zeros(len(b), "int64"), "root": root_b}),
        ])
        return out[(out["links"] > 0) | (out["class"] != out["root"])]

    found = stored(sides.groupBy(*place, "h", "c").applyInPandas(compare, "class long, links long, root long"), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found, "class", "root").withColumnRenamed("node", "class")
    least_id = classes.join(roots, "class").groupBy("root").agg(F.min("rep").alias("component"))
    member = roots.join(least_id, "root").select("class", "component")
    facts = classes.select("class", "rep", "n").join(links, "class", "left").join(member, "class", "left")
    facts = facts.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("class IS NOT NULL").select("vec_id", "class").join(facts, "class").drop("class")
    alone = rows.where("class IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pivots(items: DataFrame, space: list[str], item: str = "class", v: str = "v") -> dict[tuple, list]:
    """Pivot vectors of every space with more than CELL items: those whose hashes are lowest, one for CELL items."""
    spark = items.sparkSession
    large = items.groupBy(space).count().where(F.col("count") > CELL).orderBy(F.desc("count")).limit(MAX_PIVOTS).collect()
    if not large:
        return {}
    total = sum(r["count"] for r in large)
    quota = [(*[r[c] for c in space], max(2, min(-(-r["count"] // CELL), MAX_PIVOTS * r["count"] // total))) for r in large]
    quotas = F.broadcast(spark.createDataFrame(quota, [*space, "quota"]))  # at most MAX_PIVOTS rows
    rank = F.row_number().over(Window.partitionBy(space).orderBy(F.xxhash64(item), item))
    chosen = items.withColumn("k", rank).where(F.col("k") <= max(q[-1] for q in quota)).join(quotas, space).where("k <= quota")
    out: dict[tuple, list] = {}
    for r in chosen.select(*space, v).collect():
        out.setdefault(tuple(r[c] for c in space), []).append(r[v])
    return out


def _bundles(asked: dict[tuple, int], pivots: dict[int, np.ndarray]) -> tuple[dict[tuple, int], list[int]]:
    """(bundle of every cell with queries, tiles of queries of every bundle): cells of a dimension along a walk from pivot to
    nearest pivot, at most BUNDLE tiles of queries together unless a cell alone has more."""
    out, sizes = {}, []
    for dim in sorted({d for d, _ in asked}):
        p, rest = pivots[dim], np.array([c for d, c in asked if d == dim])
        at, room = rest[0], -1
        while len(rest):
            at = rest[((p[rest] - p[at]) ** 2).sum(1).argmin()]
            rest = rest[rest != at]
            if asked[dim, at] > room:
                sizes.append(0)
                room = BUNDLE * TILE
            room -= asked[dim, at]
            sizes[-1] += asked[dim, at]
            out[dim, int(at)] = len(sizes) - 1
    return out, [-(-n // (BUNDLE * TILE)) for n in sizes]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, cells: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of ``floor(scale * x)`` for every query row.

    Pivots group queries and data. For a query q near pivot a and a vector x near pivot b, at distances up to Q and r
    from them, Cauchy and the triangle inequality give
    a.b - Q|b| - r(|a| + Q) <= q.x <= a.b + Q|b| + r(|a| + Q).
    From summaries (each query group's Q, each data group's k + 1 smallest r, one row for each id) comes the score that
    every query of a group is sure to reach k times; a vector is sent only where a group's bound can be met. Groups are bundled up to
    8 tiles of queries, and a vector travels once for each bundle, not for each group. Bundles are then solved locally in tiles of bounded
    size, and a query's tiles merge by rank.

    Ties go to the smaller id. A row is no candidate of its own query; rows that share an id count as the row itself.
    Query rows that repeat id and whole vector are one query, those that share only the id have an answer each.
    Repeated rows are candidates of their own.
    Vectors that are null, empty or hold null or non-finite components and rows without an id take no part; vectors of
    different lengths don't meet. Fewer than k candidates give fewer rows.
    """
    spark = vectors.sparkSession
    fit = usable(F.col(vector)) & F.col(vec_id).isNotNull()
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(fit).select(F.col(vec_id).alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("dim", F.size("v"))
    rows = stored(rows, "whole-vectors")
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    wanted = cells or min(MAX_PIVOTS, max(4, -(-asked // QUERIES_PER_CELL)))
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).union(rows.dropDuplicates(["dim"]).limit(MAX_PIVOTS)).collect():
        found.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: np.unique(np.asarray(p), axis=0) for d, p in found.items()}
    shared = spark.sparkContext.broadcast(pivots)  # at most 2 * MAX_PIVOTS vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=False):
                p, x = shared.value[dim], _matrix(part["v"])
                step = max(1, _AT_ONCE // len(p))
                square = lambda x: np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T)  # noqa: B023, E731
                own = np.concatenate([square(x[at : at + step]).argmin(1) for at in range(0, len(x), step)])
                # Computed anew, so that rounding leaves no negative or too small distance.
                yield part.assign(cell=own, r=np.sqrt(((x - p[own]) ** 2).sum(1)) * (1 + 1e-12))

    placed = stored(rows.mapInPandas(assign, "vec_id long, v array<double>, q boolean, dim int, cell int, r double"), "voronoi")
    asking = placed.where("q").groupBy("dim", "cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect()
    radius = {(x["dim"], x["cell"]): x["r"] for x in asking}
    bundles, waves = _bundles({(x["dim"], x["cell"]): x["n"] for x in asking}, pivots)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"dim": [], "cell": [], "r": []}).astype({"dim": "int32", "cell": "int32"})
        for batch in batches:
            held = pd.concat([held, batch]).sort_values("r").groupby(["dim", "cell"]).head(k + 1)
        yield held

    rank = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("r"))
    # One row for each id, so at most one of k + 1 is the query's own, however often its id occurs.
    once = placed.groupBy("dim", "vec_id").agg(F.min(F.struct("r", "cell")).alias("x")).select("dim", "x.cell", "x.r")
    summary = once.mapInPandas(nearest, "dim int, cell int, r double")
    smallest = summary.withColumn("k", rank).where(F.col("k") <= k + 1).select("dim", "cell", "r").toPandas()
    bounds: dict[int, tuple] = {}
    for dim, p in pivots.items():
        groups = np.array(sorted(c for d, c in radius if d == dim), int)
        big = np.array([radius[dim, c] for c in groups])
        inner, norm = p[groups] @ p.T, np.sqrt((p * p).sum(1))
        mine = smallest[smallest["dim"] == dim]
        at, near = mine["cell"].to_numpy(int), mine["r"].to_numpy()
        sure = np.full(len(groups), -np.inf)
        for g in range(len(groups) if len(at) > k else 0):
            low = inner[g, at] - big[g] * norm[at] - near * (norm[groups[g]] + big[g])
            sure[g] = np.partition(low, -(k + 1))[-(k + 1)]
        bounds[dim] = (groups, inner + big[:, None] * norm[None, :], norm[groups] + big, sure - 1e-6 * np.maximum(1, np.abs(sure)))
    limits = spark.sparkContext.broadcast(bounds)  # MAX_PIVOTS squared numbers at most

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, whole in batch.groupby("dim", sort=False):
                groups, high, slope, sure = limits.value[dim]
                if not len(groups):
                    continue
                bundle = np.array([bundles[dim, c] for c in groups])
                step = max(1, _AT_ONCE // len(groups))
                for part in (whole.iloc[at : at + step] for at in range(0, len(whole), step)):
                    can = high[:, part["cell"]] + part["r"].to_numpy()[None, :] * slope[:, None] >= sure[:, None]
                    for name in np.unique(bundle):
                        i = np.flatnonzero(can[bundle == name].any(0))
                        for at in range(0, len(i), PIECE):
                            some = part.iloc[i[at : at + PIECE]]
                            yield pd.DataFrame({"dim": dim, "group": name, "vec_id": some["vec_id"].to_numpy(), "v": some["v"].to_numpy()})

    d_tiles = int(total // (BUNDLE * TILE)) + 1
    at = spark.createDataFrame([(int(d), int(c), b) for (d, c), b in bundles.items()], "dim int, cell int, group int")  # at most MAX_PIVOTS for a length
    wide = F.get(F.array(*[F.lit(n) for n in waves or [1]]), F.col("group"))
    data = placed.mapInPandas(replicate, "dim int, group int, vec_id long, v array<double>")
    data = data.withColumns({"side": F.lit(1), "d": F.pmod(F.xxhash64("vec_id"), F.lit(d_tiles)), "t": F.explode(F.sequence(F.lit(0), wide - 1))})
    queries = placed.where("q").dropDuplicates(["vec_id", "v"]).withColumn("query", F.xxhash64("v")).join(at, ["dim", "cell"])
    ask = queries.select("dim", "group", "vec_id", "v", "query").withColumn("side", F.lit(0))
    ask = ask.withColumns({"d": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d_tiles - 1).cast("long"))), "t": F.pmod(F.hash("vec_id"), wide)})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1].sort_values("vec_id")
        found: list[list[np.ndarray]] = [[], [], [], []]
        if len(a) and len(b):
            x, y = _matrix(a["v"]), _matrix(b["v"])
            if np.abs(x).max() * np.abs(y).max() * x.shape[1] >= 2.0**52:
                x, y = x.astype(np.int64), y.astype(np.int64)
            asked, query, ids = a["vec_id"].to_numpy(), a["query"].to_numpy("int64"), b["vec_id"].to_numpy()
            for at in range(0, len(x), SLICE):
                scores = (x[at : at + SLICE] @ y.T).astype(np.int64)
                for q, which, row in zip(asked[at : at + SLICE], query[at : at + SLICE], scores):
                    other = ids != q
                    mine, names = row[other], ids[other]
                    if len(mine) > k:
                        least = np.partition(mine, -k)[-k]
                        above = np.flatnonzero(mine > least)
                        pick = np.concatenate([above, np.flatnonzero(mine == least)[: k - len(above)]])
                        mine, names = mine[pick], names[pick]
                    for column, values in zip(found, (np.full(len(mine), q), np.full(len(mine), which), names, mine)):
                        column.append(values)
        whole = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pd.DataFrame(dict(zip(["query_id", "query", "vec_id", "score"], whole))).astype("int64")

    sides = data.withColumn("query", F.lit(0).cast("long")).unionByName(ask)
    tiles = sides.groupBy("dim", "group", "d", "t").applyInPandas(solve, "query_id long, query long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
