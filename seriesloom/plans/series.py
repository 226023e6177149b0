"""Keyed, ordered series and the scans over them.

A series that fits one task (checked against ``seriesloom.block.rows``) is scanned with ordinary
windows: one shuffle on the key, one sort, no joins. When any series is longer than that, every
scan runs on two levels instead: inside bounded blocks of the series, then over one summary row
per block, whose result is joined back as a carry. Both layouts give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import MAX_RANGE_PARTITIONS, block_rows, checkpointed

START = Window.unboundedPreceding


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups (counted map-side first)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    largest, total = counts.agg(F.max("rows"), F.sum("rows")).first()
    return largest or 0, total or 0


def has_long_group(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    return group_sizes(df, keys)[0] > limit


def index_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], layout: str = "auto") -> Series:
    """Number the rows of each series 0, 1, 2, ... along ``order`` (which must be unique in a series).

    ``layout`` is ``plain``, ``blocked`` or ``auto`` (blocked when some series exceeds the limit).
    """
    keys, order = list(keys), list(order)
    limit = block_rows(df.sparkSession)
    largest, total = group_sizes(df, keys)
    if layout == "plain" or (layout == "auto" and largest <= limit):
        w = Window.partitionBy(*keys).orderBy(*order)
        return Series(df.withColumn("n", (F.row_number().over(w) - 1).cast("long")), tuple(keys), order=tuple(order))

    # A sampled range sort balances the blocks whatever the skew; it is written out once because
    # block numbers come from the physical partitions and must not change between readers.
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / limit))
    parts = min(parts, MAX_RANGE_PARTITIONS)
    ranged = df.repartitionByRange(parts, *keys, *order)
    ranged = checkpointed(ranged.withColumn("blk", F.spark_partition_id().cast("long")))
    sizes = ranged.groupBy(*keys, "blk").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("blk").rowsBetween(START, -1))
    sizes = sizes.select(*keys, "blk", F.coalesce(before, F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "blk").orderBy(*order)) - 1
    rows = ranged.withColumn("at", local).join(sizes, [*keys, "blk"])
    rows = rows.withColumn("n", (F.col("at") + F.col("offset")).cast("long")).drop("at", "offset")
    return Series(rows, tuple(keys), block="blk")


def dense_series(df: DataFrame, keys: Sequence[str], layout: str = "auto") -> Series:
    """Wrap rows that already carry a dense 0-based ``n`` per series."""
    keys = list(keys)
    limit = block_rows(df.sparkSession)
    if layout == "auto":
        layout = "blocked" if has_long_group(df, keys, limit) else "plain"
    if layout == "plain":
        return Series(df, tuple(keys))
    return Series(df.withColumn("blk", F.floor(F.col("n") / limit)), tuple(keys), block="blk")


@dataclass(frozen=True)
class Series:
    """Rows ``keys + n + payload``; ``block`` names the block column in the blocked layout.

    ``order`` names the columns ``n`` was numbered along while they are still there: windows over
    them find the rows already sorted.
    """

    df: DataFrame
    keys: tuple[str, ...]
    block: str | None = None
    order: tuple[str, ...] = ("n",)
    settled: DataFrame | None = None

    # -- plumbing ---------------------------------------------------------------------------
    @property
    def _cell(self) -> list[str]:
        return [*self.keys, self.block] if self.block else list(self.keys)

    @property
    def _ordered(self):
        return Window.partitionBy(*self._cell).orderBy(*(("n",) if self.block else self.order))

    def _settle(self) -> Series:
        """Write the rows once before a step that reads them twice (blocked layout only).

        Without it every such step would double the work of all the steps before it.
        """
        if not self.block or self.settled is self.df:
            return self
        kept = self.__dict__.get("_kept")
        if kept is None:
            rows = checkpointed(self.df)
            kept = replace(self, df=rows, settled=rows)
            object.__setattr__(self, "_kept", kept)  # later readers of this series share the copy
        return kept

    def _over_blocks(self):
        return Window.partitionBy(*self.keys).orderBy(self.block)

    def with_columns(self, **columns: Column) -> Series:
        """Add row-local columns, in the order given."""
        out = self.df
        for name, column in columns.items():
            out = out.withColumn(name, column)
        return replace(self, df=out)

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)

    def slim(self, *columns) -> Series:
        """Only the key, the order and the named columns."""
        order = [c for c in self.order if c not in ("n", *columns)]
        return replace(self, df=self.df.select(*self._cell, *([] if self.block else order), "n", *columns))

    def split_by(self, name: str, values: Sequence, dtype: str = "double") -> Series:
        """Repeat every series once per value; the value becomes part of the key."""
        copies = F.explode(F.array(*[F.lit(v).cast(dtype) for v in values]))
        return replace(self, df=self.df.withColumn(name, copies), keys=(*self.keys, name))

    # -- neighbours -------------------------------------------------------------------------
    def around(self, before: int, after: int, /, **columns: Callable) -> Series:
        """Columns computed from at most ``before``/``after`` neighbouring rows.

        Each value is a function of the ordered window. Needs a dense ``n``.
        """
        if not self.block:
            w = self._ordered
            return replace(self, df=self.df.withColumns({k: f(w) for k, f in columns.items()}))
        size = max(block_rows(self.df.sparkSession), before + after)
        at = F.pmod(F.col("n"), F.lit(size))
        home = F.floor(F.col("n") / size)
        homes = F.array_compact(
            F.array(
                home,
                F.when((at < after) & (home > 0), home - 1),
                F.when(at >= size - before, home + 1),
            )
        )
        spread = self.df.drop(self.block).withColumn("blk", F.explode(homes))
        w = Window.partitionBy(*self.keys, "blk").orderBy("n")
        out = spread.withColumns({k: f(w) for k, f in columns.items()})
        return replace(self, df=out.filter(F.col("blk") == F.floor(F.col("n") / size)), block="blk")

    # -- whole-series values ----------------------------------------------------------------
    def totals(self, **aggregates: Column) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*[a.alias(k) for k, a in aggregates.items()])

    def attach(self, facts: DataFrame, how: str = "inner") -> Series:
        """Join one-row-per-series facts onto the rows.

        In the blocked layout the facts go to the blocks first, so that a long series joins on
        (key, block) and never gathers on its key alone.
        """
        if not self.block:
            return replace(self, df=self.df.join(facts, list(self.keys), how))
        held = self._settle()
        blocks = held.df.select(*self._cell).distinct().join(facts, list(self.keys), how)
        return replace(held, df=held.df.join(blocks, self._cell, how))

    def stats(self, **aggregates: Column) -> Series:
        """Whole-series aggregates as columns of every row."""
        if not self.block:
            w = Window.partitionBy(*self.keys)
            return replace(self, df=self.df.withColumns({k: a.over(w) for k, a in aggregates.items()}))
        held = self._settle()
        return held.attach(held.totals(**aggregates))

    # -- running scans ----------------------------------------------------------------------
    def running(self, end: int = 0, backwards: bool = False, **scans: tuple[str, Column]) -> Series:
        """Running ``sum``, ``count``, ``max``, ``min`` or ``last`` (non-null).

        A row sees everything up to itself (``end=0``) or up to the row before (``end=-1``);
        ``backwards`` walks from the end of the series, so ``last`` becomes the nearest row ahead.
        """
        w = self._ordered
        if backwards:
            w = Window.partitionBy(*self._cell).orderBy(F.col("n").desc())
        frame = w.rowsBetween(START, end)
        local = {k: _windowed(op, value, frame) for k, (op, value) in scans.items()}
        if not self.block:
            return replace(self, df=self.df.withColumns(local))
        outward = F.col(self.block).desc() if backwards else F.col(self.block).asc()
        prior = Window.partitionBy(*self.keys).orderBy(outward).rowsBetween(START, -1)
        rows = self._settle().df
        summary = rows.groupBy(*self._cell).agg(
            *[_folded(op, value, backwards).alias(f"in_{k}") for k, (op, value) in scans.items()]
        )
        summary = summary.select(
            *self._cell,
            *[_carried(op, F.col(f"in_{k}"), prior).alias(f"in_{k}") for k, (op, _) in scans.items()],
        )
        out = rows.withColumns(local).join(summary, self._cell)
        for k, (op, _) in scans.items():
            out = out.withColumn(k, _merged(op, F.col(f"in_{k}"), F.col(k))).drop(f"in_{k}")
        return replace(self, df=out)

    def reflected_sum(self, **increments: Column) -> Series:
        """``s = max(0, s + increment)`` from 0: the running sum minus its running minimum."""
        out = self
        for name, inc in increments.items():
            out = out._reflect(name, inc)
        return out

    def _reflect(self, name: str, inc: Column) -> Series:
        frame = self._ordered.rowsBetween(START, 0)
        out = self._settle().df.withColumn("walk", F.sum(inc).over(frame))
        out = out.withColumn("low", F.min("walk").over(frame))
        if not self.block:
            out = out.withColumn(name, F.col("walk") - F.least(F.lit(0.0), F.col("low")))
            return replace(self, df=out.drop("walk", "low"))
        prior = self._over_blocks().rowsBetween(START, -1)
        blocks = out.groupBy(*self._cell).agg(
            F.max_by("walk", "n").alias("gain"), F.min("walk").alias("dip")
        )
        blocks = blocks.withColumn("offset", F.coalesce(F.sum("gain").over(prior), F.lit(0.0)))
        blocks = blocks.withColumn("floor", F.min(F.col("offset") + F.col("dip")).over(prior))
        blocks = blocks.select(*self._cell, "offset", F.least(F.lit(0.0), F.col("floor")).alias("floor"))
        out = out.join(blocks, self._cell)
        lowest = F.least(F.col("floor"), F.col("offset") + F.col("low"))
        out = out.withColumn(name, F.col("offset") + F.col("walk") - lowest)
        return replace(self, df=out.drop("walk", "low", "offset", "floor"))

    def leaky_sum(self, factor: float, **steps: Column) -> Series:
        """``e = factor * e + step`` for a constant factor in (0, 1]."""
        if factor >= 1.0:
            return self.running(**{k: ("sum", s) for k, s in steps.items()})
        size = block_rows(self.df.sparkSession)
        rows = self._settle().df.withColumns({f"step_{k}": s for k, s in steps.items()})
        out = _leak(rows, list(self.keys), "n", list(steps), factor, size)
        return replace(self, df=out.drop(*[f"step_{k}" for k in steps]))

    def peak_hold(self, release: float, **levels: Column) -> Series:
        """``held = max(x, held * release)`` for non-negative levels, scaled anew in every span like a leaky sum.

        So a value is as exact at the end of a long series as at its start.
        """
        size = block_rows(self.df.sparkSession)
        steps = {f"step_{k}": F.coalesce(F.when(x > 0, x), F.lit(0.0)) for k, x in levels.items()}
        rows = self._settle().df.withColumns(steps)
        out = _leak(rows, list(self.keys), "n", list(levels), release, size, F.max, F.greatest)
        return replace(self, df=out.drop(*steps))

    def reblocked(self, size: int | None = None) -> Series:
        """The blocked layout with equal blocks ``n div size`` (dense ``n``)."""
        size = size or block_rows(self.df.sparkSession)
        return replace(self, df=self.df.withColumn("blk", F.floor(F.col("n") / size)), block="blk")


def _leak(df, keys, order, names, factor, size, fold=F.sum, merge=add):
    """Scaled prefix sums (or maxima) inside spans short enough for ``factor ** -span`` to stay finite."""
    span = max(1, min(size, int(200 / max(-math.log10(factor), 1e-12))))
    at = F.pmod(F.col(order), F.lit(span))
    df = df.withColumn("span", F.floor(F.col(order) / span))
    w = Window.partitionBy(*keys, "span").orderBy(order).rowsBetween(START, 0)
    grow = F.pow(F.lit(factor), -at)
    df = df.withColumns(
        {k: fold(F.col(f"step_{k}") * grow).over(w) * F.pow(F.lit(factor), at) for k in names}
    )
    ends = df.groupBy(*keys, "span").agg(*[F.max_by(k, order).alias(f"step_{k}") for k in names])
    jump = factor**span
    if jump > 1e-150:
        # The spans still talk to each other: the same recursion over their end values.
        ends = _leak(ends.withColumnRenamed("span", "part"), keys, "part", names, jump, size, fold, merge)
        ends = ends.select(*keys, F.col("part").alias("span"), *names)
    else:
        ends = ends.select(*keys, "span", *[F.col(f"step_{k}").alias(k) for k in names])
    carry = ends.select(*keys, (F.col("span") + 1).alias("span"), *[F.col(k).alias(f"in_{k}") for k in names])
    df = df.join(carry, [*keys, "span"], "left")
    decay = F.pow(F.lit(factor), at + 1)
    for k in names:
        df = df.withColumn(k, merge(F.col(k), F.coalesce(F.col(f"in_{k}"), F.lit(0.0)) * decay)).drop(f"in_{k}")
    return df.drop("span")


def _windowed(op: str, value: Column, frame) -> Column:
    if op == "sum":
        return F.sum(value).over(frame)
    if op == "count":
        return F.count(value).over(frame)
    if op == "max":
        return F.max(value).over(frame)
    if op == "min":
        return F.min(value).over(frame)
    if op == "last":
        return F.last(value, ignorenulls=True).over(frame)
    raise ValueError(f"unknown scan {op!r}")


def _folded(op: str, value: Column, backwards: bool) -> Column:
    if op == "last":
        pick = F.min_by if backwards else F.max_by
        return pick(value, F.when(value.isNotNull(), F.col("n")))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[op](value)


def _carried(op: str, value: Column, prior) -> Column:
    if op in ("sum", "count"):
        return F.sum(value).over(prior)
    return _windowed(op, value, prior)


def _merged(op: str, carry: Column, local: Column) -> Column:
    if op in ("sum", "count"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if op == "max":
        return F.greatest(carry, local)
    if op == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)
