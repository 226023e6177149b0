"""Exact order statistics per group without gathering a long group in one task, planned without looking at the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.plans.series import START

COARSE = 32  # a round cuts a group into COARSE * COARSE cells


def split_evenly(counts: DataFrame, part: Sequence[str], value: str, cell: str, **facts: Column) -> DataFrame:
    """Add ``cell``: 0, 1, ... along the values of a part, so that cells hold about equally many of its rows, and
    ``facts``, aggregates of the part.

    The splitters come from a mergeable sketch, so outliers don't stretch the cells; equal values share one. The sketch
    depends on the order in which its pieces meet, so the cells of two evaluations differ; a part without splitters is one cell.
    """
    shares = [k / COARSE**2 for k in range(1, COARSE**2)]
    cuts = counts.groupBy(*part).agg(
        F.percentile_approx(value, shares, 10 * COARSE**2).alias("_cuts"), *[fact.alias(name) for name, fact in facts.items()]
    )
    coarse = F.array(*[F.get("_cuts", F.lit(k * COARSE - 1)) for k in range(1, COARSE)])
    cuts = cuts.withColumn("_coarse", coarse)
    # How many coarse splitters a value has reached, then how many of the fine ones behind the last of these.
    reached = lambda array: F.coalesce(F.size(F.filter(array, lambda s: s <= F.col(value))), F.lit(0))
    out = counts.join(cuts, list(part), "left").withColumn("_at", reached("_coarse"))
    fine = F.slice("_cuts", F.col("_at") * COARSE + 1, COARSE - 1)
    return out.withColumn(cell, F.col("_at") * COARSE + reached(fine)).drop("_cuts", "_coarse", "_at")


def pick_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], rounds: int = 1) -> DataFrame:
    """One row per group: for each name the value at a 0-based rank (a function of the group size ``rows``).

    Equal values are counted before the shuffle, so ties of any size cost one row. A round narrows every group to the
    cells that hold its ranks, about one in 1,024 of its values each; the last ones are sorted, each by a task, and all
    ranks share them. Another round is worth its plan for groups of more than some 10^10 distinct values.
    A cell leaves its round as the values it reaches from and to: rows are found in it by these, as Spark computes the cells
    anew for each reader and the numbers of the cells would not agree.
    Nulls don't count; a rank outside the group gives null, a group without values no row.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("within")) for name, rank in ranks.items()])
    part, rows = keys, counts
    for k in range(rounds):
        if k == 0:
            rows = split_evenly(counts, part, value, "_cell", rows=F.sum("copies")).withColumn("wanted", asked)
        else:
            rows = split_evenly(rows, part, value, "_cell")
        # A cell's ranks among those of its part: its rows and the part's ranks travel with one row of the cell.
        ends = F.min(value).alias("_from"), F.max(value).alias("_to")
        held = rows.groupBy(*part, "_cell").agg(F.sum("copies").alias("held"), F.first("wanted").alias("wanted"), *ends)
        upto = F.sum("held").over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(START, 0))
        held = held.withColumn("before", upto - F.col("held"))
        mine = F.filter("wanted", lambda t: (t["within"] >= F.col("before")) & (t["within"] < F.col("before") + F.col("held")))
        # The first cell stays even if no rank lies in it, so that a group has its row.
        held = held.withColumn("mine", mine).where("before = 0 OR size(mine) > 0")
        moved = F.transform("mine", lambda t: F.struct(t["name"].alias("name"), (t["within"] - F.col("before")).alias("within")))
        # At most two cells for each rank and round, so a group's fit one row.
        cells = held.groupBy(*keys).agg(F.collect_list(F.struct("_from", "_to", moved.alias("wanted"))).alias("_cells"))
        around = F.filter("_cells", lambda c: (c["_from"] <= F.col(value)) & (F.col(value) <= c["_to"]))
        rows = counts.join(cells, keys).withColumn("_here", F.get(around, F.lit(0))).where("_here IS NOT NULL")
        rows = rows.select(*keys, value, "copies", F.col("_here._from").alias("_part"), F.col("_here.wanted").alias("wanted"))
        part = [*keys, "_part"]
    upto = F.sum("copies").over(Window.partitionBy(*part).orderBy(value).rowsBetween(START, 0))
    hits = rows.withColumn("upto", upto)
    here = lambda t: (t["within"] < F.col("upto")) & (t["within"] >= F.col("upto") - F.col("copies"))
    named = lambda name: lambda t: t["name"] == name
    found = [F.max(F.when(F.exists(F.filter("wanted", here), named(name)), F.col(value))).alias(name) for name in ranks]
    return hits.groupBy(*keys).agg(*found)


def pick_rank(df: DataFrame, keys: Sequence[str], value: str, rank: Column, name: str) -> DataFrame:
    """The value at one rank; see ``pick_ranks``."""
    return pick_ranks(df, keys, value, {name: rank})


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of the two middle values (of the one middle value for odd sizes)."""
    both = pick_ranks(df, keys, value, {"low_mid": F.floor((F.col("rows") - 1) / 2), "high_mid": F.floor(F.col("rows") / 2)})
    return both.select(*keys, ((F.col("low_mid") + F.col("high_mid")) / 2).alias(name))
