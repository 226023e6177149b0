"""Row-by-row rules whose state restarts (keyframes, monitors), run per series or per block.

Such a rule has no associative form, so a short series runs whole inside one grouped task. A long
one is cut into blocks: every block runs at once from a guessed entry state, then only the blocks
whose entry turned out different from the exit of the block before run again, until nothing
changes. The first block starts from the true state, so the fixed point is the sequential result;
rules that restart often agree after two or three rounds whatever the number of blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.plans.series import START, Series
from seriesloom.session import block_rows, checkpointed

RULE_BLOCK = 1 << 17

# A rule takes the rows of one block in order and the state left by the row before them (None at
# the start of a series); it returns the rows it emits and the state after the last one.
Rule = Callable[[pd.DataFrame, list | None], tuple[pd.DataFrame, list | None]]


@dataclass(frozen=True)
class Emits:
    """Names and types of the rows a rule emits (without the series key)."""

    schema: T.StructType

    @property
    def names(self) -> list[str]:
        return self.schema.fieldNames()


def run_rule(
    series: Series, rule: Rule, emits: Emits, close: Callable | None = None, final: list | None = None,
    serial: bool = False,
) -> DataFrame:
    """Apply ``rule`` along every series; ``close(state)`` may emit rows at the end of a series.

    ``final`` is a state the rule never leaves: it passes to all later blocks in one round. With
    ``serial`` a series goes through one task, an Arrow batch at a time, for rules that never forget
    their entry state and can be cut after any row.
    """
    if serial:
        return _in_turn(series, rule, emits, close)
    if series.block:
        return _run_blocks(series, rule, emits, close, final)
    keys = list(series.keys)
    schema = T.StructType([series.df.schema[k] for k in keys] + list(emits.schema))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        rows, state = rule(pdf, None)
        if close is not None:
            rows = pd.concat([rows, close(state)], ignore_index=True)
        for at, key in enumerate(keys):
            rows.insert(at, key, pdf[key].iloc[0])
        return rows[schema.fieldNames()]

    return series.df.groupBy(*keys).applyInPandas(whole, schema)


def _run_blocks(series, rule, emits, close, final):
    # Equal blocks by row number bound what a task holds.
    series = series.reblocked(min(block_rows(series.df.sparkSession), RULE_BLOCK))
    keys, cell = list(series.keys), series._cell
    rows = series._settle().df
    result = T.StructType(
        [series.df.schema[c] for c in cell]
        + [
            T.StructField("entry", T.StringType()),
            T.StructField("leave", T.StringType()),
            T.StructField("emitted", T.ArrayType(emits.schema)),
        ]
    )

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        entry = pdf["entry"].iloc[0]
        out, state = rule(pdf, json.loads(entry) if entry else None)
        row = {c: [pdf[c].iloc[0]] for c in cell}
        row["entry"] = [entry]
        row["leave"] = [json.dumps(state)]
        row["emitted"] = [out[emits.names].to_dict("records")]
        return pd.DataFrame(row)[result.fieldNames()]

    start = rows.withColumn("entry", F.lit(None).cast("string"))
    done = checkpointed(start.groupBy(*cell).applyInPandas(one_block, result))
    along = Window.partitionBy(*keys).orderBy(series.block)
    due_state = F.lag("leave").over(along)
    if final is not None:
        ended = F.max((F.col("leave") == json.dumps(final)).cast("int")).over(along.rowsBetween(START, -1))
        due_state = F.when(ended == 1, F.lit(json.dumps(final))).otherwise(due_state)
    while True:
        due = done.select(*cell, "entry", due_state.alias("due"))
        stale = due.filter(~F.col("due").eqNullSafe(F.col("entry")))
        stale = checkpointed(stale.select(*cell, F.col("due").alias("entry")))
        if stale.isEmpty():
            break
        again = rows.join(stale, cell).groupBy(*cell).applyInPandas(one_block, result)
        done = checkpointed(done.join(stale.select(*cell), cell, "left_anti").unionByName(again))
    return _finish(done, series, keys, emits, close)


def _in_turn(series, rule, emits, close):
    """Sorted series as a stream of batches, the state handed on; a batch is all that Python holds."""
    keys = list(series.keys)
    schema = T.StructType([series.df.schema[k] for k in keys] + list(emits.schema))
    rows = series.df.repartition(*keys).sortWithinPartitions(*keys, "n")

    def keyed(out: pd.DataFrame, key: tuple) -> pd.DataFrame:
        return out.assign(**dict(zip(keys, key)))[schema.fieldNames()]

    def each(batches):
        last = state = None
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                if repr(key) != repr(last):
                    if last is not None and close is not None:
                        yield keyed(close(state), last)
                    last, state = key, None
                out, state = rule(part.reset_index(drop=True), state)
                yield keyed(out, key)
        if last is not None and close is not None:
            yield keyed(close(state), last)

    return rows.mapInPandas(each, schema)


def _finish(done, series, keys, emits, close):
    out = done.select(*keys, F.explode("emitted").alias("row")).select(*keys, "row.*")
    if close is None:
        return out
    # Only the state after the last block matters here: one small row per series.
    last = done.groupBy(*keys).agg(F.max_by("leave", series.block).alias("leave"))
    schema = T.StructType([series.df.schema[k] for k in keys] + list(emits.schema))

    def finish(batches):
        for pdf in batches:
            parts = []
            for row in pdf.to_dict("records"):
                end = close(json.loads(row["leave"]))
                for at, key in enumerate(keys):
                    end.insert(at, key, row[key])
                parts.append(end[schema.fieldNames()])
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return out.unionByName(last.mapInPandas(finish, schema))
