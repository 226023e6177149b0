"""Append-only ledger of analysed content, linked by hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.plans.relay import Emits, run_rule
from seriesloom.plans.series import Series, index_series

GENESIS = "0" * 64
LINKS = Emits(
    T.StructType(
        [
            T.StructField("index", T.LongType()),
            T.StructField("content_hash", T.StringType()),
            T.StructField("prev_hash", T.StringType()),
            T.StructField("block_hash", T.StringType()),
        ]
    )
)


def only_new(batch: DataFrame, ledger: DataFrame, order: str, on: str = "content_hash") -> DataFrame:
    """First row of every content not yet in the ledger.

    The copies of one content are reduced map-side, so a hash of any multiplicity costs one row.
    """
    rest = [c for c in batch.columns if c not in (on, order)]
    first = batch.groupBy(on).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("first"))
    return first.select(on, "first.*").join(ledger.select(on), on, "left_anti")


def link_rows(numbered: Series, last_hash: str) -> DataFrame:
    """Hash links of new rows (``index``, ``content_hash``) after a block with ``last_hash``.

    A hash chain is serial by nature; in the blocked layout each block of rows starts from the hash
    the block before ended with.
    """

    def link(pdf: pd.DataFrame, state: list | None):
        prev = state[0] if state else last_hash
        rows = []
        for index, content in zip(pdf["index"], pdf["content_hash"]):
            block = hashlib.sha256(f"{prev}{content}{index}".encode()).hexdigest()
            rows.append((int(index), content, prev, block))
            prev = block
        return pd.DataFrame(rows, columns=LINKS.names), [prev]

    return run_rule(numbered, link, LINKS, serial=True)


def append_once(ledger: DataFrame, batch: DataFrame, order: str, chain: str = "chain") -> DataFrame:
    """New blocks for the contents of ``batch`` that the ledger does not hold, ready to append.

    Running it again after the append yields nothing.
    """
    tip = ledger.agg(F.max("index").alias("at"), F.max_by("block_hash", "index").alias("hash")).first()
    start, last_hash = (0, GENESIS) if tip["at"] is None else (tip["at"] + 1, tip["hash"])
    fresh = only_new(batch, ledger, order).withColumn(chain, F.lit(0))
    numbered = index_series(fresh, [chain], [order])
    numbered = numbered.with_columns(index=F.col("n") + start)
    links = link_rows(numbered, last_hash).drop(chain)
    return links.join(numbered.df.drop(chain, "n", "blk", "index"), "content_hash")


def verify(ledger: DataFrame) -> DataFrame:
    """One row: whether every link holds and the first bad index (NULL when all hold).

    Each block is checked against its predecessor by an equi-join on the index: no order is needed.
    """
    previous = ledger.select((F.col("index") + 1).alias("index"), F.col("block_hash").alias("before"))
    rows = ledger.join(previous, "index", "left")
    before = F.when(F.col("index") == 0, F.lit(GENESIS)).otherwise(F.col("before"))
    expected = F.sha2(F.concat(before, F.col("content_hash"), F.col("index").cast("string")), 256)
    good = (F.col("prev_hash") == before) & (F.col("block_hash") == expected)
    bad = F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("index")))
    return rows.agg(bad.isNull().alias("ok"), bad.alias("first_bad"))


def find(ledger: DataFrame, wanted: DataFrame, on: str = "content_hash") -> DataFrame:
    """Ledger rows of the wanted contents."""
    return ledger.join(wanted.select(on), on, "left_semi")
