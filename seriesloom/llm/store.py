"""Shared-folder storage of intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it back, which also cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges``; nodes without edges don't appear.

    Alternating star contraction: every node sends its neighbours to its smallest neighbour, first the larger
    neighbours, then the smaller ones, until the forest is flat. Minima are combined before each shuffle, so a
    node with very many neighbours is no larger a group than any other; rounds grow with the logarithm of the
    longest chain. Null ends and loops are ignored.
    """
    links = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(small, "u")
        links = stored(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "links",
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
