"""Connected components by alternating stars, on written edge tables.

Each half round replaces the edge table by one of the same order of size: the
larger neighbours of a vertex move to its smallest neighbour ("large star"),
then its smaller ones do ("small star"), until a round changes no edge.  That
is seen from a count and a checksum that the write itself takes, so a round is
two writes and no further job.  Nothing is collected; a hub's edges are rows of
a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedloom.llm.common import forget, written


def _smallest(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _counted(e: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The edges written, their path, and their number and checksum."""
    seen = Observation()
    out, path = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"),
                                  F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")))
    got = seen.get
    return out, path, (got["n"], got["h"], got["s"])


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component) of every vertex with an edge to another one; component is the smallest id.

    Nulls and self loops are left out; repeated edges count once; an empty
    table gives an empty table.
    """
    spark = edges.sparkSession
    e = (edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
         .where(f"u <> v AND {src} IS NOT NULL AND {dst} IS NOT NULL").distinct())
    e, path, state = _counted(e)
    before = None
    while state[0] and state != before:
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large, p1 = written(both.where("v > u").join(low, "u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = _smallest(large)
        small, p2, state = _counted(
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(spark, p1)
        forget(spark, path)
        e, path = small, p2
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
