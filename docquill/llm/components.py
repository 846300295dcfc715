"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v): every node with an edge that is not its component's smallest, and that smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014)
    until the edges no longer change; each round is written to the shared
    folder. The driver sees only a count and a hash of the edges per round.
    """
    e = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = _mark(e)
    while mark[0]:
        e = saved(_small_star(_large_star(e)))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e
