"""Connected components by alternating large-star and small-star rounds over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage, unstage

_SALTS = 4


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hang each node's neighbours on its smallest neighbour or itself.

    Large star takes larger neighbours, small star the smaller ones and the
    node. Minima are combined before the shuffle; edges of a hot node are dealt
    by a salt of their other end, for the join with the minimum.
    """
    if both:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        near = near.where("b > a")
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    out = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int")).join(every, ["a", "salt"])
    out = out.select(F.col("b").alias("x"), F.col("m").alias("y"))
    if not both:
        out = out.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reached) for every node of `edges(a, b)`.

    Self-loops and rows with a null end are ignored, repeated edges count once,
    an empty table gives no rows. Each round is written to the shared folder;
    nothing but two sums comes back to the driver. Rounds end when an edge
    table repeats, which it does after about the square of the logarithm of the
    longest path.
    """
    now = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    mark, sums = None, () if now.take(1) else None
    while sums != mark:
        mark = sums
        nxt = stage(_star(_star(now, True), False), "edges")
        unstage(now)
        now = nxt
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
