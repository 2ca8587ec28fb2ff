"""Filling of no-data cells in rings that grow from the valid ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.plans.staging import discard, stage


def inpaint(grid: DataFrame) -> DataFrame:
    """``grid`` (y, x, q, nodata) with ``q`` of masked cells filled and ``ring``; the mask stays.

    A cell is filled from its four neighbours of the ring before, by their mean cut to a whole number. A neighbour
    of an earlier ring would have filled it earlier, so each round joins the holes left with the last
    ring alone. Nothing is filled if no cell is valid."""
    frontier = grid.where(~F.col("nodata")).select("y", "x", "q")
    holes = stage(grid.where("nodata").select("y", "x"), "holes")
    valid = grid.where(~F.col("nodata")).select("y", "x", "q", F.lit(0).alias("ring"))
    filled, ring = valid, 0
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0))])
    while holes.take(1):
        near = holes.select("y", "x", F.inline(steps)).select("y", "x", (F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx"))
        edge = frontier.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("q").alias("v"))
        new = stage(near.join(edge, ["ny", "nx"]).groupBy("y", "x").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).select("y", "x", F.expr("s div n").alias("q")), "ring")
        if not new.take(1):
            break
        ring += 1
        filled = filled.unionByName(new.withColumn("ring", F.lit(ring)))
        left = stage(holes.join(new, ["y", "x"], "left_anti"), "holes")
        discard(holes)
        holes = left
        frontier = new
    out = grid.withColumnRenamed("q", "was").join(filled, ["y", "x"], "left")
    return out.select("y", "x", F.coalesce("q", "was").alias("q"), "nodata", F.coalesce("ring", F.lit(-1)).alias("ring"))
