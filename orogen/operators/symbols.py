"""Residual streams as symbols, and their cost in bits, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.pixel import activity, magnitude, remainder, zigzag

RUN = 255


def entropy(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """(keys..., entropy) in bits a value."""
    n = df.groupBy(*keys, v).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    return total.select(*keys, (F.log2("t") - F.col("nl") / F.col("t")).alias("entropy"))


def contexts(df: DataFrame, keys: list[str], v: str, extended: bool, plane: int = 0) -> DataFrame:
    """Adds ``ctx``: plane * 4, plus the larger activity of the left and upper neighbour if extended."""
    if not extended:
        return df.withColumn("ctx", F.lit(plane * 4))
    w = F.lag(v).over(Window.partitionBy(*keys, "y").orderBy("x"))
    n = F.lag(v).over(Window.partitionBy(*keys, "x").orderBy("y"))
    df = df.withColumns({"__w": w, "__n": n})
    zero = F.lit(0).cast("long")
    return df.withColumn("ctx", F.greatest(activity(F.coalesce("__w", zero)), activity(F.coalesce("__n", zero))) + plane * 4).drop("__w", "__n")


def symbols(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """(keys..., at, ctx, mag, run, rem) in raster order of (y, x): zeros in runs of up to 255, each with the context of its first.

    ``df`` has ``ctx``. ``at`` is the place of a symbol's first value."""
    order = Window.partitionBy(*keys).orderBy("y", "x")
    df = df.withColumn("at", F.row_number().over(order)).withColumn("zero", F.col(v) == 0)
    df = df.withColumn("island", F.sum(F.when(F.col("zero"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min(F.when(F.col("zero"), F.col("at"))).over(Window.partitionBy(*keys, "island"))
    df = df.withColumn("chunk", F.when(F.col("zero"), F.floor((F.col("at") - head) / RUN)).otherwise(-1))
    z = zigzag(F.col(v))
    df = df.withColumns({"mag": magnitude(z), "rem": remainder(z)})
    runs = df.where("zero").groupBy(*keys, "island", "chunk").agg(F.min("at").alias("at"), F.min_by("ctx", "at").alias("ctx"), F.count(F.lit(1)).cast("long").alias("run"))
    cols = [*keys, "at", "ctx", "mag", "run", "rem"]
    zeros = runs.withColumns({"mag": F.lit(0), "rem": F.lit(0).cast("long")}).select(*cols)
    return df.where("not zero").withColumn("run", F.lit(0).cast("long")).select(*cols).unionByName(zeros)


def estimated_bits(sym: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., bits): class entropy by context, run-length entropy, and remainder bits, in total bits."""
    n = sym.groupBy(*keys, "ctx", "mag").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_ctx = n.groupBy(*keys, "ctx").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"), F.sum(F.col("n") * F.greatest(F.col("mag") - 1, F.lit(0))).alias("rest"))
    classes = by_ctx.groupBy(*keys).agg(F.sum(F.col("t") * F.log2("t") - F.col("nl") + F.col("rest")).alias("bits"))
    r = sym.where("run > 0").groupBy(*keys, "run").agg(F.count(F.lit(1)).cast("double").alias("n"))
    runs = r.groupBy(*keys).agg((F.sum("n") * F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n"))).alias("runs"))
    return classes.join(runs, keys, "left").select(*keys, F.round(F.col("bits") + F.coalesce("runs", F.lit(0.0)), 6).alias("bits"))


def mask_runs(df: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """(keys..., seq, masked, run): alternating runs of a no-data mask in raster order, as runs and not yet as bytes."""
    order = Window.partitionBy(*keys).orderBy("y", "x")
    df = df.withColumn("flip", F.when(F.col(mask) != F.coalesce(F.lag(mask).over(order), F.lit(False)), 1).otherwise(0))
    df = df.withColumn("seq", F.sum("flip").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "seq").agg(F.first(mask).alias("masked"), F.count(F.lit(1)).cast("long").alias("run"))


def mask_bytes(df: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """(keys..., bytes): the runs as a string of hex bytes. The first run is of cells that aren't masked, maybe of none; each
    255 that a run holds is written as 255 and 0, and then the rest."""
    runs = mask_runs(df, keys, mask)
    one = F.concat(F.repeat(F.lit("FF00"), F.expr("cast(run div 255 as int)")), F.lpad(F.hex(F.col("run") % 255), 2, "0"))
    parts = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("b"), "masked"))).alias("parts"))  # a superblock has a bound on its cells
    first = F.when(F.col("parts")[0]["masked"], F.lit("00")).otherwise(F.lit(""))
    return parts.select(*keys, F.concat(first, F.array_join(F.transform("parts", lambda p: p["b"]), "")).alias("bytes"))
