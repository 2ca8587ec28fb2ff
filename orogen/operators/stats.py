"""Statistics of raw and quantized grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.pixel import div
from orogen.operators.symbols import entropy

SAMPLE = 262_144
RANKS = (0.01, 0.25, 0.5, 0.75, 0.99)
BUCKETS = 50


def raw_stats(df: DataFrame, masked: str, digits: int = 6) -> DataFrame:
    """One row: valid, min, max, mean, stddev of the values that aren't masked; zeros if there are none."""
    ok = df.where(~F.col(masked))
    zero = F.lit(0.0)
    return ok.agg(
        F.count(F.lit(1)).alias("valid"),
        F.coalesce(F.min("z"), zero).alias("min"),
        F.coalesce(F.max("z"), zero).alias("max"),
        F.round(F.coalesce(F.avg("z"), zero), digits).alias("mean"),
        F.round(F.coalesce(F.stddev_pop("z"), zero), digits).alias("stddev"),
    )


def percentiles(df: DataFrame, masked: str, cells: int, most: int = SAMPLE) -> DataFrame:
    """(fraction, value): nearest rank of a stride sample of the valid cells in raster order, of ``most`` cells.

    The ordinal of a cell comes from row counts, so that no task sees more than a row of
    the raster or the sample, which has a bound."""
    stride = max(1, cells // most)
    ok = df.where(~F.col(masked))
    rows = ok.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    start = rows.select("y", (F.sum("n").over(Window.orderBy("y")) - F.col("n")).alias("start"))
    ok = ok.join(start, "y").withColumn("ordinal", F.col("start") + F.row_number().over(Window.partitionBy("y").orderBy("x")) - 1)
    sample = ok.where(F.col("ordinal") % stride == 0).where(F.col("ordinal") < F.lit(stride) * most)
    s = sample.agg(F.sort_array(F.collect_list("z")).alias("s"))
    at = lambda f: F.floor(F.lit(f) * (F.size("s") - 1) + 0.5).cast("int")
    return s.where(F.size("s") > 0).select(F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.get("s", at(f)).alias("value")) for f in RANKS])).alias("r")).select("r.*")


def histogram(df: DataFrame, masked: str) -> DataFrame:
    """(bucket, count, height): 50 equal buckets from least to greatest, heights over the fullest."""
    ok = df.where(~F.col(masked)).select("z")
    ends = ok.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1).cast("long"), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(F.lit(0).cast("long"))
    n = ok.crossJoin(F.broadcast(ends)).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))  # one row of two numbers
    return n.select("bucket", "count", F.round(F.col("count") / F.max("count").over(Window.partitionBy()), 6).alias("height"))


def quantized_stats(df: DataFrame) -> DataFrame:
    ok = ~F.col("nodata")
    q = F.when(ok, F.col("q"))
    zero = F.lit(0.0)
    return df.agg(F.count(q).alias("valid"), F.sum(F.col("nodata").cast("long")).alias("masked"), F.min(q).alias("min"), F.max(q).alias("max"), F.round(F.coalesce(F.avg(q), zero), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(q), zero), 6).alias("stddev"))


def spatial_correlation(df: DataFrame) -> DataFrame:
    """(h, v, d): covariance of neighbours about the global mean over the global variance scaled to their number.

    Sums of products of whole numbers give it in one pass, with one window along rows and one down columns."""
    along, down = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    df = df.withColumn("e", F.lead("q").over(along)).withColumn("s", F.lead("q").over(down)).withColumn("se", F.lead("e").over(down))
    num = "decimal(38,0)"
    q = F.col("q").cast(num)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(q).alias("s1"), F.sum((F.col("q") * F.col("q")).cast(num)).alias("s2"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")]
    for k in ("e", "s", "se"):
        there = F.col(k).isNotNull()
        sums += [F.sum(F.when(there, (F.col("q") * F.col(k)).cast(num))).alias(f"p_{k}"), F.sum(F.when(there, (F.col("q") + F.col(k)).cast(num))).alias(f"t_{k}")]
    a = df.agg(*sums)
    mean = F.col("s1").cast("double") / F.col("n")
    var = F.col("s2").cast("double") - F.col("n") * mean * mean
    w, h = F.col("w").cast("double"), F.col("h").cast("double")

    def corr(k: str, pairs) -> F.Column:
        cov = F.col(f"p_{k}").cast("double") - mean * F.col(f"t_{k}").cast("double") + pairs * mean * mean
        return F.when((F.col("w") < 2) | (F.col("h") < 2), 0.0).when(var <= 0, 1.0).otherwise(F.round(cov / (var * pairs / (w * h)), 6))

    return a.select(corr("e", (w - 1) * h).alias("h"), corr("s", w * (h - 1)).alias("v"), corr("se", (w - 1) * (h - 1)).alias("d"))


def digit_planes(df: DataFrame, planes: int) -> DataFrame:
    """(place, entropy) of each decimal digit of the absolute quantized values that aren't masked."""
    digit = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), (div(F.abs("q"), 10**i) % 10).alias("digit")) for i in range(planes)]))
    d = df.where(~F.col("nodata")).select(digit.alias("d")).select("d.*")
    return entropy(d, ["place"], "digit").select("place", F.round("entropy", 6).alias("entropy"))
