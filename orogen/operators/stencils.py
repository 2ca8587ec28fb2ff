"""Predictors as column expressions over neighbour windows, and their inverses where running sums give them.

A frame holds pixels (keys..., y, x, value). ``keys`` name the rectangle outside of which
a neighbour does not exist: the superblock for left, gradient and MED, the block for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.pixel import div

NEAR = ("W", "N", "NW", "NE", "WW", "NN", "NNE")


def neighbours(df: DataFrame, keys: list[str], v: str, names: tuple[str, ...] = NEAR, prefix: str = "") -> DataFrame:
    """Adds the neighbours of ``v``; null outside the rectangle. One window down columns, one along rows."""
    down, along = Window.partitionBy(*keys, "x").orderBy("y"), Window.partitionBy(*keys, "y").orderBy("x")
    p = prefix
    if {"N", "NW", "NE", "NN", "NNE"} & set(names):
        df = df.withColumn(f"{p}N", F.lag(v).over(down))
    if {"NN", "NNE"} & set(names):
        df = df.withColumn(f"{p}NN", F.lag(v, 2).over(down))
    along_row = {"W": F.lag(v).over(along), "WW": F.lag(v, 2).over(along), "NW": F.lag(f"{p}N").over(along), "NE": F.lead(f"{p}N").over(along), "NNE": F.lead(f"{p}NN").over(along)}
    return df.withColumns({f"{p}{k}": e for k, e in along_row.items() if k in names})


def left(p: str = "") -> Column:
    return F.coalesce(F.col(f"{p}W"), F.lit(0))


def _outside_zero(p: str) -> tuple[Column, Column, Column]:
    w, n, nw = (F.coalesce(F.col(f"{p}{k}"), F.lit(0)) for k in ("W", "N", "NW"))
    return w, n, nw


def gradient(p: str = "") -> Column:
    w, n, nw = _outside_zero(p)
    return w + n - nw


def med(p: str = "") -> Column:
    w, n, nw = _outside_zero(p)
    hi, lo = F.greatest(w, n), F.least(w, n)
    return F.when(nw >= hi, lo).when(nw <= lo, hi).otherwise(w + n - nw)


def _edges(inner: Column, p: str) -> Column:
    """First row from the left, first column from above, the corner from nothing."""
    w, n = F.col(f"{p}W"), F.col(f"{p}N")
    return F.when(n.isNull(), F.coalesce(w, F.lit(0))).when(w.isNull(), n).otherwise(inner)


def gap(p: str = "") -> Column:
    """Gradient-adjusted: the steeper a change across, the more the prediction follows the other way."""
    w, n, nw = (F.col(f"{p}{k}") for k in ("W", "N", "NW"))
    ne, ww, nn = F.coalesce(F.col(f"{p}NE"), n), F.coalesce(F.col(f"{p}WW"), w), F.coalesce(F.col(f"{p}NN"), n)
    nne = F.coalesce(F.col(f"{p}NNE"), ne)
    slope = F.abs(w - nw) + F.abs(n - nn) + F.abs(ne - nne) - F.abs(w - ww) - F.abs(n - nw) - F.abs(n - ne)
    base = div(w + n, 2) + div(ne - nw, 4)
    steps = F.when(slope > 80, w).when(slope < -80, n).when(slope > 32, div(base + w, 2)).when(slope > 8, div(base * 3 + w, 4))
    return _edges(steps.when(slope < -32, div(base + n, 2)).when(slope < -8, div(base * 3 + n, 4)).otherwise(base), p)


def average(p: str = "") -> Column:
    return _edges(div(F.col(f"{p}W"), 2) + div(F.col(f"{p}N"), 2), p)


def median(p: str = "") -> Column:
    w, n, nw = (F.col(f"{p}{k}") for k in ("W", "N", "NW"))
    return _edges(F.greatest(F.least(w, n), F.least(F.greatest(w, n), nw)), p)


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def least_squares_weights(df: DataFrame, keys: list[str], v: str, p: str = "") -> DataFrame:
    """(keys..., k1, k2, k3): each block's weights of W, N and NW in 256ths; 1, 1, -1 where singular.

    Moments are sums that combine map-side, one row a block after the shuffle."""
    near = [F.col(f"{p}{k}").cast("double") for k in ("W", "N", "NW")]
    there = F.col(f"{p}W").isNotNull() & F.col(f"{p}N").isNotNull()
    x = F.col(v).cast("double")
    sums = [F.coalesce(F.sum(F.when(there, near[i] * near[j])), F.lit(0.0)).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.coalesce(F.sum(F.when(there, near[i] * x)), F.lit(0.0)).alias(f"b{i}") for i in range(3)]
    m = df.groupBy(*keys).agg(*sums)
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    b = [F.col(f"b{i}") for i in range(3)]
    m = m.withColumn("det", _det(a))
    out = []
    for k, fallback in enumerate((256, 256, -256)):
        swapped = [[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
        out.append(F.when(F.abs("det") > 1e-5, F.round(_det(swapped) / F.col("det") * 256.0)).otherwise(float(fallback)).cast("long").alias(f"k{k + 1}"))
    return m.select(*keys, *out)


def least_squares(p: str = "") -> Column:
    """Needs k1, k2 and k3 beside the neighbours."""
    inner = div(F.col("k1") * F.col(f"{p}W") + F.col("k2") * F.col(f"{p}N") + F.col("k3") * F.col(f"{p}NW"), 256)
    return _edges(inner, p)


def undo_left(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """Values from left residuals: a running sum along each row."""
    return df.withColumn("value", F.sum(r).over(Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))


def undo_gradient(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """Values from gradient residuals: a running sum along rows, then down columns."""
    rows = undo_left(df, keys, r).withColumnRenamed("value", "__row")
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.sum("__row").over(down)).drop("__row")


def cdf53_rows(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """One level of the reversible 5/3 transform along rows: (keys..., y, pos, coef), low half first."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    size = Window.partitionBy(*keys, "y")
    df = df.withColumns({"at": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(size), "prior": F.lag(v).over(w), "after": F.lead(v).over(w)})
    odd = F.col("at") % 2 == 1
    df = df.withColumn("d", F.when(odd, F.col(v) - F.shiftright(F.col("prior") + F.coalesce("after", "prior"), 1)))
    before, behind = F.lag("d").over(w), F.lead("d").over(w)
    low = F.when(F.col("n") == 1, F.col(v)).otherwise(F.col(v) + F.shiftright(F.coalesce(before, behind) + F.coalesce(behind, before) + 2, 2))
    half = F.expr("(n + 1) div 2")
    return df.select(*keys, "y", F.when(odd, half + F.expr("at div 2")).otherwise(F.expr("at div 2")).alias("pos"), F.when(odd, F.col("d")).otherwise(low).alias("coef"))
