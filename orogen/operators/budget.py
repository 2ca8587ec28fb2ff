"""What a grid would cost: one shuffle by tile, a few rows from each tile, then plain aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators import codec
from orogen.operators import kernels as kn
from orogen.operators.tiles import by_tile

LEAF, WHOLE = 0, 1
COSTS = "kind int, sb long, w int, h int, pid int, second int, cells long, bits double, classes double, runs double, remainders double, params double, saved double, wavelet double, magnitude double"
NAMES = [c.split()[0] for c in COSTS.split(", ")]


def costs(grid: DataFrame, precision: float, wavelet: bool = False, leaves_only: bool = False, size: int = codec.TILE, least: int = codec.LEAST) -> DataFrame:
    """A row for each leaf that the encoder would write, and for each predictor over each whole tile.

    ``magnitude`` is the sum of absolute residuals; ``wavelet`` the estimate of the 5/3 transform of the leaf."""
    m = codec.multiplier_of(precision)

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(df.y.min()), int(df.x.min())
        tile = np.zeros((int(df.y.max()) - y0 + 1, int(df.x.max()) - x0 + 1), np.int64)
        tile[df.y - y0, df.x - x0] = df.q
        rows = []
        for (x, y, w, h), c in kn.quadtree(tile, least, lambda r: kn.select(tile, r, m)):
            transformed = kn.estimate(kn.wavelet(tile[y : y + h, x : x + w], kn.wavelet_levels(w, h))) if wavelet else 0.0
            total = float(sum(np.abs(p).sum() for p in c.planes))
            rows.append((LEAF, key[0], w, h, c.primary, c.second, w * h, c.bits, *kn.estimate_parts(c.planes), 32.0 * len(c.params), c.saved, transformed, total))
        h, w = tile.shape
        for k in () if leaves_only else kn.BANK:
            res, params = kn.predict(k, tile, (0, 0, w, h))
            rows.append((WHOLE, key[0], w, h, k, 0, w * h, 8 + 32 * len(params) + kn.estimate(res), kn.shannon(res) * res.size, 0.0, 0.0, 0.0, 0.0, 0.0, float(np.abs(res).sum())))
        return pd.DataFrame(rows, columns=NAMES)

    sb = F.floor(F.col("y") / size) * (1 << 20) + F.floor(F.col("x") / size)
    return by_tile(grid.select(sb.alias("sb"), "y", "x", "q")).applyInPandas(one, COSTS)


def totals(found: DataFrame) -> DataFrame:
    """One row: sums over the leaves. A tree of n leaves has a flag for each of them and for each of its (n - 1) / 3 splits."""
    by_width = {f"leaves_{w}": F.count(F.when(F.col("w") == w, 1)) for w in (512, 256, 128)}
    named = F.col("w").isin(512, 256, 128)
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("bits", "classes", "runs", "remainders", "params", "saved", "wavelet")]
    n = F.count(F.lit(1))
    return found.where(F.col("kind") == LEAF).agg(
        n.alias("blocks"),
        F.count_distinct("sb").alias("tiles"),
        *sums,
        F.coalesce(F.var_pop("bits"), F.lit(0.0)).alias("variance"),
        F.count(F.when(F.col("second") != kn.NONE, 1)).alias("second_blocks"),
        *[c.alias(k) for k, c in by_width.items()],
        F.count(F.when(~named, 1)).alias("leaves_64"),
    ).withColumn("structure", F.col("blocks") + (F.col("blocks") - F.col("tiles")) / 3)


def predictor_table(found: DataFrame) -> DataFrame:
    """(pid, selection_bpp, shannon_bpp, avg_abs_residual, usage_blocks), cheapest first."""
    whole = found.where(F.col("kind") == WHOLE).groupBy("pid").agg((F.sum("bits") / F.sum("cells")).alias("selection_bpp"), (F.sum("classes") / F.sum("cells")).alias("shannon_bpp"), (F.sum("magnitude") / F.sum("cells")).alias("avg_abs_residual"))
    used = found.where(F.col("kind") == LEAF).groupBy("pid").agg(F.count(F.lit(1)).alias("usage_blocks"))
    return whole.join(used, "pid", "left").na.fill(0, ["usage_blocks"]).orderBy("selection_bpp", "pid")
