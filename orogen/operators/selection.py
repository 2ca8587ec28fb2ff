"""Choice of a predictor for each block, and of blocks by a quadtree, as aggregates and kernels.

The choice for given blocks has the five predictors and six second passes that are column expressions, in :mod:`orogen.operators.blocks`. The polynomial surface
needs a linear solver, so it is chosen among in :mod:`orogen.operators.codec`, which packs superblocks. The quadtree takes the same
kernels, with a shuffle by superblock."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.functions.pixel import tile
from orogen.operators import blocks
from orogen.operators import kernels as kn
from orogen.operators import stencils as st
from orogen.operators.tiles import by_tile, deal
from orogen.operators.symbols import contexts, estimated_bits, symbols

GRADIENT, LEFT, MED, GAP, LEAST_SQUARES = 0, 1, 2, 4, 5
#: Order of the bank, which decides ties, and parameters of each.
BANK = ((GRADIENT, 0), (LEFT, 0), (MED, 0), (GAP, 0), (LEAST_SQUARES, 3))
BLOCK = ["sb", "level", "node"]


def superblocks(df: DataFrame, size: int) -> DataFrame:
    """Adds ``sb``: row-major tile number, as a pair packed in a long so that no width need be known."""
    return df.withColumn("sb", tile("y", size) * (1 << 20) + tile("x", size))


def fixed_blocks(df: DataFrame, size: int, block: int) -> DataFrame:
    """Adds sb, level 0 and ``node``: row-major block within its superblock."""
    per = -(-size // block)
    node = F.floor(F.col("y") % size / block) * per + F.floor(F.col("x") % size / block)
    return superblocks(df, size).withColumns({"level": F.lit(0), "node": node.cast("long")})


def residuals(df: DataFrame, prune: bool = True) -> DataFrame:
    """(sb, level, node, pid, params, y, x, r) of every predictor, or of every one that the range of its block allows."""
    df = st.neighbours(df, ["sb", "level"], "q", ("W", "N", "NW"), "s") if "sW" not in df.columns else df
    df = st.neighbours(df, BLOCK, "q")
    k = st.least_squares_weights(df, BLOCK, "q")
    span = df.groupBy(*BLOCK).agg((F.max("q") - F.min("q")).alias("delta"))
    df = df.join(k.join(span, BLOCK), BLOCK)
    guess = {GRADIENT: st.gradient("s"), LEFT: st.left("s"), MED: st.med("s"), GAP: st.gap(), LEAST_SQUARES: st.least_squares()}
    rows = F.array(*[F.struct(F.lit(p).alias("pid"), F.lit(rank).alias("rank"), F.lit(n).alias("params"), (F.col("q") - guess[p]).alias("r")) for rank, (p, n) in enumerate(BANK)])
    allowed = F.lit(True) if not prune else F.when(F.col("delta") == 0, F.col("pid") == LEFT).when(F.col("delta") > 200, F.col("pid") != MED).otherwise(True)
    return df.select(*BLOCK, "y", "x", "delta", F.inline(rows)).where(allowed).drop("delta")


def costs(res: DataFrame, keys: list[str], v: str = "r") -> DataFrame:
    return estimated_bits(symbols(contexts(res, keys, v, False), keys, v), keys)


def choose(df: DataFrame, pool: bool = False) -> DataFrame:
    """(sb, level, node, pid, second, bits) of the cheapest choice for each block; the first in the bank wins a tie.

    A second pass, of each residual plane of which no more than 95 % are zero, must save more than 16 bits to be taken. One shuffle
    and one sort of the cells themselves: their residuals, up to 35 a cell, are only arrays of the batch at hand."""
    rows = deal(df.select(*blocks.NAMES)).sortWithinPartitions("sb")
    return rows.mapInArrow(blocks.chooser(BANK, pool), blocks.CHOICE)


LEAVES = "sb long, level int, node long, pid int, second int, bits double, cells long, w int, h int"


def path_of(r: kn.Rect, w: int, h: int) -> tuple[int, int]:
    """Level and number of a leaf: 1 for the whole tile, and two bits more for each quarter on the way."""
    x, y, level, node = 0, 0, 0, 1
    while (x, y, w, h) != r:
        a, b = w // 2, h // 2
        right, below = r[0] >= x + a, r[1] >= y + b
        x, w = (x + a, w - a) if right else (x, a)
        y, h = (y + b, h - b) if below else (y, b)
        level, node = level + 1, node * 4 + 2 * below + right
    return level, node


def quadtree(df: DataFrame, size: int, least: int, bank: tuple[int, ...] = tuple(p for p, _ in BANK)) -> DataFrame:
    """(sb, level, node, pid, second, bits, cells, w, h) of the leaves, second passes included, as the encoder chooses them.

    One shuffle by superblock, which has a bound on its size, then each superblock on its own. A node of fewer bits than cells stays
    whole whatever its children cost; another is split if the leaves below it, a bit each for
    leaves and splits included, cost less than it does. ``bank``: the predictors to choose among; by default
    those that are column expressions."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(rows.y.min()), int(rows.x.min())
        cells = np.zeros((int(rows.y.max()) - y0 + 1, int(rows.x.max()) - x0 + 1), np.int64)
        cells[rows.y - y0, rows.x - x0] = rows.q
        h, w = cells.shape
        out = []
        for r, c in kn.quadtree(cells, least, lambda r: kn.select(cells, r, bank=bank)):
            out.append((key[0], *path_of(r, w, h), c.primary, c.second, c.bits, r[2] * r[3], r[2], r[3]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEAVES.split(", ")])

    return by_tile(superblocks(df, size).select("sb", "y", "x", "q")).applyInPandas(one, LEAVES)
