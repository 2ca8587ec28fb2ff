"""One query for each declarative operator over the grids of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.functions import pixel as px
from orogen.operators import codec, stats
from orogen.operators import selection as sel
from orogen.operators import stencils as st
from orogen.operators.inpaint import inpaint
from orogen.operators.symbols import contexts, entropy, mask_bytes, mask_runs, symbols
from orogen.sources import grids

P, SB, LEAST = 0.001, 32, 8
S3 = ("W", "N", "NW")


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return grids.vectors(spark, d).select("y", "x", px.quantize(F.col("z"), P).alias("q"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return sel.superblocks(_emb(spark, d), SB)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return sel.fixed_blocks(_emb(spark, d), SB, LEAST)


def _ev(spark: SparkSession, d: str, precision: float = 0.1) -> DataFrame:
    g = grids.events(spark, d)
    return g.select("y", "x", "z", px.quantize(F.col("z"), precision, grids.NODATA).alias("q"), px.is_nodata(F.col("z"), grids.NODATA).alias("nodata"))


def _ord(spark: SparkSession, d: str) -> DataFrame:
    return grids.orders(spark, d).select("y", "x", "z", px.quantize(F.col("z"), 0.01).alias("q"))


def quantize(spark, d):
    return _ord(spark, d).select("y", "x", "q")


def dequantize_error(spark, d):
    e = F.abs(px.dequantize(F.col("q"), 0.01) - F.col("z"))
    return _ord(spark, d).agg(F.round(F.max(e), 6).alias("worst"), F.sum(F.when(e > 0.005 + 1e-9, 1).otherwise(0)).alias("over"), F.count(F.lit(1)).alias("n"))


def nodata_mask(spark, d):
    return _ev(spark, d).select("y", "x", "q", "nodata")


def dequantize_masked(spark, d):
    return _ev(spark, d).select("y", "x", F.round(px.dequantize(F.col("q"), 0.1, F.col("nodata"), grids.NODATA), 6).alias("z"))


def inpaint_rings(spark, d):
    return inpaint(_ev(spark, d).select("y", "x", "q", "nodata")).select("y", "x", "q", "nodata", F.col("ring").cast("long").alias("ring"))


def raw_stats(spark, d):
    return stats.raw_stats(_ev(spark, d), "nodata")


def percentiles_nearest_rank(spark, d):
    g = _ev(spark, d)
    return stats.percentiles(g, "nodata", g.count())


def percentiles_of_stride(spark, d):
    """As above, of a sample that the table does not fit in."""
    g = _ev(spark, d)
    return stats.percentiles(g, "nodata", g.count(), 300)


def elevation_histogram50(spark, d):
    return stats.histogram(_ev(spark, d), "nodata")


def quantized_stats(spark, d):
    return stats.quantized_stats(_ev(spark, d))


def spatial_correlation(spark, d):
    return stats.spatial_correlation(_emb(spark, d))


def digit_plane_entropy(spark, d):
    return stats.digit_planes(_ev(spark, d, 0.01), 3)


def split_precision_planes(spark, d):
    q = F.col("q")
    return _ord(spark, d).select("y", "x", px.meters(q, 100).alias("m"), px.digits(q, 100).alias("p"), (px.meters(q, 100) * 100 + px.digits(q, 100)).alias("back"))


def zigzag_class_hist(spark, d):
    z = px.zigzag(F.col("q"))
    return _emb(spark, d).select(px.magnitude(z).alias("mag"), px.remainder(z).alias("rem"), (px.unzigzag(z) == F.col("q")).alias("ok")).groupBy("mag").agg(F.count(F.lit(1)).alias("n"), F.sum("rem").alias("rem_sum"), F.sum(F.col("ok").cast("long")).alias("round_trips"))


def _residual(df: DataFrame, keys: list[str], guess, names=S3) -> DataFrame:
    return st.neighbours(df, keys, "q", names).select("y", "x", (F.col("q") - guess).alias("r"))


def left_residual(spark, d):
    return _residual(_tiles(spark, d), ["sb"], st.left(), ("W",))


def gradient_residual(spark, d):
    return _residual(_tiles(spark, d), ["sb"], st.gradient())


def jpegls_residual(spark, d):
    return _residual(_tiles(spark, d), ["sb"], st.med())


def gap_residual(spark, d):
    return _residual(_blocks(spark, d), sel.BLOCK, st.gap(), st.NEAR)


def average_residual(spark, d):
    return _residual(_blocks(spark, d), sel.BLOCK, st.average())


def median_residual(spark, d):
    return _residual(_blocks(spark, d), sel.BLOCK, st.median())


def ls_weights(spark, d):
    return st.least_squares_weights(st.neighbours(_blocks(spark, d), sel.BLOCK, "q", S3), sel.BLOCK, "q").drop("level")


def ls_residual(spark, d):
    df = st.neighbours(_blocks(spark, d), sel.BLOCK, "q", S3)
    return df.join(st.least_squares_weights(df, sel.BLOCK, "q"), sel.BLOCK).select("y", "x", (F.col("q") - st.least_squares()).alias("r"))


def predictor_ranking(spark, d):
    """Bits a sample of each predictor over whole superblocks, by residual entropy, with mean absolute residuals."""
    df = _tiles(spark, d).withColumns({"level": F.lit(0), "node": F.lit(0).cast("long")})
    res = sel.residuals(df, prune=False).select("pid", "r")
    e = entropy(res, ["pid"], "r")
    a = res.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("r")), 6).alias("mean_abs"))
    return e.join(a, "pid").select("pid", "n", F.round("entropy", 6).alias("entropy"), "mean_abs")


def zero_run_symbols(spark, d):
    q = px.div(F.col("q"), 100)
    df = _tiles(spark, d).withColumn("v", q)
    s = symbols(contexts(df, ["sb"], "v", False), ["sb"], "v")
    return s.select("sb", F.col("at").cast("long").alias("at"), F.col("mag").cast("long").alias("mag"), "run", "rem")


def extended_context_hist(spark, d):
    r = _residual(_tiles(spark, d), ["sb"], st.gradient())
    df = contexts(sel.superblocks(r, SB), ["sb"], "r", True)
    return df.groupBy(F.col("ctx").cast("long").alias("ctx")).agg(F.count(F.lit(1)).alias("n"))


def block_cost_estimate(spark, d):
    r = sel.fixed_blocks(_residual(_tiles(spark, d), ["sb"], st.gradient()), SB, LEAST)
    return sel.costs(r, sel.BLOCK).select("sb", "node", F.round("bits", 4).alias("bits"))


def best_predictor_per_block(spark, d):
    return sel.choose(_blocks(spark, d)).select("sb", "node", F.col("pid").cast("long").alias("pid"), px.rounded(F.col("bits"), 4).alias("bits"))


def second_pass_choice(spark, d):
    return sel.choose(_blocks(spark, d), pool=True).select("sb", "node", F.col("pid").cast("long").alias("pid"), F.col("second").cast("long").alias("second"), px.rounded(F.col("bits"), 4).alias("bits"))


def predictor_usage(spark, d):
    n = sel.choose(_blocks(spark, d)).groupBy(F.col("pid").cast("long").alias("pid")).agg(F.count(F.lit(1)).alias("blocks"))
    return n.withColumn("share", F.round(F.col("blocks") / F.sum("blocks").over(Window.partitionBy()), 6))


def fixed_grid_blocks(spark, d):
    return _blocks(spark, d).groupBy("sb", "node").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def _leaves(spark, d):
    return sel.quadtree(_emb(spark, d), SB, LEAST)


def quadtree_leaves(spark, d):
    return _leaves(spark, d).select("sb", F.col("level").cast("long").alias("level"), "node", F.col("pid").cast("long").alias("pid"), F.col("second").cast("long").alias("second"), F.round("bits", 4).alias("bits"))


def quadtree_leaf_counts(spark, d):
    return _leaves(spark, d).groupBy(F.col("w").cast("long").alias("w")).agg(F.count(F.lit(1)).alias("leaves"), F.sum("cells").alias("cells"))


def index_offsets(spark, d):
    """Where each leaf's payload starts: a running sum within superblocks, then over their totals."""
    df = _leaves(spark, d).select("sb", F.expr("node * (1 << (2 * (2 - level)))").alias("place"), F.ceil(F.round(F.col("bits") / 8, 4)).alias("bytes"))
    inner = Window.partitionBy("sb").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum("bytes").over(inner), F.lit(0)))
    t = df.groupBy("sb").agg(F.sum("bytes").alias("t"))
    t = t.select("sb", (F.sum("t").over(Window.orderBy("sb")) - F.col("t")).alias("start"))  # one row a superblock
    return df.join(t, "sb").select("sb", "place", (F.col("start") + F.col("within")).alias("offset"), "bytes")


def entropy_budget(spark, d):
    t = _leaves(spark, d).agg(F.count(F.lit(1)).alias("leaves"), F.sum("cells").alias("cells"), F.sum("bits").alias("bits"), F.var_pop("bits").alias("v"))
    size = F.col("bits") / 8 + F.col("leaves") * 36 + 256
    return t.select("leaves", "cells", F.round(F.col("bits") / F.col("cells"), 4).alias("bpp"), F.round(size, 2).alias("file_bytes"), F.round(F.col("cells") * 4 / size, 4).alias("ratio"), F.round(F.sqrt(F.col("leaves") * F.col("v")) / 8, 3).alias("bytes_stddev"))


def mask_rle(spark, d):
    df = sel.superblocks(_ev(spark, d), SB)
    return mask_runs(df, ["sb"], "nodata").select("sb", F.col("seq").cast("long").alias("seq"), "masked", "run")


def roi_crop(spark, d):
    x, y, w, h = 17, 5, 40, 3
    return _ord(spark, d).where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).select((F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "q")


def roi_superblocks(spark, d):
    x, y, w, h = 20, 40, 30, 90
    t = _tiles(spark, d).groupBy("sb").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return t.where((F.col("x1") >= x) & (F.col("x0") < x + w) & (F.col("y1") >= y) & (F.col("y0") < y + h)).select("sb", "x0", "y0")


def verify_diff(spark, d):
    """A grid against a copy with a few cells changed: cells that are masked on both sides are equal whatever they hold."""
    a = _ev(spark, d).select("y", "x", "q", "nodata")
    b = a.select("y", "x", F.when((F.col("y") * 100 + F.col("x")) % 97 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("p"), F.col("nodata").alias("hole"))
    j = a.join(b, ["y", "x"], "full_outer")
    same = F.coalesce((F.col("nodata") == F.col("hole")) & (F.col("nodata") | (F.col("q") == F.col("p"))), F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("checked"), F.sum((~same).cast("long")).alias("mismatched"))


def left_decode(spark, d):
    r = sel.superblocks(left_residual(spark, d), SB)
    return st.undo_left(r, ["sb"], "r").select("y", "x", F.col("value").alias("q"))


def gradient_decode(spark, d):
    r = sel.superblocks(gradient_residual(spark, d), SB)
    return st.undo_gradient(r, ["sb"], "r").select("y", "x", F.col("value").alias("q"))


def cdf53_row_level1(spark, d):
    return st.cdf53_rows(_tiles(spark, d), ["sb"], "q").select("sb", "y", F.col("pos").cast("long").alias("pos"), "coef")


def cdf53_level1(spark, d):
    """One level along rows, then along columns."""
    rows = st.cdf53_rows(_tiles(spark, d), ["sb"], "q").select("sb", F.col("pos").cast("long").alias("y"), F.col("y").alias("x"), F.col("coef").alias("q"))
    return st.cdf53_rows(rows, ["sb"], "q").select("sb", F.col("pos").cast("long").alias("y"), F.col("y").alias("x"), "coef")


def mask_rle_bytes(spark, d):
    """The runs of each superblock's mask as bytes in hex: unmasked first, a run of 255 or more goes on after a run of none."""
    return mask_bytes(sel.superblocks(_ev(spark, d), SB), ["sb"], "nodata")


def coarse_precision_sweep(spark, d):
    """Bits of the best fixed blocks at the given precision and at one and two decimal digits fewer."""
    out = None
    for k in range(3):
        df = _blocks(spark, d).withColumn("q", px.div(F.col("q"), 10**k))
        t = sel.choose(df).agg(F.sum("bits").alias("b"), F.count(F.lit(1)).alias("blocks")).select(F.lit(k).cast("long").alias("digits_dropped"), "blocks", F.round(F.col("b") / 8 + F.col("blocks") * 36 + 256, 2).alias("bytes"))
        out = t if out is None else out.unionByName(t)
    return out


def codec_round_trip(spark, d):
    """Events coded with digit planes and masks, and decoded again."""
    return codec.decode(codec.encode(_ev(spark, d), 0.1, True, size=64, least=16), 0.1, True)


def region_decode(spark, d):
    """A region decoded from the tiles that it meets."""
    x, y, w, h = 20, 40, 30, 90
    blocks = codec.encode(_emb(spark, d).withColumn("nodata", F.lit(False)), size=SB, least=LEAST)
    got = codec.decode(codec.region(blocks, x, y, w, h, SB))
    return got.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).select((F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "q")


QUERIES = {
    f.__name__: f
    for f in (
        quantize, dequantize_error, nodata_mask, dequantize_masked, inpaint_rings, raw_stats, percentiles_nearest_rank, percentiles_of_stride, elevation_histogram50, quantized_stats, spatial_correlation, digit_plane_entropy,
        split_precision_planes, zigzag_class_hist, left_residual, gradient_residual, jpegls_residual, gap_residual, average_residual, median_residual, ls_weights, ls_residual, predictor_ranking, zero_run_symbols,
        extended_context_hist, block_cost_estimate, best_predictor_per_block, second_pass_choice, predictor_usage, fixed_grid_blocks, quadtree_leaves, quadtree_leaf_counts, index_offsets, entropy_budget, mask_rle, mask_rle_bytes,
        roi_crop, roi_superblocks, verify_diff, left_decode, gradient_decode, cdf53_row_level1, cdf53_level1, coarse_precision_sweep, codec_round_trip, region_decode,
    )
}
