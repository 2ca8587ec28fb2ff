"""Encode, decode, info and verify: rasters as pixel tables (y, x, z), containers as files."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.functions import pixel as px
from orogen.operators import codec
from orogen.operators import kernels as kn
from orogen.operators.inpaint import inpaint
from orogen.plans.staging import stage
from orogen.sources import container as ct

VERSION = "0.1.0"
PIPELINES, CONTEXTS = ("predictor", "wavelet"), ("simple", "extended")
UNITS = {"m": 1.0, "meter": 1.0, "dm": 0.1, "decimeter": 0.1, "cm": 0.01, "centimeter": 0.01, "mm": 0.001, "millimeter": 0.001}
NAMES = {kn.GRADIENT: "gradient", kn.LEFT: "left", kn.MED: "jpegls", kn.POLYNOMIAL: "polynomial", kn.GAP: "gap", kn.LEAST_SQUARES: "least_squares"}


@dataclass(frozen=True)
class Raster:
    """Pixels (y, x, z) from (0, 0) on, and what goes with them."""

    pixels: DataFrame
    nodata: float | None = None
    transform: tuple[float, ...] = ct.IDENTITY
    wkt: str = ""


@dataclass
class EncodeResult:
    width: int
    height: int
    total_blocks: int
    output_bytes: int
    predictor_counts: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0


@dataclass
class FileInfo:
    header: ct.Header
    block_count: int
    total_payload_bytes: int


@dataclass
class VerifyResult:
    passed: bool
    message: str
    blocks_checked: int = 0
    pixels_checked: int = 0
    mismatched_pixels: int = 0


def parse_precision(text: str) -> float:
    """A unit's name or a number; -1 if it is neither."""
    try:
        return UNITS.get(text) or float(text)
    except ValueError:
        return -1.0


def _checked(precision: float, pipeline: str, context: str) -> None:
    if not precision > 0:
        raise ValueError("precision must be greater than 0")
    if pipeline not in PIPELINES or context not in CONTEXTS:
        raise ValueError(f"pipeline is one of {PIPELINES}, context one of {CONTEXTS}")
    if pipeline == "wavelet" and precision < 1:
        raise ValueError("the wavelet pipeline takes a precision of 1 or more")


def quantized(raster: Raster, precision: float) -> DataFrame:
    """The grid (y, x, q, nodata): masked cells filled if the raster has a no-data value."""
    z = F.col("z")
    grid = raster.pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), px.quantize(z, precision, raster.nodata).alias("q"), px.is_nodata(z, raster.nodata).alias("nodata"))
    return grid if raster.nodata is None else inpaint(stage(grid, "grid")).select("y", "x", "q", "nodata")


def _shape(pixels: DataFrame) -> tuple[int, int]:
    got = pixels.agg(F.max("x"), F.max("y"), F.min("x"), F.min("y")).first()
    if got[0] is None:
        raise RuntimeError("the raster has no pixels")
    if got[2] < 0 or got[3] < 0:
        raise RuntimeError("pixels start at (0, 0)")
    return got[0] + 1, got[1] + 1


def encode(raster: Raster, path: str, precision: float = 1.0, pipeline: str = "predictor", context: str = "simple", disable_quadtree: bool = False) -> EncodeResult:
    _checked(precision, pipeline, context)
    start = time.time()
    width, height = _shape(raster.pixels)
    how = {"extended": context == "extended", "use_wavelet": pipeline == "wavelet", "tree": not disable_quadtree}
    blocks = stage(codec.encode(quantized(raster, precision), precision, **how), "coded")
    n, size = ct.write(blocks, ct.Header(width, height, precision, tuple(raster.transform), raster.wkt, raster.nodata, **how), path)
    used = {} if pipeline == "wavelet" else {NAMES[r["predictor"]]: r["count"] for r in blocks.groupBy("predictor").count().collect()}
    return EncodeResult(width, height, n, size, used, time.time() - start)


def _region(header: ct.Header, region: tuple[int, int, int, int] | None) -> tuple[int, int, int, int]:
    x, y, w, h = region or (0, 0, 0, 0)
    if (w == 0) != (h == 0):
        raise ValueError("a region has a width and a height, or neither")
    if min(x, y, w, h) < 0:
        raise ValueError("a region has no negative numbers")
    return (x, y, w, h) if w else (0, 0, header.width, header.height)


def decoded(spark: SparkSession, path: str, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(y, x, q, nodata) of the region, in the whole grid's coordinates; tiles that it misses are not read."""
    header, _ = ct.read_header(path)
    x, y, w, h = _region(header, region)
    grid = codec.decode(ct.read(spark, path, (x, y, w, h)), header.precision, header.extended, header.use_wavelet)
    return grid.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def decode(spark: SparkSession, path: str, region: tuple[int, int, int, int] | None = None) -> Raster:
    """The raster of the region, moved to its own origin."""
    header, _ = ct.read_header(path)
    x, y, _, _ = _region(header, region)
    q: Column = px.dequantize(F.col("q"), header.precision, F.col("nodata"), header.nodata)
    ox, pw, rx, oy, ry, ph = header.transform
    moved = (ox + x * pw + y * rx, pw, rx, oy + x * ry + y * ph, ry, ph)
    return Raster(decoded(spark, path, region).select((F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), q.alias("z")), header.nodata, moved, header.wkt)


def info(spark: SparkSession, path: str) -> FileInfo:
    """From header and index alone."""
    header, n = ct.read_header(path)
    return FileInfo(header, n, ct.read(spark, path, payload=False).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def verify(spark: SparkSession, path: str, source: Raster | None = None) -> VerifyResult:
    """Checksums of all blocks; against a source, all pixels at the container's precision."""
    header, n = ct.read_header(path)
    bad = ct.read(spark, path).where(F.crc32("payload") != F.col("crc")).agg(F.min(F.struct("leaf", "x", "y")).alias("b")).first()["b"]
    if bad is not None:
        return VerifyResult(False, f"Block [{bad['x']},{bad['y']}] corrupt", bad["leaf"] + 1)
    if source is None:
        return VerifyResult(True, f"All {n} block checksums are valid.", n)
    width, height = _shape(source.pixels)
    if (width, height) != (header.width, header.height):
        return VerifyResult(False, f"Dimension mismatch ({header.width}x{header.height} vs {width}x{height})", n)
    a = quantized(source, header.precision)
    b = decoded(spark, path).select("y", "x", F.col("q").alias("p"), F.col("nodata").alias("hole"))
    same = F.coalesce((F.col("nodata") == F.col("hole")) & (F.col("nodata") | (F.col("q") == F.col("p"))), F.lit(False))
    got = a.join(b, ["y", "x"], "full_outer").agg(F.count(F.lit(1)).alias("n"), F.sum((~same).cast("long")).alias("bad")).first()
    text = f"{got['bad']} of {got['n']} pixels differ." if got["bad"] else f"Verification passed: {got['n']} pixels are identical."
    return VerifyResult(not got["bad"], text, n, got["n"], got["bad"])
