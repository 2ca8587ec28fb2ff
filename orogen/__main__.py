"""Command line: encode, decode, analyze, info, verify, version. Rasters are TIFF files, or Parquet tables of (y, x, z)."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from orogen import api
from orogen.report import analyze
from orogen.sources import tiff
from orogen.sources.container import IDENTITY

SUFFIXES = (".tif", ".tiff")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orogen")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode", "analyze", "info", "verify"):
        c = sub.add_parser(name)
        c.add_argument("input")
        if name in ("encode", "decode"):
            c.add_argument("-o", "--output", required=True)
        if name == "verify":
            c.add_argument("source", nargs="?")
        if name in ("encode", "analyze"):
            c.add_argument("--precision", "--scale", default="1.0", help="a number, or m, dm, cm, mm")
        if name in ("encode", "analyze", "verify"):
            c.add_argument("--nodata", type=float)
        if name == "encode":
            c.add_argument("--pipeline", choices=api.PIPELINES, default="predictor")
            c.add_argument("--context", choices=api.CONTEXTS, default="simple")
            c.add_argument("--disable-quadtree", action="store_true")
            c.add_argument("--transform", type=float, nargs=6)
            c.add_argument("--wkt")
        if name == "decode":
            c.add_argument("--region", type=int, nargs=4, metavar=("X", "Y", "W", "H"))
        if name == "analyze":
            c.add_argument("-w", "--wavelet", action="store_true")
            c.add_argument("--compact", action="store_true")
    sub.add_parser("version")
    return p


def _raster(spark: SparkSession, path: str, a: argparse.Namespace) -> api.Raster:
    """What the options say goes before what the file says."""
    found = tiff.read(spark, path) if path.lower().endswith(SUFFIXES) else api.Raster(spark.read.parquet(path).select("y", "x", "z"))
    said = {k: getattr(a, k, None) for k in ("nodata", "transform", "wkt")}
    return dataclasses.replace(found, **{k: tuple(v) if k == "transform" else v for k, v in said.items() if v is not None})


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(api.VERSION)
        return 0
    spark = SparkSession.builder.appName("orogen").getOrCreate()
    try:
        if a.command == "encode":
            out = dataclasses.asdict(api.encode(_raster(spark, a.input, a), a.output, api.parse_precision(a.precision), a.pipeline, a.context, a.disable_quadtree))
        elif a.command == "decode":
            got = api.decode(spark, a.input, tuple(a.region) if a.region else None)
            if a.output.lower().endswith(SUFFIXES):
                tiff.write(got, a.output)
            else:
                got.pixels.write.mode("overwrite").parquet(a.output)
            out = {"output": a.output, "transform": got.transform, "nodata": got.nodata}
        elif a.command == "analyze":
            out = analyze(_raster(spark, a.input, a), api.parse_precision(a.precision), a.wavelet)
            if a.compact:
                out = {k: out[k] for k in ("dataset", "compressibility")}
        elif a.command == "info":
            out = dataclasses.asdict(api.info(spark, a.input))
        else:
            got = api.verify(spark, a.input, _raster(spark, a.source, a) if a.source else None)
            out = dataclasses.asdict(got)
            print(json.dumps(out, indent=2))
            return 0 if got.passed else 1
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
