"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the codec on a generated terrain; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.operators import codec
from orogen.plans.queries import QUERIES

HEADLINE = ("quantize", "inpaint_rings", "raw_stats", "spatial_correlation", "gradient_residual", "gap_residual", "ls_residual", "predictor_ranking", "zero_run_symbols", "best_predictor_per_block", "quadtree_leaf_counts", "gradient_decode")
SIDE = 2048


def terrain(spark: SparkSession, precision: float) -> DataFrame:
    """(y, x, q, nodata): slopes, waves of four lengths, and a flat corner."""
    grid = spark.range(SIDE * SIDE).select(F.expr(f"id div {SIDE}").alias("y"), (F.col("id") % SIDE).alias("x"))
    y, x = F.col("y"), F.col("x")
    z = 1000 + 0.5 * x + 0.3 * y + 25 * F.sin(0.05 * x) * F.cos(0.04 * y) + 10 * F.sin(0.2 * x + 0.15 * y) + 40 * F.sin(0.6 * x + 0.4 * y) + 15 * F.sin(1.3 * x) * F.cos(1.1 * y)
    return grid.withColumn("q", F.round(F.when((x < 64) & (y < 64), 500.0).otherwise(z) / precision).cast("long")).withColumn("nodata", F.lit(False))


def codec_run(spark: SparkSession, precision: float, name: str, took: dict, bits: dict) -> None:
    with tempfile.TemporaryDirectory() as where:
        start = time.time()
        codec.encode(terrain(spark, precision), precision).write.parquet(f"{where}/blocks")
        took[f"encode_{name}"] = round(time.time() - start, 3)
        blocks = spark.read.parquet(f"{where}/blocks")
        bits[name] = round(8 * blocks.agg(F.sum(F.length("payload"))).first()[0] / SIDE**2, 3)
        start = time.time()
        codec.decode(blocks, precision).write.format("noop").mode("overwrite").save()
        took[f"decode_{name}"] = round(time.time() - start, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    total, bits = round(sum(took.values()), 3), {}
    codec_run(spark, 1.0, "metre", took, bits)
    codec_run(spark, 0.01, "centimetre", took, bits)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "bits_per_sample": bits, "codec_cells": SIDE**2, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
