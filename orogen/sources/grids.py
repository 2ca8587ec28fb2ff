"""Pixel grids (y, x, z [, nodata]) read from tables; column pruning and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector, a column for each component."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "z")).select("y", F.col("x").cast("long").alias("x"), F.col("z").cast("double").alias("z"))


def _dense(df: DataFrame, key: str, z: str, *more: str, width: int = 100) -> DataFrame:
    return df.select(F.expr(f"{key} div {width}").alias("y"), F.expr(f"{key} % {width}").alias("x"), F.col(z).alias("z"), *more)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total prices in key order, 100 to a row."""
    return _dense(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_totalprice")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values in id order, 100 to a row; an error has the no-data value."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.when(F.col("event_type") == "error", NODATA).otherwise(F.col("value")))
    return _dense(df, "event_id", "v")
