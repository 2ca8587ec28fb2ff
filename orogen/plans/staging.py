"""Tables written between the rounds of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # by application, the folder in place of one that the session does not name


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where it names none, one of our own in local mode and one in the warehouse on a cluster."""
    where = spark.conf.get(SHARED, None) or _own.get(spark.sparkContext.applicationId)
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = f"file://{tempfile.mkdtemp(prefix='orogen-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/orogen-staging"
        _own[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again, through Spark's own file systems."""
    for t in tables:
        if t is not None and getattr(t, "staged_at", None):
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(t.staged_at)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
