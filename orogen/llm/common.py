"""What the operators of this subpackage share: staged tables and graph components."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns freed memory to the system. Python workers live on between tasks, and what their allocators keep counts as theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def giving_back(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, with freed memory given back once a task is over."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


_folders: dict[str, list[str]] = {}  # by application, the folders that are in use in place of the session's own


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: one of our own in local
    mode, where there is one machine, and a folder of the warehouse on a cluster."""
    own = _folders.setdefault(spark.sparkContext.applicationId, [])
    if own:
        return own[-1]
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        if spark.sparkContext.master.startswith("local"):
            where = f"file://{tempfile.mkdtemp(prefix='orogen-')}"
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/orogen-staging"
        own.append(where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither
    recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of ``n`` that Spark deals each 64-bit number to: the Murmur3 hash of its two halves with seed 42, modulo ``n``."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.full(len(ids), 42, np.uint32)
    for half in (ids & 0xFFFFFFFF, (ids >> 32) & 0xFFFFFFFF):
        h = turn(h ^ turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return np.mod((h ^ (h >> np.uint32(16))).astype(np.int32), n)


def staged_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``staged``, but dealt to ``bucket_count`` buckets by ``key``: joins on ``key`` then move the
    other table alone. A task writes a file for each bucket that its keys fall in. The catalog knows the table only while it is read back."""
    spark = df.sparkSession
    path, at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"orogen_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(bucket_count(spark), key).option("path", path).saveAsTable(at)
    out = spark.table(at)
    out.schema  # noqa: B018  resolved before the catalog forgets the table
    spark.sql(f"drop table {at}")
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again."""
    for t in tables:
        if t is not None and getattr(t, "staged_at", None):
            delete(t.sparkSession, t.staged_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for what is staged within, deleted at the end: for callers that write their result elsewhere."""
    here = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    own = _folders[spark.sparkContext.applicationId]
    own.append(here)
    try:
        yield here
    finally:
        own.pop()
        delete(spark, here)


def join_hot(big: DataFrame, small: DataFrame, key: str, how: str = "inner", least: int = 1000, most: int = 1000) -> DataFrame:
    """``big`` joined with ``small``, whose ``key`` is unique, whatever share of the rows a key holds.

    The ``most`` keys with the most rows of ``big``, of those with more than ``least``, have their rows of ``small`` sent
    to all tasks; any other key holds less than one row in ``most`` and is merged, at every size: ``small`` grows with the
    corpus, and the driver would have to hold it whole. ``big`` is read once more, so it should be a staged table."""
    merged = small.hint("merge")
    counts = big.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least)
    hot = [r[0] for r in counts.orderBy(F.desc("count")).limit(most).collect()]
    if not hot:
        return big.join(merged, key, how)
    kind = big.schema[key].dataType.simpleString()
    keys = F.broadcast(big.sparkSession.createDataFrame([(k,) for k in hot], f"__hot {kind}"))
    pick = lambda t, way: t.join(keys, t[key] == keys["__hot"], way)
    few = F.broadcast(pick(small, "left_semi"))
    return pick(big, "left_semi").join(few, key, how).unionByName(pick(big, "left_anti").join(merged, key, how))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a long, b long): (node, component), the
    component being the smallest node that can be reached.

    Random contraction: each round maps a node to the neighbour (or itself) that
    comes first in a hash order, and joins the edges to that map. The order is drawn anew every other round: the first
    round of an order brings a star's hub to its first node, the second brings all others there, and a new draw
    breaks up chains. Rounds grow with the logarithm of the longest path. All state is in tables, deleted when the next are written."""
    e = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    round_no = 0
    while e.take(1):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(round_no // 2), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        to = staged(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(order("b")).alias("m"))
            .select("node", F.least(F.col("m"), order("node"))["n"].alias("to")),
            "contract",
        )
        before = labels
        if labels is None:
            labels = staged(to.select("node", F.col("to").alias("label")), "labels")
        else:
            by = to.select(F.col("node").alias("label"), "to")
            labels = staged(join_hot(labels, by, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ta, tb = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = join_hot(e, ta, "a").join(tb.hint("merge"), "b").where("x <> y")
        after = staged(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(e, to, before)
        e = after
        round_no += 1
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return join_hot(labels, least, "label").select("node", "component")


def passing_columns(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator that passes all columns of its first table through: columns get neutral
    names inside, so none can clash with the operator's own. One that is named like a column
    that the operator adds is replaced by it."""
    signature = inspect.signature(f)

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        docs = next(iter(bound.arguments.values()))
        inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        for k, v in bound.arguments.items():
            if k.endswith("_col"):
                bound.arguments[k] = inner[v]
        bound.arguments[next(iter(bound.arguments))] = docs.toDF(*inner.values())
        out = f(*bound.args, **bound.kwargs)
        added = [c for c in out.columns if c not in inner.values()]
        return out.select(*[F.col(i).alias(c) for c, i in inner.items() if c not in added], *added)

    return run
