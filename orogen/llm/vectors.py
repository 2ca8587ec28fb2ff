"""Vectors in blocks: rows in a stated order, packed so that NumPy can take a block at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ_BITS = 20  # blocks in a partition
POS_BITS = 16  # rows in a block


def finite(vec: Column, dim: int) -> Column:
    """True for a vector of ``dim`` components that are all there and finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) == dim) & ~bad, F.lit(False))


def dimension(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """The most frequent number of components (the smaller at a tie; 0 if there is no vector), and the vectors of that size."""
    got = df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return (got[0]["d"], got[0]["count"]) if got else (0, 0)


def sample_matrix(df: DataFrame, vec_col: str, rows: int, dim: int) -> np.ndarray:
    """Up to ``rows`` vectors, those first in hash order."""
    got = df.orderBy(F.xxhash64(vec_col)).select(vec_col).limit(rows).collect()
    return np.array([r[0] for r in got], float).reshape(len(got), dim)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), dim)


def pack_blocks(ordered: DataFrame, dim: int, dtype: str, box: Callable, rows: int) -> DataFrame:
    """One row per run of up to ``rows`` rows in each partition's order.

    ``ordered``: (vec_id, vec), vec as raw bytes of ``dtype``, partitioned and sorted. Gives (block, n, ids, has, vecs,
    lo, hi): ids and vecs as raw bytes, lo and hi what ``box`` says of the block.
    A row's number is ``block << POS_BITS | position``; ``has`` is 0 where an id is null."""
    schema = "block long, n int, ids binary, has binary, vecs binary, lo array<double>, hi array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, count = TaskContext.get().partitionId() << SEQ_BITS, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, count
            ids, has = (np.concatenate([h[i] for h in held]) for i in range(2))
            raw = b"".join([x for h in held for x in h[2]])
            lo, hi = box(np.frombuffer(raw, dtype).reshape(-1, dim))
            cols = [pa.array([first + seq], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([has.tobytes()], pa.binary()), pa.array([raw], pa.binary()), pa.array([lo], pa.list_(pa.float64())), pa.array([hi], pa.list_(pa.float64()))]
            seq, held, count = seq + 1, [], 0
            return pa.RecordBatch.from_arrays(cols, names=["block", "n", "ids", "has", "vecs", "lo", "hi"])

        for b in batches:
            has = np.asarray(b.column(0).is_valid()).astype(np.uint8)
            ids, vecs, s = np.asarray(b.column(0).fill_null(0), np.int64), b.column(1).to_pylist(), 0
            while s < b.num_rows:
                t = min(b.num_rows, s + rows - count)
                held.append((ids[s:t], has[s:t], vecs[s:t]))
                count, s = count + t - s, t
                if count == rows:
                    yield flush()
        if held:
            yield flush()

    return ordered.mapInArrow(run, schema)


def unpack_ids(blocks: DataFrame) -> DataFrame:
    """(rid, vec_id) of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, has in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                ids = np.frombuffer(ids, np.int64)
                rid = (block << POS_BITS) + np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(ids, mask=np.frombuffer(has, np.uint8) == 0)], names=["rid", "vec_id"])

    return blocks.select("block", "ids", "has").mapInArrow(run, "rid long, vec_id long")
