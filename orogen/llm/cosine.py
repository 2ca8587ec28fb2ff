"""Embedding near-duplicates by an epsilon grid order join.

Vectors are sorted by their grid cells on the leading principal axes. The sequence is
cut into blocks, which travel, and those into runs of a few hundred rows. Unit vectors that are no
further apart than epsilon have projections that are no further apart, so a pair of
intervals whose boxes on those axes lie further apart is dropped with all that is
under it: intervals of blocks are joined recursively, then blocks, then the runs within a pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import components, join_hot, staged, table
from orogen.llm.vectors import POS_BITS, SEQ_BITS, dimension, finite, matrix, pack_blocks, sample_matrix, unpack_ids

RADIX = 4  # bits of the sequence number that a step of the recursion descends
FINE = 4  # cells to an epsilon
RUN_ROWS, SHORT_RUN = 256, 32  # most and, but for the last of a block, least rows of a run
BLOCK_BYTES = 16 << 20
BAND = 2e-5  # more than single precision can be wrong by in a product of unit vectors of up to a few thousand components


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(m: np.ndarray, k: int) -> np.ndarray:
    """The leading ``k`` orthonormal axes of the unit vectors in ``m``, as columns."""
    u = unit(m)
    u = u - u.mean(axis=0)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :k].copy()


def _cells(rows: DataFrame, dim: int, axes: np.ndarray, eps: float, dtype: str) -> DataFrame:
    """(vec_id, vec, cell): the vector as raw bytes, and the number of its cell in lexicographic order of the axes."""
    width = eps / FINE
    half = math.ceil(1 / width) + 1
    k = max(1, min(axes.shape[1], int(62 / math.log2(2 * half))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(1), dim)
            cell = np.floor(unit(m) @ axes[:, :k] / width).astype(np.int64) + half
            key = np.zeros(b.num_rows, np.int64)
            for j in range(k):
                key = key * (2 * half) + cell[:, j]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in m.astype(dtype)], pa.binary()), pa.array(key)], names=["vec_id", "vec", "cell"])

    return rows.mapInArrow(run, "vec_id long, vec binary, cell long")


def _interval_pairs(boxes: DataFrame, k: int, eps: float, shifts: list[int]) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks that may hold vectors within ``eps``. ``boxes``: (block, lo, hi);
    ``shifts``: the bits below an interval's number, from the widest intervals, of which there is one, down to 0."""

    def level(shift: int) -> DataFrame:
        ends = [F.min(F.col("lo")[j]).alias(f"lo{j}") for j in range(k)] + [F.max(F.col("hi")[j]).alias(f"hi{j}") for j in range(k)]
        node = F.shiftrightunsigned("block", shift) if shift else F.col("block")
        return boxes.groupBy(node.alias("node")).agg(*ends).select("node", F.array(*[f"lo{j}" for j in range(k)]).alias("lo"), F.array(*[f"hi{j}" for j in range(k)]).alias("hi"))

    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("blo")[j] - F.col("ahi")[j], F.col("alo")[j] - F.col("bhi")[j]), F.lit(2.0)) for j in range(k)), F.lit(0.0))
    pairs = None
    for above, shift in zip(shifts, shifts[1:], strict=False):
        nodes = level(shift).withColumn("up", F.shiftrightunsigned("node", above - shift))
        a = nodes.select(F.col("node").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("up").alias("pa"))
        b = nodes.select(F.col("node").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("up").alias("pb"))
        if pairs is None:  # all is under one interval
            pairs = a.join(b, F.col("pa") == F.col("pb"))
        else:
            pairs = pairs.join(a, "pa").join(b, "pb")
        pairs = pairs.where((F.col("a") <= F.col("b")) & (gap <= eps * eps)).select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def run_starts(p: np.ndarray, eps: float) -> np.ndarray:
    """Where runs of the rows with projections ``p`` start: at a step wider than ``eps``, or when a run is full."""
    steps = np.nonzero(((p[1:] - p[:-1]) ** 2).sum(axis=1) > eps * eps)[0] + 1
    out = [0]
    for s in [*steps.tolist(), len(p)]:
        while s - out[-1] > RUN_ROWS:
            out.append(out[-1] + RUN_ROWS)
        if SHORT_RUN <= s - out[-1] and s < len(p):
            out.append(s)
    return np.array(out)


def run_gaps(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Squared distance between the boxes of each run of ``a`` and each of ``b`` (projections, and where runs start)."""
    (alo, ahi), (blo, bhi) = ((np.minimum.reduceat(p, s), np.maximum.reduceat(p, s)) for p, s in ((a, sa), (b, sb)))
    out = np.zeros((len(alo), len(blo)))
    for j in range(a.shape[1]):
        out += np.maximum(0.0, np.maximum(blo[None, :, j] - ahi[:, None, j], alo[:, None, j] - bhi[None, :, j])) ** 2
    return out


def link_blocks(a: np.ndarray, b: np.ndarray | None, least: float, axes: np.ndarray, tile: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of ``a`` and ``b`` (unit vectors; None: within ``a``), and the
    least row that it reaches; rows of ``b`` come after those of ``a``.

    Products in single precision decide all but those next to the threshold, which are taken again in
    double precision. Links between rows already joined are counted but not kept, so memory is that of a tile."""
    within = b is None
    b = a if within else b
    at = 0 if within else len(a)
    n = len(a) if within else len(a) + len(b)
    counts, label = np.zeros(n, np.int64), np.arange(n)
    eps = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    qa, qb = a @ axes, b @ axes
    sa, sb = run_starts(qa, eps), run_starts(qb, eps)
    near = run_gaps(qa, sa, qb, sb) <= eps * eps
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    lengths = np.diff(np.append(sb, len(b)))
    for r, (s, e) in enumerate(zip(sa, np.append(sa[1:], len(a)), strict=True)):
        runs = near[r].copy()
        if within:
            runs[:r] = False
        cols = np.nonzero(np.repeat(runs, lengths))[0]
        for t in range(0, len(cols), tile):
            some = cols[t : t + tile]
            one = some[-1] - some[0] + 1 == len(some)
            p = fa[s:e] @ (fb[some[0] : some[-1] + 1] if one else fb[some]).T
            i, j = np.nonzero(p >= least - BAND)
            if not len(i):
                continue
            sure = p[i, j] >= least + BAND
            i, j = i + s, some[j]
            for x in range(0, len(i), 65536):
                y = np.nonzero(~sure[x : x + 65536])[0] + x
                sure[y] = (a[i[y]] * b[j[y]]).sum(axis=1) >= least
            i, j = i[sure], j[sure] + at
            if within:
                i, j = i[i < j], j[i < j]
            if len(i):
                counts += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
                apart = label[i] != label[j]
                if apart.any():
                    label = _least_labels(n, label[i[apart]], label[j[apart]])[label]
    return counts, label


def _joined(batches: Iterator[pa.RecordBatch], dim: int, least: float, axes: np.ndarray, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in range(batch.num_rows):
            a, b, va, vb = (batch.column(i)[x].as_py() for i in range(4))
            ma = unit(np.frombuffer(va, dtype).reshape(-1, dim).astype(np.float64))
            mb = unit(np.frombuffer(vb, dtype).reshape(-1, dim).astype(np.float64)) if a != b else None
            rid = (a << POS_BITS) + np.arange(len(ma))
            if mb is not None:
                rid = np.concatenate([rid, (b << POS_BITS) + np.arange(len(mb))])
            counts, label = link_blocks(ma, mb, least, axes)
            has = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(rid[has]), pa.array(counts[has]), pa.array(rid[label[has]])], names=["rid", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, axes: int = 16, sample_rows: int = 4096, block_bytes: int = BLOCK_BYTES, spread: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, all zero, hold null or non-finite components, or have
    another dimension than most, link with nothing. Repeated rows are vectors of
    their own and link with each other. A null id gets a row; a component is named by
    its smallest id that isn't null. ``sample_rows`` bounds the sample that the axes
    are fitted to; they only decide the order and what is dropped as provably distant, never a link. Other columns are left
    out. An empty table gives an empty one. A block has ``block_bytes`` at most, and there are
    ``spread`` blocks or more of any table that has so many times ``RUN_ROWS`` rows."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    dtype = "f4" if kind == "array<float>" else "f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    dim, n = dimension(rows, "vec")
    usable = finite(F.col("vec"), dim) & F.exists("vec", lambda x: x != 0.0)
    good = rows.where(usable)
    m = sample_matrix(good, "vec", sample_rows, dim) if dim else np.empty((0, 0))
    alone = rows.where(~F.coalesce(usable, F.lit(False))) if dim else rows
    lone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(m):
        return lone
    k = min(axes, dim)
    eps = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    basis = principal_axes(m, k)

    def box(v: np.ndarray) -> tuple[list, list]:
        p = unit(v.astype(np.float64)) @ basis
        return p.min(axis=0).tolist(), p.max(axis=0).tolist()

    most = max(RUN_ROWS, min(1 << POS_BITS, block_bytes // (dim * int(dtype[1])), math.ceil(n / spread)))
    parts = max(1, math.ceil(n / most))
    ordered = _cells(good, dim, basis, eps, dtype).repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").select("vec_id", "vec")
    blocks = staged(pack_blocks(ordered, dim, dtype, box, most), "blocks")
    got = blocks.agg(F.max("block"), F.max(F.col("block").bitwiseAND((1 << SEQ_BITS) - 1))).first()
    last, deepest = int(got[0]), int(got[1])
    shifts = [x for x in range(0, SEQ_BITS, RADIX) if not x or deepest >> x]
    shifts += [x for x in range(SEQ_BITS, last.bit_length() + RADIX, RADIX) if x == SEQ_BITS or last >> (x - RADIX)]
    shifts = sorted({*shifts, last.bit_length() + 1}, reverse=True)
    pairs = staged(_interval_pairs(blocks.select("block", "lo", "hi"), k, eps, shifts), "pairs")
    vecs = blocks.select("block", "vecs")
    both = pairs.join(vecs.select(F.col("block").alias("b"), F.col("vecs").alias("vb")), "b").join(vecs.select(F.col("block").alias("a"), F.col("vecs").alias("va")), "a")
    found = staged(both.select("a", "b", "va", "vb").mapInArrow(lambda it: _joined(it, dim, least, basis, dtype), "rid long, links long, root long"), "links")
    comp = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rid")
    counts = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    each = unpack_ids(blocks).join(counts, "rid", "left").join(comp, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    each = staged(each, "vectors")
    named = each.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = join_hot(each, named, "component").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(lone)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
