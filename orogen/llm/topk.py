"""Exact top-k inner products by a dual-tree search over a cover tree.

Queries and data share one tree. Its upper levels are a farthest-first order of a
bounded sample, and every row goes to the nearest point. The rows of such a node are
cut into blocks, and each block carries the lower levels on, as a cover tree of its
own rows, so leaves hold a few dozen rows at every size. A block first searches
itself, which gives each query its kth score so far. The worst kth score of the
queries under a node then decides, from the root down, which pairs of nodes are
dropped by their covering radii: nodes of the upper tree first, then blocks, then,
within a pair of blocks, the nodes of their own trees.

Of rows with equal vectors, which score alike, those with the k + 1 smallest ids are
data, as no other can be among any query's k best; all queries are kept. Queries are shipped to data, never the other way, and vectors travel as small
integers where their components allow it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.llm.common import staged, table
from orogen.llm.vectors import POS_BITS, SEQ_BITS, dimension, finite, matrix, sample_matrix

EXACT = 2.0**53  # sums of products below this are exact in double precision
SINGLE = 2.0**24  # and below this in single precision
KINDS = ("i1", "i2", "f8", "f8")  # how a vector is held, by its largest component; the last for those whose products may not be exact
LEAF_ROWS, MOST_LEAVES, BASE = 64, 128, 4
MOST, LEAST = 2**63 - 1, -(2**63)


class CoverTree:
    """Levels of nested centres; ``centers`` in farthest-first order."""

    def __init__(self, points: np.ndarray, leaves: int = 64, base: int = BASE):
        order, dist = [0], np.linalg.norm(points - points[0], axis=1)
        while len(order) < min(leaves, len(points)) and dist.max() > 0:
            order.append(int(dist.argmax()))
            dist = np.minimum(dist, np.linalg.norm(points - points[order[-1]], axis=1))
        self.centers = points[order]
        self.norms = np.linalg.norm(self.centers, axis=1)
        self.sizes = [1]
        while self.sizes[-1] < len(order):
            self.sizes.append(min(len(order), self.sizes[-1] * base))
        self.up = [np.zeros(1, np.int64)]  # by level, the parent of each node in the level above
        for above, here in zip(self.sizes, self.sizes[1:], strict=False):
            near = self.nearest(self.centers[:here], above)
            near[:above] = np.arange(above)  # a centre stays its own child
            self.up.append(near)

    def __getstate__(self) -> dict:
        """Centres travel as the smallest integers that hold them."""
        most = np.abs(self.centers).max(initial=0)
        return self.__dict__ | {"centers": self.centers.astype("i1" if most <= 127 else "i2" if most <= 32767 else "f8")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"centers": state["centers"].astype(np.float64)}

    def nearest(self, m: np.ndarray, among: int | None = None) -> np.ndarray:
        c = self.centers[:among]
        return ((c * c).sum(axis=1) - 2 * m @ c.T).argmin(axis=1)

    def radii(self, leaf: np.ndarray) -> list[np.ndarray]:
        """Covering radius of each node of each level, given those of the leaves (negative: nothing below)."""
        out = [leaf]
        for level in range(len(self.sizes) - 1, 0, -1):
            r, up, below = np.full(self.sizes[level - 1], -1.0), self.up[level], out[0]
            step = np.linalg.norm(self.centers[: self.sizes[level]] - self.centers[up], axis=1)
            np.maximum.at(r, up, np.where(below >= 0, below + step, -1.0))
            out.insert(0, r)
        return out

    def least(self, leaf: np.ndarray) -> list[np.ndarray]:
        """By level, the least value of any leaf below."""
        out = [leaf]
        for level in range(len(self.sizes) - 1, 0, -1):
            low = np.full(self.sizes[level - 1], math.inf)
            np.minimum.at(low, self.up[level], out[0])
            out.insert(0, low)
        return out


def surviving(q: CoverTree, rq: list[np.ndarray], worst: list[np.ndarray], d: CoverTree, rd: list[np.ndarray]) -> np.ndarray:
    """Pairs (query leaf, data leaf) that the descent from both roots doesn't drop, as a table of flags.

    A pair is dropped if no query within rq of its centre can have a product with a row within
    rd of the other that reaches the worst kth score of the queries there."""
    keep, levels = np.ones((1, 1), bool), max(len(q.sizes), len(d.sizes))
    for level in range(levels):
        lq, ld = min(level, len(q.sizes) - 1), min(level, len(d.sizes) - 1)
        if level:
            keep = keep[q.up[lq] if level == lq else slice(None)][:, d.up[ld] if level == ld else slice(None)]
        nq, nd = q.sizes[lq], d.sizes[ld]
        a, b = np.maximum(rq[lq], 0.0), np.maximum(rd[ld], 0.0)
        most = q.centers[:nq] @ d.centers[:nd].T + np.outer(a, d.norms[:nd]) + np.outer(q.norms[:nq], b) + np.outer(a, b)
        slack = 1e-6 + 1e-12 * np.outer(q.norms[:nq] + a, d.norms[:nd] + b)
        keep = keep & (most + slack >= worst[lq][:, None]) & (rq[lq] >= 0)[:, None] & (rd[ld] >= 0)
        if not keep.any():
            break
    return np.broadcast_to(keep, (q.sizes[-1], d.sizes[-1])) if not keep.any() else keep


@dataclass
class Rows:
    """Rows of a block in leaf order, or the queries among them. ``starts``: where each leaf's rows begin."""

    block: int
    tree: CoverTree
    starts: np.ndarray
    radii: list[np.ndarray]
    ids: np.ndarray
    has: np.ndarray  # 0 where the id is null
    rows: np.ndarray  # number of the row
    kind: str
    vecs: np.ndarray


def local_rows(block: int, ids: np.ndarray, has: np.ndarray, rows: np.ndarray, data: np.ndarray, m: np.ndarray, kind: str, every: int) -> tuple[Rows, Rows]:
    """The block's data with a cover tree of all its rows, and the queries in it."""
    m = m.astype(np.float64)
    tree = CoverTree(m, max(1, min(MOST_LEAVES, len(m) // LEAF_ROWS)))
    leaf = tree.nearest(m)
    order = np.argsort(leaf, kind="stable")
    ids, has, rows, data, m, leaf = ids[order], has[order], rows[order], data[order], m[order], leaf[order]
    far = np.linalg.norm(m - tree.centers[leaf], axis=1) * (1 + 1e-12) + 1e-9
    out = []
    for some in (np.nonzero(data)[0], np.nonzero((ids % every == 0) & (has == 1))[0]):
        r = np.full(tree.sizes[-1], -1.0)
        np.maximum.at(r, leaf[some], far[some])
        starts = np.searchsorted(leaf[some], np.arange(tree.sizes[-1] + 1))
        out.append(Rows(block, tree, starts, tree.radii(r), ids[some], has[some], rows[some], kind, m[some].astype(kind)))
    return out[0], out[1]


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in single or double precision where sums stay exact there, else as Python integers."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(d.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < SINGLE:
        return q.astype(np.float32) @ d.astype(np.float32).T
    if most < EXACT:
        return q.astype(np.float64) @ d.astype(np.float64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    s = whole(q) @ whole(d).T
    return np.array([[min(MOST, max(LEAST, x)) for x in row] for row in s.tolist()], dtype=object).reshape(s.shape)


def best_of(q: np.ndarray, d: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, score) of up to k best data rows a query, none after the
    one of score ``floor`` and id ``last``; ties to the smaller id. ``own``: a query's own data row or -1."""
    s = products(q, d)
    big = s.dtype == object
    low = (floor.astype(object) if big else floor)[:, None]
    mask = np.asarray(s >= low, bool)
    mask &= np.asarray(s != low, bool) | (ids[None, :] <= last[:, None])
    there = own >= 0
    mask[np.nonzero(there)[0], own[there]] = False
    if not big and s.shape[1] > k and mask.sum() > 8 * k * len(q):
        t = np.where(mask, s, -np.inf)
        mask &= s >= np.partition(t, -k, axis=1)[:, -k][:, None]
    i, j = np.nonzero(mask)
    v = s[i, j].astype(np.int64)
    order = np.lexsort((j, ids[j], -v, i)) if v.min(initial=0) > LEAST else np.array(sorted(range(len(i)), key=lambda x: (i[x], -int(v[x]), ids[j[x]], j[x])), np.int64)
    i, j, v = i[order], j[order], v[order]
    first = np.searchsorted(i, np.arange(len(q)))
    top = np.arange(len(i)) - first[i] < k
    return i[top], j[top], v[top]


def search_rows(q: Rows, d: Rows, low: np.ndarray, last: np.ndarray, k: int, chunk: int = 256) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, data row, score) of up to k rows of ``d`` for each query, none after its kth so far (score ``low``, id ``last``)."""
    leaf_low = np.array([low[a:b].min(initial=math.inf) for a, b in zip(q.starts, q.starts[1:], strict=False)])
    keep = surviving(q.tree, q.radii, q.tree.least(leaf_low), d.tree, d.radii)
    out = []
    if not keep.any():
        return out
    ids = np.where(d.has == 1, d.ids, MOST)
    sizes = np.diff(d.starts)
    at = np.full(len(q.ids), -1)  # a query's own place in the data
    if q.block == d.block:
        order = np.argsort(d.rows)
        place = np.minimum(np.searchsorted(d.rows[order], q.rows), len(order) - 1)
        at = np.where(d.rows[order][place] == q.rows, order[place], -1)
    if keep.mean() > 0.3:  # most of it is needed: whole rows of queries at once
        groups = [(np.arange(a, min(a + chunk, len(q.ids))), keep.any(axis=0)) for a in range(0, len(q.ids), chunk)]
    else:
        groups = [(np.arange(q.starts[g], q.starts[g + 1]), keep[g]) for g in np.nonzero(keep.any(axis=1))[0]]
    for rows, leaves in groups:
        cols = np.nonzero(np.repeat(leaves, sizes))[0]
        place = np.minimum(np.searchsorted(cols, at[rows]), len(cols) - 1)
        own = np.where(cols[place] == at[rows], place, -1)
        i, j, v = best_of(q.vecs[rows], d.vecs[cols], ids[cols], own, low[rows], last[rows], k)
        out.append((rows[i], cols[j], v))
    return out


FOUND = "q long, qrid long, query_id long, vec_id long, rid long, score long"


def _found(q: Rows, d: Rows, got: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    i, j, v = (np.concatenate([g[x] for g in got]) if got else np.empty(0, np.int64) for x in range(3))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(i), q.block)), pa.array(q.rows[i]), pa.array(q.ids[i]), pa.array(d.ids[j], mask=d.has[j] == 0), pa.array(d.rows[j]), pa.array(v)],
        names=["q", "qrid", "query_id", "vec_id", "rid", "score"],
    )


def _assigned(rows: DataFrame, dim: int, tree: CoverTree) -> DataFrame:
    """(vec_id, vec, kind, node) with the vector's whole numbers as raw bytes."""
    wide = math.floor(math.sqrt(EXACT / dim)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.floor(matrix(b.column(1), dim))
            most = np.abs(m).max(axis=1)
            kind = np.where(most <= 127, 0, np.where(most <= 32767, 1, np.where(most <= wide, 2, 3))).astype(np.int32)
            vecs = [None] * len(m)
            for x in np.unique(kind):
                for i, v in zip(np.nonzero(kind == x)[0].tolist(), m[kind == x].astype(KINDS[x]), strict=True):
                    vecs[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.binary()), pa.array(kind), pa.array(tree.nearest(m).astype(np.int32))], names=["vec_id", "vec", "kind", "node"])

    return rows.mapInArrow(run, "vec_id long, vec binary, kind int, node int")


BLOCKS = "block long, node int, n int, queries int, mid array<double>, rd double, rq double, data binary, group binary"


def _packed(ordered: DataFrame, dim: int, every: int, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` rows of one node and kind, in each partition's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << SEQ_BITS, 0
        key, held, count = None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, count
            ids, has, row, data = (np.concatenate([h[i] for h in held]) for i in range(4))
            m = np.frombuffer(b"".join([x for h in held for x in h[4]]), KINDS[key[1]]).reshape(-1, dim)
            data, group = local_rows(first + seq, ids, has, row, data, m, KINDS[key[1]], every)
            mid = m.astype(np.float64).mean(axis=0)
            reach = lambda r: float(np.linalg.norm(r.vecs.astype(np.float64) - mid, axis=1).max()) * (1 + 1e-12) + 1e-9 if len(r.ids) else -1.0
            cols = [[first + seq], [key[0]], [len(data.ids)], [len(group.ids)], [mid.tolist()], [reach(data)], [reach(group)], [pickle.dumps(data)], [pickle.dumps(group) if len(group.ids) else None]]
            seq, held, count = seq + 1, [], 0
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "node", "n", "queries", "mid", "rd", "rq", "data", "group"])

        for b in batches:
            if not b.num_rows:
                continue
            has = np.asarray(b.column(0).is_valid()).astype(np.uint8)
            ids = np.asarray(b.column(0).fill_null(0), np.int64)
            vecs, node, kind = b.column(1).to_pylist(), np.asarray(b.column(3)), np.asarray(b.column(2))
            row, data = np.asarray(b.column(4)), np.asarray(b.column(5).to_pylist(), bool)
            cuts = [0, *(np.nonzero((np.diff(node) != 0) | (np.diff(kind) != 0))[0] + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                here = (int(node[s]), int(kind[s]))
                if held and key != here:
                    yield flush()
                key = here
                while s < e:
                    t = min(e, s + rows - count)
                    held.append((ids[s:t], has[s:t], row[s:t], data[s:t], vecs[s:t]))
                    count, s = count + t - s, t
                    if count == rows:
                        yield flush()
        if held:
            yield flush()

    return ordered.mapInArrow(run, BLOCKS)


def _below(score: int) -> float:
    """A double that is not above the score."""
    return float(score) if abs(score) < EXACT else float(np.nextafter(float(score), -math.inf))


def _own_block(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each block's queries against the block itself."""
    for batch in batches:
        for x in range(batch.num_rows):
            q, d = pickle.loads(batch.column(0)[x].as_py()), pickle.loads(batch.column(1)[x].as_py())
            yield _found(q, d, search_rows(q, d, np.full(len(q.ids), -math.inf), np.full(len(q.ids), MOST), k))


def _with_floors(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(q, node, low, last, worst) from (q, node, group, known): score and id of each query's kth so far, and the least score."""
    for batch in batches:
        low, last, worst = [], [], []
        for group, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            q, got = pickle.loads(group), {x["qrid"]: x for x in known or ()}
            some = [got.get(r) for r in q.rows.tolist()]
            by = np.array([-math.inf if x is None else _below(x["s"]) for x in some])
            low.append(by.tobytes())
            last.append(np.array([MOST if x is None or _below(x["s"]) != x["s"] else x["id"] for x in some], np.int64).tobytes())
            worst.append(float(by.min()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.binary()), pa.array(last, pa.binary()), pa.array(worst)], names=["q", "node", "low", "last", "worst"])


def _block_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Groups of queries against the blocks that they were shipped to."""
    last, d = None, None
    for batch in batches:
        for x in range(batch.num_rows):
            block, data, group, low, after = (batch.column(i)[x] for i in range(5))
            if last != block.as_py():
                last, d = block.as_py(), pickle.loads(data.as_py())
            q = pickle.loads(group.as_py())
            got = search_rows(q, d, np.frombuffer(low.as_py()), np.frombuffer(after.as_py(), np.int64), k)
            if got:
                yield _found(q, d, got)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def node_pairs(tree: CoverTree, rq: np.ndarray, rd: np.ndarray, worst: np.ndarray) -> list[tuple[int, list[int]]]:
    """For each node of the upper tree that has queries, the nodes whose rows may reach them."""
    keep = surviving(tree, tree.radii(rq), tree.least(worst), tree, tree.radii(rd))
    return [(int(g), np.nonzero(keep[g])[0].tolist()) for g in np.nonzero(keep.any(axis=1))[0]]


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0, every: int = 20, sample_rows: int = 4096, nodes: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the
    ``k`` other rows of greatest inner product of floor(scale * x); ties to the smaller id.

    Vectors that are null, hold null or non-finite components (or ones that ``scale`` makes
    so), or have another dimension than most, take no part. Products of large finite
    components are exact; a score outside of the range of a long is held at its end
    before ranks are given. A row with a null id is a candidate, last at
    a tie, and no query. Repeated rows are rows of their own: each is a query or
    candidate, and only itself is left out. Other columns are left out, an empty table gives
    an empty result. ``sample_rows`` and ``nodes`` bound the sample and the upper tree that is
    made of it; every row is indexed, and radii and results are of all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * F.lit(scale)).alias("vec"))
    dim, n = dimension(rows, "vec")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim:
        return empty
    whole = rows.where(finite(F.col("vec"), dim))
    sample = np.floor(sample_matrix(whole, "vec", sample_rows, dim))
    if not len(sample):
        return empty
    block_rows = max(LEAF_ROWS, min(1 << POS_BITS, block_bytes // (8 * dim)))
    tree = CoverTree(sample, max(1, min(nodes, n // block_rows)))
    parts = max(1, math.ceil(n / block_rows))
    put = staged(_assigned(whole, dim, tree).withColumn("row", F.monotonically_increasing_id()), "assigned")
    copies = Window.partitionBy("vec", "kind").orderBy(F.asc_nulls_last("vec_id"), "row")
    data = put.withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= k + 1).drop("__n")
    data = staged(data, "data")  # cut map-side before the shuffle, so a frequent vector weighs on no task
    others = put.where(F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0)).join(data.select("row"), "row", "left_anti")
    used = data.withColumn("data", F.lit(True)).unionByName(others.withColumn("data", F.lit(False)))
    ordered = used.repartitionByRange(parts, "node", "kind", "vec_id").sortWithinPartitions("node", "kind", F.asc_nulls_last("vec_id")).select("vec_id", "vec", "kind", "node", "row", "data")
    blocks = staged(_packed(ordered, dim, every, block_rows), "blocks")
    with_queries = blocks.where("queries > 0")
    seen = staged(with_queries.select("group", "data").mapInArrow(lambda it: _own_block(it, k), FOUND), "own")

    # a query's kth so far, by block; a block has a bound on its rows
    kth = seen.groupBy("q", "qrid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.coalesce("vec_id", F.lit(MOST))).alias("id"))).alias("m")).where(F.col("n") >= k)
    known = kth.groupBy("q").agg(F.collect_list(F.struct("qrid", F.col("m.score").alias("s"), (-F.col("m.id")).alias("id"))).alias("known"))
    groups = with_queries.select(F.col("block").alias("q"), "node", "group").join(known, "q", "left").select("q", "node", "group", "known")
    floors = staged(groups.mapInArrow(lambda it: _with_floors(it, k), "q long, node int, low binary, last binary, worst double"), "floors")

    # nodes of the upper tree: at most ``nodes`` rows
    rq, rd, worst = (np.full(len(tree.centers), x) for x in (-1.0, -1.0, math.inf))
    reach = blocks.select("node", "mid", "rd", "rq")
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(tree.centers)], "node int, center array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with("mid", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    for r in reach.join(F.broadcast(centers), "node").groupBy("node").agg(F.max(F.col("rd") + gap).alias("rd"), F.max(F.when(F.col("rq") >= 0, F.col("rq") + gap)).alias("rq")).collect():
        rd[r["node"]], rq[r["node"]] = r["rd"] * (1 + 1e-9), -1.0 if r["rq"] is None else r["rq"] * (1 + 1e-9)
    for r in floors.groupBy("node").agg(F.min("worst").alias("worst")).collect():
        worst[r["node"]] = r["worst"]
    listed = spark.createDataFrame(node_pairs(tree, rq, rd, worst) or [], "node int, others array<int>")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = lambda c: F.sqrt(dot(c, c))
    sums = blocks.select("block", "node", "mid", "rd", "rq")
    qs = sums.where("rq >= 0").join(floors.select(F.col("q").alias("block"), "worst"), "block")
    qs = qs.join(F.broadcast(listed), "node").select(F.col("block").alias("q"), F.col("mid").alias("qmid"), F.col("rq"), "worst", F.explode("others").alias("node"))
    ds = sums.select(F.col("block").alias("d"), "node", F.col("mid").alias("dmid"), "rd")
    most = dot(F.col("qmid"), F.col("dmid")) + F.col("rq") * far("dmid") + far("qmid") * F.col("rd") + F.col("rq") * F.col("rd")
    pairs = staged(qs.join(ds, "node").where("q <> d").where(most * (1 + 1e-9) + F.abs(most) * 1e-9 + 1e-6 >= F.col("worst")).select("q", "d"), "pairs")

    shipped = pairs.join(with_queries.select(F.col("block").alias("q"), "group").join(floors.select("q", "low", "last"), "q"), "q")
    todo = shipped.join(blocks.select(F.col("block").alias("d"), "data"), "d").select("d", "data", "group", "low", "last")
    found = seen.unionByName(todo.mapInArrow(lambda it: _block_pairs(it, k), FOUND))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
