"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of ``BITS`` bits is cut into ``d // 2 + 1`` segments, so that of two
fingerprints at most ``d`` bits apart one segment differs by one bit at most.
Every distinct fingerprint is indexed under each segment as it is and under each
segment with one bit made a wildcard. An equality join of those variants finds
the pairs; the join itself verifies the distance and lets a pair through at its
first common variant only, so no pair is made twice and none that is no link.
Tables here grow with the corpus, so they are merged at every size: the driver
would have to hold whole what it sends to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import components, giving_back, join_hot, passing_columns, staged, table

BITS = 64
SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash over all ``width``-word shingles of the whole text, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    n = len(words) - width + 1
    grams = [b" ".join(words)] if n < 1 else [b" ".join(words[i : i + width]) for i in range(n)]
    digest = xxhash.xxh64_intdigest
    total, ones = len(grams), np.zeros(BITS, np.int64)
    for at in range(0, total, 65536):
        h = np.array([digest(g, SEED) for g in grams[at : at + 65536]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) for every row, fp a signed 64-bit long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(lambda it: _batches(it, width)), "id long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    k = distance // 2 + 1
    cuts = [BITS * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _variants(fps: DataFrame, distance: int, bit: int) -> DataFrame:
    """(variant, fp): every whole segment, and each one-wildcard segment whose
    wildcard bit equals ``bit`` in the fingerprint."""
    segs = _segments(distance)
    slots = []  # segment, wildcard (-1: none), first bit, mask of what stays
    for s, (at, n) in enumerate(segs):
        full = (1 << n) - 1
        slots += [(s, -1, at, full)] + [(s, p, at, full & ~(1 << p)) for p in range(n)]
    values = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(at).alias("at"), F.lit(m).cast("long").alias("m")) for s, p, at, m in slots])
    out = fps.select("fp", F.inline(values))
    out = out.where(F.expr(f"p < 0 or (shiftrightunsigned(fp, at + greatest(p, 0)) & 1) = {bit}"))
    return out.select("s", "p", F.expr("shiftrightunsigned(fp, at) & m").alias("rest"), "fp")


def _first_common(x: Column, distance: int) -> tuple[Column, Column]:
    """Segment of the first variant that two fingerprints with XOR ``x`` share, and whether it is a whole segment."""
    seg = whole = None
    steps = [(d, s, at, n) for d in (1, 0) for s, (at, n) in reversed(list(enumerate(_segments(distance))))]
    for d, s, at, n in steps:
        mask = ((1 << n) - 1) << at
        mask -= (1 << BITS) if mask >= 1 << (BITS - 1) else 0
        hit = F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) == d
        seg = F.when(hit, F.lit(s)) if seg is None else F.when(hit, F.lit(s)).otherwise(seg)
        whole = F.when(hit, F.lit(d == 0)) if whole is None else F.when(hit, F.lit(d == 0)).otherwise(whole)
    return seg, whole


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of different fingerprints in ``fps`` (fp, distinct) at most ``distance`` bits apart."""
    left = _variants(fps, distance, 0).withColumnRenamed("fp", "a")
    right = _variants(fps, distance, 1).withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    seg, whole = _first_common(x, distance)
    same = (left["s"] == right["s"]) & (left["p"] == right["p"]) & (left["rest"] == right["rest"])
    ok = (F.bit_count(x) <= distance) & (seg == left["s"]) & (whole == (left["p"] < 0)) & ((left["p"] >= 0) | (F.col("a") < F.col("b")))
    return left.join(right.hint("merge"), same & ok).select("a", "b")


def _classes(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, class) of every fingerprint in ``fps`` (fp, repeated)."""
    distinct = staged(fps.select("fp").distinct(), "distinct")
    comp = components(links(distinct, distance)).withColumnRenamed("node", "fp")
    return distinct.join(comp.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null or wordless texts have fingerprint 0, which links like any other; repeated
    rows come back as often as they came. A null id gets a row too and never is
    anyone's component; a component with no other id has a null one. Other
    columns are left out, whatever their names. An empty table gives an empty one."""
    fps = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    class_of = _classes(fps, distance)
    reps = staged(fps.groupBy("fp").agg(F.min("id").alias("rep")).join(class_of.hint("merge"), "fp"), "classes")
    least = staged(reps.groupBy("class").agg(F.min("rep").alias("component_id")), "least")
    known = staged(join_hot(reps, least, "class").select("fp", "component_id"), "components")
    return join_hot(fps, known, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@passing_columns
def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the smallest id, and of
    repeated rows one. Rows with a null id give way to others. All columns pass through."""
    row = {"__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(F.col(text_col).cast("string"))}
    marked = docs.withColumns(row)
    rows = marked.select("__id", "__hash", F.col(text_col).cast("string").alias("text"))
    fps = staged(rows.mapInArrow(giving_back(lambda it: _keyed(it, width)), "id long, hash long, fp long"), "simhash")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    best = fps.groupBy("fp").agg(F.min(order).alias("row")).join(_classes(fps.select("fp"), distance).hint("merge"), "fp")
    stay = best.groupBy("class").agg(F.min("row").alias("row")).select("row.id", "row.hash")
    kept = marked.join(stay.hint("merge"), marked["__id"].eqNullSafe(stay["id"]) & (marked["__hash"] == stay["hash"]), "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
