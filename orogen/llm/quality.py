"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Text is read as code points, with one symbol for a word that repeats the word before
it. Documents are packed into batches once, and batches are what travels. Each batch lists its
distinct n-grams, with how often trusted texts hold them; these are summed into count
tables, which are sharded by n-gram and grow with the corpus. Joins of n-grams with
their contexts give the discounted weights, joins of the weights with the corpus's distinct n-grams give
the probabilities, and those go back to the batches that asked for them, where each document is
scored in one pass. Thresholds are quantiles of each language over trusted documents that
the model was not fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import bucket_count, bucket_of, discard, giving_back, passing_columns, staged, staged_by, table

ORDER = 4
EDGE, AGAIN, POINTS = 0x110000, 0x110001, 0x110002
POINT_BITS = 21
BATCH_CHARS, CHUNK = 8 << 20, 1 << 18  # a worker holds a batch and some arrays of a chunk; an executor holds two workers beside its heap
FRACTION = 2.0**26  # logs travel as whole numbers of this fraction
SEQ_BITS = 32
QUANTILE, MARGIN = 0.95, 1.45


def symbols(text: str) -> np.ndarray:
    """The whole text with edges; a word equal to the word before becomes one symbol with the space between."""
    words = text.replace("\x1a", " ").split(" ")
    text = "".join([" " + b if a != b else "\x1a" for a, b in zip([None, *words], words)])[1:]  # noqa: B905
    body = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    body = np.where(body == 0x1A, AGAIN, body).astype(np.uint32)
    return np.concatenate([np.full(ORDER - 1, EDGE, np.uint32), body, np.full(1, EDGE, np.uint32)])


class Batch:
    """Symbols of some texts, with an alphabet of their own so that an n-gram fits 64 bits; ``full`` if they have too many symbols for that."""

    def __init__(self, texts: list[str]):
        self.place = np.zeros(POINTS, np.uint16)
        self.alphabet = np.full(1, 0, np.int64)
        self.codes, at, sizes, self.full = np.empty(sum(len(t) + ORDER for t in texts), np.uint16), 0, [], False
        for t in texts:
            s = symbols(t)
            new = np.unique(s[self.place[s] == 0])
            self.full = len(self.alphabet) + len(new) > 0xFFFF
            if self.full:
                break
            self.place[new] = np.arange(len(self.alphabet), len(self.alphabet) + len(new))
            self.alphabet = np.concatenate([self.alphabet, new])
            self.codes[at : at + len(s)] = self.place[s]
            at += len(s)
            sizes.append(len(s))
        self.sizes, self.codes = np.array(sizes, np.int64), self.codes[:at]
        self.ends = np.cumsum(self.sizes)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(n-gram, text that it is of) of texts that aren't empty, some at a time."""
        n = len(self.codes) - ORDER + 1
        for at in range(0, n, CHUNK):
            end = min(n, at + CHUNK)
            key = np.zeros(end - at, np.uint64)
            for j in range(ORDER):
                key = (key << np.uint64(16)) | self.codes[at + j : end + j]
            doc = np.searchsorted(self.ends, np.arange(at, end + ORDER - 1), "right")
            inside = (doc[: end - at] == doc[ORDER - 1 :]) & (self.sizes[doc[: end - at]] > ORDER)
            yield key[inside], doc[: end - at][inside]

    def spelled(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, last symbol) of n-grams as code points."""
        at = [self.alphabet[((key >> np.uint64(16 * (ORDER - 1 - j))) & np.uint64(0xFFFF)).astype(np.int64)] for j in range(ORDER)]
        context = np.zeros(len(key), np.int64)
        for p in at[:-1]:
            context = (context << POINT_BITS) | p
        return context, at[-1].astype(np.int32)

    def keys(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        key = np.zeros(len(context), np.uint64)
        for j in range(ORDER - 2, -1, -1):
            key = (key << np.uint64(16)) | self.place[(context >> (POINT_BITS * j)) & ((1 << POINT_BITS) - 1)]
        return (key << np.uint64(16)) | self.place[last]


def split_batch(texts: list[str]) -> Iterator[tuple[int, Batch]]:
    """The texts as one batch, or as several where their alphabet is too large; each with the place of its first text."""
    todo = [(0, texts)]
    while todo:
        at, some = todo.pop()
        b = Batch(some)
        if b.full and len(some) > 1:
            half = len(some) // 2
            todo += [(at + half, some[half:]), (at, some[:half])]
            continue
        yield at, b


def _stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _table(data: pa.BinaryScalar) -> pa.Table:
    with pa.ipc.open_stream(data.as_buffer()) as r:
        return r.read_all().combine_chunks()


def packed(docs: DataFrame, names: tuple[str, str, str], others: list[str]) -> DataFrame:
    """(batch, ids, texts, rest): documents in batches of about ``BATCH_CHARS``; ids in order, the columns ``names`` (id, language, text)
    and the columns ``others`` as compressed streams. A task's batches have numbers of one bucket, so that they go to one file."""
    buckets = bucket_count(docs.sparkSession)
    id_col, lang_col, text_col = names
    mine = [F.col(id_col).cast("long").alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size = TaskContext.get().partitionId(), [], 0
        numbers = (int(k) for at in range(0, 1 << SEQ_BITS, CHUNK) for k in (task << SEQ_BITS) + at + np.flatnonzero(bucket_of((task << SEQ_BITS) + at + np.arange(CHUNK), buckets) == task % buckets))

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            t = pa.Table.from_batches(held)
            ids = t.column(0).combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            cols = [pa.array([next(numbers)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_stream(t.select([0, 1, 2]))], pa.binary()), pa.array([_stream(t.select(list(range(3, t.num_columns))))], pa.binary())]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(cols, names=["batch", "ids", "texts", "rest"])

        for b in batches:
            lengths = np.diff(np.concatenate([[0], np.cumsum([len(t.as_py() or "") + 1 for t in b.column(2)])]))
            at = 0
            while at < b.num_rows:
                room = np.cumsum(lengths[at:]) <= BATCH_CHARS - size
                n = int(room.sum()) or (0 if held else 1)
                if n:
                    held.append(b.slice(at, n))
                    size += int(lengths[at : at + n].sum())
                    at += n
                if at < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    return docs.select(*mine, *others).mapInArrow(giving_back(run), "batch long, ids array<long>, texts binary, rest binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, part, context, last, c): the distinct n-grams of each batch, and how often the texts at ``fit`` hold them."""
    for b in batches:
        for x in range(b.num_rows):
            texts = [t or "" for t in _table(b.column(1)[x]).column(2).to_pylist()]
            learn = np.zeros(len(texts), bool)
            learn[np.array(b.column(2)[x].as_py() or [], np.int64)] = True
            for at, some in split_batch(texts):
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
                for key, doc in some.grams():
                    got, back = np.unique(key, return_inverse=True)
                    c = np.bincount(back, weights=learn[at + doc], minlength=len(got)).astype(np.int64)
                    keys, back = np.unique(np.concatenate([keys, got]), return_inverse=True)
                    counts = np.bincount(back, weights=np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
                context, last = some.spelled(keys)
                order = np.lexsort((last, context))
                for s in range(0, len(keys), 100_000):
                    o = order[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), b.column(0)[x].as_py())), pa.array(np.full(len(o), at, np.int32)), pa.array(context[o]), pa.array(last[o]), pa.array(counts[o])], names=["batch", "part", "context", "last", "c"])


Fitted = tuple[list[DataFrame], list[DataFrame], int, list[DataFrame]]


def fit(counts: DataFrame) -> Fitted:
    """For each order (context, last, alpha) and (context, gamma) of the model, from (context, last, c) of the highest; the number of symbols; staged tables.

    Lower orders count the different symbols seen before an n-gram. Each order has its own
    three discounts from its counts of counts. All tables are sharded by n-gram or context."""
    level = counts.select("context", "last", "c")
    levels = level.withColumn("n", F.lit(ORDER))
    for n in range(ORDER - 1, 0, -1):
        tail = F.col("context").bitwiseAND((1 << (POINT_BITS * (n - 1))) - 1)
        level = level.groupBy(tail.alias("context"), "last").agg(F.count(F.lit(1)).alias("c"))
        levels = levels.unionByName(level.withColumn("n", F.lit(n)))
    levels = staged(levels, "ngrams")
    seen = {(r["n"], r["c"]): r["k"] for r in levels.where("c <= 4").groupBy("n", "c").agg(F.count(F.lit(1)).alias("k")).collect()}
    alphas, gammas, used = [], [], [levels]
    for n in range(1, ORDER + 1):
        k = [seen.get((n, i), 0) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.5
        d = [min(float(i), max(0.0, i - (i + 1) * y * k[i] / k[i - 1])) if k[i - 1] else 0.0 for i in (1, 2, 3)]
        one = levels.where(F.col("n") == n).drop("n").withColumn("off", F.element_at(F.array(*map(F.lit, d)), F.least(F.col("c"), F.lit(3)).cast("int")))
        by = staged(one.groupBy("context").agg(F.sum("c").alias("all"), F.sum("off").alias("left")), f"contexts{n}")
        used.append(by)
        alphas.append(one.join(by, "context").select("context", "last", ((F.col("c") - F.col("off")) / F.col("all")).alias("alpha")))
        gammas.append(by.select("context", (F.col("left") / F.col("all")).alias("gamma")))
    return alphas, gammas, levels.where("n = 1").count() + 1, used  # one more symbol for all that was never seen


def probabilities(asked: DataFrame, model: Fitted) -> tuple[DataFrame, list[DataFrame]]:
    """(context, last, logp) of n-grams (context, last): each order's weight, and what its context leaves to the order below; and the staged tables that this reads.

    Tables of one symbol have 1,114,114 rows at most and go to all tasks; the others are merged by n-gram."""
    alphas, gammas, size, used = model
    q = asked.withColumn("p", F.lit(1.0 / size))
    for n in range(1, ORDER + 1):
        tail = F.col("context").bitwiseAND((1 << (POINT_BITS * (n - 1))) - 1)
        used.append(staged(alphas[n - 1], f"alpha{n}"))
        a = used[-1].select(F.col("context").alias("__c"), F.col("last").alias("__l"), "alpha")
        g = gammas[n - 1].select(F.col("context").alias("__g"), "gamma")
        q = q.withColumn("__tail", tail)
        q = q.join(F.broadcast(a) if n == 1 else a, (q["__tail"] == a["__c"]) & (q["last"] == a["__l"]), "left")
        q = q.join(F.broadcast(g) if n <= 2 else g, q["__tail"] == g["__g"], "left")
        q = q.select("context", "last", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return q.select("context", "last", F.log("p").alias("logp")), used


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, at, id, lang, ppl) of each document, null for an empty text; from (batch, texts, known)."""
    for b in batches:
        for x in range(b.num_rows):
            t = _table(b.column(1)[x])
            texts, t = [s or "" for s in t.column(2).to_pylist()], t.select([0, 1])
            known = b.column(2)[x].values
            context, rest = (np.asarray(known.field(i)) for i in range(2)) if known is not None else (np.empty(0, np.int64),) * 2
            part, last, logp = rest >> 53, (rest >> 32) & ((1 << POINT_BITS) - 1), (rest & 0xFFFFFFFF) / -FRACTION
            sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
            for at, some in split_batch(texts):
                mine = part == at
                keys = some.keys(context[mine], last[mine])
                order = np.argsort(keys)
                keys, logs = keys[order], logp[mine][order]
                for key, doc in some.grams():
                    v = logs[np.searchsorted(keys, key)]
                    sums[at : at + len(some.sizes)] += np.bincount(doc, weights=v, minlength=len(some.sizes))
                    counts[at : at + len(some.sizes)] += np.bincount(doc, minlength=len(some.sizes))
            ppl = [math.exp(-s / c) if c else None for s, c in zip(sums.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), b.column(0)[x].as_py())), pa.array(np.arange(len(texts), dtype=np.int32)), t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array(ppl, pa.float64())], names=["batch", "at", "id", "lang", "ppl"])


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, margin: float, held: int, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """The packed documents, and (batch, at, id, lang, ppl, most, keep) for each."""
    batches = staged_by(packed(docs, (id_col, lang_col, text_col), others), "batches", "batch")  # texts stay in their buckets from here on
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q")).where("q = 1").select("id")
    ids = batches.select("batch", F.posexplode("ids").alias("at", "id")).where("id is not null")
    # labels grow with the corpus, so they are merged at every size and never sent to all tasks
    trusted = staged(ids.join(good.hint("merge"), "id").select("batch", "at", (F.pmod(F.xxhash64("id"), F.lit(held)) == 0).alias("held")), "trusted")
    learn = trusted.where("not held").groupBy("batch").agg(F.collect_list("at").alias("fit"))  # a batch has a bound on its documents
    grams = staged(batches.select("batch", "texts").join(staged(learn, "fit"), "batch", "left").select("batch", "texts", "fit").mapInArrow(giving_back(_counted), "batch long, part int, context long, last int, c long"), "grams")
    counts = staged(grams.groupBy("context", "last").agg(F.sum("c").alias("c")), "counts")
    learned = counts.where("c > 0")
    if not learned.take(1):
        scores = batches.select("batch", F.posexplode("ids").alias("at", "id"))
        return batches, scores.select("batch", "at", "id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("ppl"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("boolean").alias("keep"))
    model = fit(learned)
    asked, used = probabilities(counts.select("context", "last"), model)
    logs = staged(asked, "probabilities")
    discard(counts, *used)
    rest = F.shiftleft(F.col("part").cast("long"), 53).bitwiseOR(F.shiftleft(F.col("last").cast("long"), 32)).bitwiseOR(F.round(F.greatest(-F.col("logp"), F.lit(0.0)) * FRACTION).cast("long"))
    known = grams.drop("c").join(logs, ["context", "last"]).groupBy("batch").agg(F.collect_list(F.struct("context", rest.alias("rest"))).alias("known"))
    scores = staged(batches.select("batch", "texts").join(known, "batch", "left").select("batch", "texts", "known").mapInArrow(giving_back(_scored), "batch long, at int, id long, lang string, ppl double"), "scores")
    discard(grams, logs)
    q = lambda held: F.percentile_approx(F.when(held, F.col("ppl")), F.lit(quantile), F.lit(10_000)) * margin
    own = F.coalesce(q(F.col("held")), q(F.lit(True)))
    with_trust = scores.join(trusted, ["batch", "at"])
    overall = with_trust.agg(own.alias("most")).first()["most"]
    by = staged(with_trust.groupBy(F.col("lang").alias("__lang")).agg(own.alias("most")), "thresholds")
    out = scores.join(by, scores["lang"].eqNullSafe(by["__lang"]), "left").drop("__lang").withColumn("most", F.coalesce("most", F.lit(overall)))
    return batches, out.withColumn("keep", F.coalesce(F.col("ppl") <= F.col("most"), F.lit(False)))


@passing_columns
def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, held: int = 5) -> DataFrame:
    """``docs`` with ``__ppl``, ``__most`` and ``__keep``.

    Trusted: documents that ``labels`` (doc_id, quality) names with quality 1 and never with
    another or null one. One in ``held`` of them, by a hash of the id, is kept out of the model. A document is kept if its perplexity is at most
    ``margin`` times its language's ``quantile`` over the trusted documents kept out, or over all of its trusted ones where none was; a null language is one of its own, and
    a language without any takes the quantile over all. Null and empty texts have a null perplexity and are not kept.
    With nothing trusted all other texts are kept. Repeated rows are judged alike, an
    empty table gives an empty one, and other columns pass through untouched."""
    others = [c for c in docs.columns if c != text_col or docs.schema[c].dataType.simpleString() != "string"]  # the text travels once
    batches, scores = judged(docs, labels, id_col, text_col, lang_col, quantile, margin, held, others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __ppl double, __most double, __keep boolean"
    names = [*docs.columns, "__ppl", "__most", "__keep"]
    places = [others.index(c) if c in others else -1 for c in docs.columns]

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in range(b.num_rows):
                texts, rows = _table(b.column(0)[x]), _table(b.column(1)[x])
                got = sorted(b.column(2)[x].as_py(), key=lambda r: r["at"])
                cols = [(rows.column(i) if i >= 0 else texts.column(2)).combine_chunks() for i in places] + [pa.array([r[k] for r in got], t) for k, t in (("ppl", pa.float64()), ("most", pa.float64()), ("keep", pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    verdicts = scores.groupBy("batch").agg(F.collect_list(F.struct("at", "ppl", "most", "keep")).alias("rows"))
    out = batches.select("batch", "texts", "rest").join(staged(verdicts, "verdicts"), "batch").select("texts", "rest", "rows").mapInArrow(giving_back(unpack), schema)
    return out.withColumn("__keep", F.coalesce("__keep", F.coalesce(F.length(F.col(text_col).cast("string")) > 0, F.lit(False))))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    _, scores = judged(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "lang", QUANTILE, MARGIN, 5, [])
    return scores.select(F.col("id").alias("doc_id"), "lang", F.round("ppl", 6).alias("perplexity"), F.round("most", 6).alias("threshold"), "keep")
