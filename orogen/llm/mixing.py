"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells of source, language and topic. The tokens to draw from the cells are
raked to the target of each source, language and topic in turn, several rounds
over, and never beyond what a cell holds, so what is raked is what can be drawn. A cell's
tokens to draw over its tokens are its sampling probability, and a
document is drawn by a keyed hash of its id.

Topics come from the corpus: its marker words are those in the most documents without
being in too many of them, and a text's topic is the marker word that it uses most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import discard, passing_columns, staged, table

DIMS = ("source", "lang", "topic")
#: Exponents of the natural token shares that give the target shares where none are given: below one, the rare gain.
ALPHA = {"source": 0.5, "lang": 0.9, "topic": 1.0}
ROUNDS, CAPS, BUDGET, SEED = 10, 4, 0.5, 17
TOPICS, MOST_DOCS = 12, 0.1
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x60\x7B-\x7F]{5,}"  # of letters a to z and whatever isn't ASCII, after A to Z are made small
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = "other"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def marker_words(texts: DataFrame, text_col: str, topics: int, most: float) -> list[str]:
    """The ``topics`` words of five letters or more that are in the most documents, of those in no more than ``most`` of all."""
    n = texts.count()
    df = texts.select(F.explode(F.array_distinct(_terms(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("word")).groupBy("word").count()
    return [r["word"] for r in df.where(F.col("count") <= F.lit(most) * F.lit(n)).orderBy(F.desc("count"), "word").limit(topics).collect()]


def topic_by(markers: list[str]) -> Callable[[Column], Column]:
    """The topic of a text: the marker word that it uses most, the more widespread one at a tie, else ``other``."""
    if not markers:
        return lambda text: F.lit(OTHER)

    def best(hits: Column) -> Column:
        each = [F.struct(F.size(F.filter(hits, lambda w: w == m)).alias("n"), F.lit(-i).alias("r"), F.lit(m).alias("m")) for i, m in enumerate(markers)]  # noqa: B023
        return F.when(F.size(hits) > 0, F.array_max(F.array(*each))["m"]).otherwise(OTHER)

    return lambda text: F.transform(F.array(F.filter(_terms(text), lambda w: w.isin(markers))), best)[0]


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_of: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))  # noqa: E731  a null is a value of its own
    return docs.select("*", name(source_col).alias("__source"), name(lang_col).alias("__lang"), topic_of(text).alias("__topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("__tokens"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__key"))


def goals(cells: DataFrame, dim: str, budget: float, alpha: float, weights: dict[str, float] | None, caps: int) -> DataFrame:
    """(dim, goal): tokens to draw of each value. None gets more than it has; what it cannot take
    goes to the others in proportion, ``caps`` times over."""
    by = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    if weights is None:
        by = by.withColumn("p", F.pow("t", F.lit(alpha)))
    else:
        given = cells.sparkSession.createDataFrame([("null" if k is None else k if dim == "topic" else f"={k}", float(v)) for k, v in weights.items()], f"{dim} string, p double")
        by = by.join(F.broadcast(given), dim, "left").na.fill(0.0, ["p"])  # as many rows as there are weights
    whole = by.agg(F.sum("p")).first()[0]
    scale = budget / whole if whole else 0.0
    for _ in range(caps):
        full = F.col("p") * F.lit(scale) >= F.col("t")
        got = by.agg(F.sum(F.when(full, F.col("t")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("p"))).alias("rest")).first()
        if not got["rest"]:
            break
        scale = (budget - got["taken"]) / got["rest"]
    return by.select(dim, F.least(F.col("t"), F.col("p") * F.lit(scale)).alias("goal"))


def rake(cells: DataFrame, budget: float, alpha: dict[str, float], targets: dict[str, dict[str, float]], rounds: int, caps: int) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``draw``: tokens to draw, at most those that there are.

    Each step brings one dimension's sums to its goals: all cells of a value shrink alike, or those that are not
    full grow alike, up to full. Sums are grouped with partial sums and joined back, so that a source or
    language with a great many cells is never in one task."""
    w = cells.where("tokens > 0").withColumn("draw", F.col("tokens").cast("double"))
    for d in DIMS:
        w = w.join(goals(cells, d, budget, alpha[d], targets.get(d), caps).withColumnRenamed("goal", f"goal_{d}"), d)
    w = staged(w, "weights")
    n, x = F.col("tokens").cast("double"), F.col("draw")
    full = x >= n
    for _ in range(rounds):
        for d in DIMS:  # written each time: a step reads the cells twice, and steps on steps would double that
            now = w.groupBy(d).agg(F.sum("draw").alias("now"), F.sum(F.when(full, n).otherwise(0.0)).alias("stay"), F.sum(F.when(full, 0.0).otherwise(x)).alias("grow"))
            goal = F.col(f"goal_{d}")
            more = F.when(full | (F.col("grow") <= 0), x).otherwise(F.least(n, x * (goal - F.col("stay")) / F.col("grow")))
            after = staged(w.join(now, d).withColumn("draw", F.when(F.col("now") > goal, x * goal / F.col("now")).otherwise(more)).drop("now", "stay", "grow"), "raked")
            discard(w)
            w = after
    return w


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a keyed hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")
    return bits / F.lit(2.0**52)


def _drawn(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] = ALPHA, rounds: int = ROUNDS, caps: int = CAPS, fraction: float = BUDGET, seed: int = SEED) -> DataFrame:
    """``rows``, of which cells have been made, with ``__probability`` and ``__sampled``. They are read twice."""
    names = {f"__{d}": d for d in DIMS}
    cells = staged(rows.groupBy(*[F.col(a).alias(b) for a, b in names.items()]).agg(F.sum("__tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    raked = rake(cells, fraction * total, alpha, targets or {}, rounds, caps)
    p = raked.select(*[F.col(d).alias(f"__{d}") for d in DIMS], (F.col("draw") / F.col("tokens")).alias("__probability"))
    out = rows.join(p, list(names), "left").withColumn("__probability", F.coalesce("__probability", F.lit(0.0)))
    return out.withColumn("__sampled", uniform(F.col("__key"), seed) < F.col("__probability"))


@passing_columns
def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of: Callable[[Column], Column] | None = None, topics: int = TOPICS, most_docs: float = MOST_DOCS,
    targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] = ALPHA, rounds: int = ROUNDS, caps: int = CAPS, fraction: float = BUDGET, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``__topic``, ``__tokens``, ``__probability`` and ``__sampled`` for every row.

    ``targets`` gives weights by dimension (source, lang, topic) and value; values that it leaves out get none. A dimension
    that it leaves out gets the natural token shares of all documents to the power ``alpha``. The
    budget is ``fraction`` of all tokens. ``topic_of`` replaces the marker words. Targets that contradict one another or
    ask for more than there is are met as far as can be. Null sources and languages are values of their own; null texts are
    empty and have topic ``other``. A cell without tokens has probability 0. A repeated row is drawn with its twins, as is a
    null id with other null ids. Other columns pass through; an empty table gives an empty one."""
    rows = _rows(docs, id_col, text_col, source_col, lang_col, topic_of or topic_by(marker_words(docs, text_col, topics, most_docs)))
    out = _drawn(rows, targets, alpha, rounds, caps, fraction, seed)
    return out.select(*docs.columns, "__topic", "__tokens", "__probability", "__sampled")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`mix`. The result has no texts, so topics and tokens are staged and texts are read twice, not three times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows = _rows(docs, "doc_id", "text", "source", "lang", topic_by(marker_words(docs, "text", TOPICS, MOST_DOCS)))
    got = _drawn(staged(rows.drop("text"), "rows"))
    return got.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"))


def _sql() -> str:
    sql = [
        f"""with d as (select doc_id, coalesce('=' || source, 'null') as source, coalesce('=' || lang, 'null') as lang, cast(len(regexp_extract_all(t, '{WORD}')) as bigint) as tokens,
        regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{TERM}') as words from (select *, coalesce(text, '') as t from documents)),
        f as (select word, count(*) as df from (select unnest(list_distinct(words)) as word from d) group by word),
        m as materialized (select word, row_number() over (order by df desc, word) as place from f where df <= {MOST_DOCS} * (select count(*) from documents) qualify place <= {TOPICS}),
        top as (select doc_id, word as topic from (select doc_id, word, place, count(*) as n from (select doc_id, unnest(words) as word from d) join m using (word) group by all) qualify row_number() over (partition by doc_id order by n desc, place) = 1),
        r as (select doc_id, source, lang, coalesce(topic, '{OTHER}') as topic, tokens from d left join top using (doc_id)),
        cells as (select source, lang, topic, cast(sum(tokens) as double) as tokens from r group by all),
        total as (select {BUDGET} * sum(tokens) as b from cells)"""
    ]
    for d in DIMS:
        sql.append(f"n_{d} as materialized (select {d}, sum(tokens) as t, pow(sum(tokens), {ALPHA[d]}) as p from cells group by all having sum(tokens) > 0)")
        sql.append(f"k_{d}_0 as materialized (select any_value(b) / sum(p) as scale from n_{d}, total)")
        for i in range(CAPS):
            full = "p * scale >= t"
            sql.append(f"k_{d}_{i + 1} as materialized (select coalesce((any_value(b) - sum(case when {full} then t else 0 end)) / nullif(sum(case when {full} then 0 else p end), 0), any_value(scale)) as scale from n_{d}, total, k_{d}_{i})")
        sql.append(f"goal_{d} as materialized (select {d}, least(t, p * scale) as goal from n_{d}, k_{d}_{CAPS})")
    sql.append("w0 as materialized (select *, tokens as draw from cells where tokens > 0)")
    last = "w0"
    for i in range(ROUNDS):
        for d in DIMS:
            name = f"w{i + 1}_{d}"
            sql.append(f"""{name} as materialized (select source, lang, topic, tokens, case when now > goal then draw * goal / now when draw >= tokens or grow <= 0 then draw else least(tokens, draw * (goal - stay) / grow) end as draw
                from (select *, sum(draw) over v as now, sum(case when draw >= tokens then tokens else 0 end) over v as stay, sum(case when draw >= tokens then 0 else draw end) over v as grow from {last} join goal_{d} using ({d}) window v as (partition by {d})))""")
            last = name
    return ", ".join(sql) + f""" select doc_id, topic, tokens, round(coalesce(draw / w.tokens, 0), 6) as probability,
        cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) / pow(2.0, 52) < coalesce(draw / w.tokens, 0) as sampled
        from r left join (select source, lang, topic, tokens as n, draw from {last}) w0 using (source, lang, topic)""".replace("w.tokens", "n")


OP4_SQL = _sql()
