"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Each kind is a pattern. A text is marked at every leftmost non-overlapping match,
cut at the marks, and the pieces' lengths are summed to positions in code points.
The hash of every candidate value is then counted over the corpus by distinct
owner and distinct repository: a value that many owners hold is a copied example,
one that few hold looks like a live credential of theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.llm.common import join_hot, passing_columns, staged, table

OPEN, SHUT, PLAIN = "\ue000", "\ue001", "\ue002"  # marks, and what stands for them in texts that hold them
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Long strings of letters and digits with a digit in them; they count only where few owners hold them.
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{24,}"
#: name, pattern, group that is the value, its least length, a cheap test that no text with a match fails
KINDS = (
    ("assign", ASSIGN, 2, 6, ASSIGN),
    ("access", ACCESS, 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", HEX, 0, 24, r"[0-9a-f]{24}"),
    ("opaque", OPAQUE, 0, 24, OPAQUE),
)
BASE = 3
CHUNK = 256  # matches, and SEGMENT code points, that are put together at once, so that long texts take time in proportion
SEGMENT = 1024
SPAN = "array<struct<start:int,k:int,end:int,h:string>>"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _found(text: Column, k: int) -> Column:
    """Spans of one kind, with the kind and hash of the value. Matches are found first and then dropped if their value is too short."""
    _, pattern, group, least, test = KINDS[k]
    safe = F.translate(text, OPEN + SHUT, PLAIN + PLAIN)
    if group == 0 and pattern in (ACCESS, HEX):  # a run that is too short can be left out at once
        pattern = pattern[:-1] + "{%d,}" % (least - (4 if pattern == ACCESS else 0))
    marked = F.regexp_replace(safe, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}${group}{SHUT}"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        def with_cut(cut: Column) -> Column:
            end = acc["at"] + F.length(cut[0])
            h = F.concat(F.lit(f"{k}:"), F.sha2(cut[1], 256))
            span = F.array(F.struct(acc["at"].alias("start"), F.lit(k).alias("k"), end.alias("end"), h.alias("h")))
            out = F.when(F.length(cut[1]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"])
            return F.struct((end + F.length(cut[2])).alias("at"), out.alias("out"))

        return _let(F.split(part, SHUT, -1), with_cut)

    def spans(parts: Column) -> Column:
        """Chunks of matches with places of their own, moved by the sum of what comes before."""
        last = F.floor((F.size(parts) - 2) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(parts, i * CHUNK + 2, F.lit(CHUNK)), first, step))

        def moved(c: Column) -> Column:
            starts = F.aggregate(c, F.array(F.length(parts[0])), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
            shift = lambda s, by: F.struct((s["start"] + by).alias("start"), s["k"].alias("k"), (s["end"] + by).alias("end"), s["h"].alias("h"))
            return _let(starts, lambda at: F.flatten(F.transform(c, lambda x, i: F.transform(x["out"], lambda s: shift(s, at[i])))))

        return F.when(F.size(parts) > 1, _let(chunks, moved)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(test), _let(F.split(marked, OPEN, -1), spans)).otherwise(F.array().cast(SPAN))


def marked_rows(docs: DataFrame, text_col: str, owner_col: str, repo_col: str, keep: list[str]) -> DataFrame:
    """(row_id, owner, repo, base, extra, ``keep``): spans of the base kinds and of opaque strings."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.concat(*[_found(text, k) for k in range(BASE)]).alias("base"),
        _found(text, BASE).alias("extra"),
        *keep,
    )


def candidates(marked: DataFrame) -> DataFrame:
    """(row_id, owner, repo, start, k, end, h), a row for each span; an opaque string that meets a base span is none."""
    names = ["row_id", "owner", "repo"]
    base = marked.where(F.size("base") > 0).select(*names, F.inline("base"))
    both = marked.where(F.size("extra") > 0).select(*names, F.inline(F.concat("base", "extra")))
    up = Window.partitionBy("row_id").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row_id").orderBy(F.desc("start"), "k").rowsBetween(Window.unboundedPreceding, 0)
    is_base = F.col("k") < BASE
    both = both.withColumn("__reach", F.max(F.when(is_base, F.col("end"))).over(up)).withColumn("__next", F.min(F.when(is_base, F.col("start"))).over(down))
    meets = F.coalesce(F.col("__reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("__next") < F.col("end"), F.lit(False))
    return base.unionByName(both.where((F.col("k") == BASE) & ~meets).drop("__reach", "__next"))


def ownership(found: DataFrame, wide: int, many: int) -> DataFrame:
    """(h, owners, repositories, live) for each candidate hash in ``found`` (h, owner, repo).

    A value in the hands of ``wide`` owners, or in ``many`` repositories whoever owns them, is a copied example."""
    owners = found.select("h", "owner").distinct().groupBy("h").agg(F.count("owner").alias("owners"))
    repos = found.select("h", "repo").distinct().groupBy("h").agg(F.count("repo").alias("repositories"))
    return owners.join(repos, "h").withColumn("live", (F.col("owners") < wide) & (F.col("repositories") < many))


def judged(marked: DataFrame, wide: int, many: int) -> DataFrame:
    """The candidates of staged rows with owners, repositories and live; opaque strings only if live."""
    each = staged(candidates(marked), "candidates")
    known = staged(ownership(each, wide, many), "ownership")
    return join_hot(each, known, "h").where((F.col("k") < BASE) | F.col("live"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide: int = 3, many: int = 30) -> DataFrame:
    """(row_id, doc_id, spans) for every row: spans an array of (start, k, end, owners,
    repositories, live) in order; opaque strings stay only if live.

    ``wide`` owners, or ``many`` repositories, make a value a copied example. Null
    texts are empty and have no spans; a null owner or repository counts as none, so
    a value without known owner is live unless it is in many repositories. Repeated rows each get a row. Other columns
    are left out, whatever their names. An empty table gives an empty one. Time grows with the length of a text, however many matches it has."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(owner_col).alias("own"), F.col(repo_col).alias("in"))
    rows = staged(marked_rows(given, "text", "own", "in", ["doc_id"]), "spans")
    back = judged(rows, wide, many).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "owners", "repositories", "live"))).alias("spans"))
    kind = "array<struct<start:int,k:int,end:int,owners:bigint,repositories:bigint,live:boolean>>"
    return rows.select("row_id", "doc_id").join(back, "row_id", "left").select("row_id", "doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(found: DataFrame) -> DataFrame:
    """What :func:`scan` found, as counts, a digest of the base spans, and all spans as a string."""
    spans = F.col("spans")
    n = lambda test: F.size(F.filter(spans, test)).cast("long")
    of_kind = lambda k: n(lambda s: s["k"] == k)
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(_joined(F.filter(spans, lambda s: s["k"] < BASE)), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: ~s["live"]).alias("n_example"),
    )


def _without(text: Column, cuts: Column, mask: str) -> Column:
    """``text`` with each of ``cuts`` (start, end; in order, apart) replaced by ``mask``, put together from segments."""

    def piece(segments: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / SEGMENT).cast("int"), F.floor((end - 1) / SEGMENT).cast("int")
        some = F.array_join(F.slice(segments, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(some, start % SEGMENT + 1, end - start)).otherwise("")

    def build(x: Column) -> Column:
        n = F.size(x["cuts"])
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["cuts"], i - 1)["end"])
        end = lambda i: F.when(i == n, x["n"]).otherwise(F.get(x["cuts"], i)["start"])
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: piece(x["segments"], start(i), end(i))), mask)

    segments = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % SEGMENT), F.lit(0))
    return _let(F.struct(segments.alias("segments"), cuts.alias("cuts"), F.length(text).alias("n")), build)


@passing_columns
def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide: int = 3, many: int = 30, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live secret in the text replaced by ``mask``, those that overlap by one; copied examples
    stay. All rows and columns are kept, repeated rows each on their own; a null text stays null, an empty table empty."""
    cols = docs.columns
    may = F.lit(False)
    for kind in KINDS:
        may = may | F.coalesce(F.col(text_col).cast("string").rlike(kind[4]), F.lit(False))
    has = staged(marked_rows(docs.where(may), text_col, owner_col, repo_col, cols), "secrets")
    order = Window.partitionBy("row_id").orderBy("start", "end", "k")
    live = judged(has, wide, many).where("live").select("row_id", "start", "end", "k")
    live = live.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    live = live.withColumn("cut", F.sum(F.when(F.col("start") >= F.coalesce("before", F.lit(0)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = live.groupBy("row_id", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = cuts.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    text = F.col(text_col).cast("string")
    fixed = has.join(cuts, "row_id", "left").withColumn(text_col, F.when(F.col("cuts").isNotNull(), _without(text, F.col("cuts"), mask)).otherwise(text)).select(*cols)
    return docs.where(~may).unionByName(fixed)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))
