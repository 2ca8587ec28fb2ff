"""The training-data operators against brute force, exact round trips and SQL, with odd rows."""

import glob
import hashlib
import math
import os
import re
import subprocess
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from orogen.llm import catalog, common, cosine, html, langid, mixing, pieces, quality, secrets, simhash, topk
from orogen.llm.common import bucket_of, staged_by

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string, __key string"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, "x", "y", "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = "word and other words " * 4000
    rows = [(1, "the quick brown fox jumps over", "en", "a"), (1, "the quick brown fox jumps over", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "the Quick brown fox jumps over", "de", "a"), (5, long, "en", "a"), (6, " \t\n ", None, "b"), (7, "▁ x  y", "fr", "")]
    return docs_of(spark, rows)


def everything(odd, spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 1), (3, None)], "doc_id long, quality int")
    return {
        "tokens": lambda d: pieces.token_counts(d),
        "pieces": lambda d: pieces.encode(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "mix": lambda d: mixing.mix(d),
        "secrets": lambda d: secrets.report(secrets.scan(d)),
        "redact": lambda d: secrets.redact(d),
        "langid": lambda d: langid.identify(d),
        "quality": lambda d: quality.classify(d, labels),
    }


@pytest.mark.parametrize("name", ["tokens", "pieces", "simhash", "mix", "secrets", "redact", "langid", "quality"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = everything(odd, spark)[name]
    rows = run(odd).collect()
    assert len(rows) == odd.count()
    assert run(odd.limit(0)).collect() == []
    ones = [tuple(r) for r in rows if r["doc_id"] == 1]
    assert len(ones) == 2 and repr(ones[0]) == repr(ones[1])
    by = {r["doc_id"]: r for r in rows}
    nothing = {
        "tokens": lambda r: r["n_tokens"] == 0,
        "pieces": lambda r: r["ids"] == [] and r["lossless"],
        "simhash": lambda r: r["fingerprint"] == "0" * 16 and r["component_id"] == 2,
        "mix": lambda r: r["__tokens"] == 0 and r["__probability"] == 0 and not r["__sampled"] and r["__topic"] == "other",
        "secrets": lambda r: r["spans"] == "" and r["n_hex"] == 0,
        "redact": lambda r: not r["text"],
        "langid": lambda r: r["lang_pred"] == "und" and r["score"] == 0,
        "quality": lambda r: r["__ppl"] is None and not r["__keep"],
    }[name]
    assert nothing(by[2]) and nothing(by[3])
    if name in ("mix", "redact", "quality"):  # columns with clashing names come through
        kept = sorted((repr(r["doc_id"]), r["fp"], r["spans"], r["n_chars"]) for r in rows)
        assert kept == sorted((repr(r["doc_id"]), r["fp"], r["spans"], r["n_chars"]) for r in odd.collect())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in got.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def slow_fingerprint(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash_equals_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in simhash.op3_simhash_near_dedup(spark, sf).collect()}
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    assert {k: format(v, "016x") for k, v in fp.items()} == {k: r["fingerprint"] for k, r in got.items()}
    comp = {k: k for k in fp}
    for _ in fp:
        new = {a: min(comp[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4) for a in fp}
        if new == comp:
            break
        comp = new
    assert comp == {k: r["component_id"] for k, r in got.items()}


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = set(base)
    for b in base:
        for d in range(1, 7):
            v = b
            for bit in rng.choice(64, d, replace=False):
                v ^= 1 << int(bit)
            fps.add(v)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_one_document_of_a_group_stays(spark, odd):
    kept = simhash.deduplicated(odd).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and None not in ids and len({2, 3, 6} & set(ids)) == 1 and 5 in ids


def plans_of(spark, run):
    """What ``run`` gives, and the plans of all its executions."""
    jsc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    jsc.listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    got = run()
    jsc.listenerBus().waitUntilEmpty()
    found = store.executionsList()
    return got, [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]


def near_copies(spark):
    text = " ".join(f"word{i}" for i in range(400))
    return docs_of(spark, [(i, text.replace("word7 ", f"word{i} "), "en", "s") for i in range(40)])


def test_simhash_sends_no_table_to_all_tasks(spark):
    got, plans = plans_of(spark, simhash.near_duplicates(near_copies(spark)).collect)
    assert len(got) == 40 and len({r["component_id"] for r in got}) < 20
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_one_document_of_a_group_stays_without_sending_tables_to_all_tasks(spark):
    got, plans = plans_of(spark, simhash.deduplicated(near_copies(spark), width=5, distance=6).collect)
    assert len(got) < 20 and 0 in {r["doc_id"] for r in got}
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_assignments_are_found_before_short_ones_are_dropped(spark):
    texts = ["secret:token = abcdef1", "pass PassWord=\"abcdef\" token: abc", "AKIA" + "B" * 16 + " AKIA123", "f" * 23 + " " + "0123456789abcdef" * 2]
    found = secrets.report(secrets.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))).orderBy("doc_id").collect()
    at = texts[1].index("PassWord")
    base = ["", f"assign:{at}:{at + 16}", "access:0:20", "hex:24:56"]
    assert [r["spans"].split(",opaque")[0] for r in found] == base
    assert [r["base_sha256"] for r in found] == [hashlib.sha256(b.encode()).hexdigest() for b in base]


def test_copied_examples_are_kept_and_live_secrets_masked(spark):
    common, own = "0123456789abcdef01234567", "fedcba9876543210fedcba98"
    rows = [(i, f"key {common} end", "en", f"s{i}") for i in range(4)] + [(9, f"my {own}", "en", "s1")]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(spark, rows)).collect()}
    assert out[0] == f"key {common} end" and out[9] == "my [SECRET]"


def test_a_value_in_many_repositories_is_an_example(spark):
    v = "0123456789abcdef01234567"
    few = secrets.report(secrets.scan(docs_of(spark, [(i, v, "en", "one") for i in range(29)]))).agg(F.sum("n_live")).first()[0]
    many = secrets.report(secrets.scan(docs_of(spark, [(i, v, "en", "one") for i in range(30)]))).agg(F.sum("n_live")).first()[0]
    assert few == 29 and many == 0


def slow_spans(text):
    kinds = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    base = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
    extra = [(m.start(), 3, m.end(), "opaque") for m in re.finditer(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{24,}", text)]
    free = [e for e in extra if not any(b[0] < e[2] and e[0] < b[2] for b in base)]
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(base + free))


def test_long_texts_with_many_matches(spark):
    rng = np.random.default_rng(4)
    token = lambda n: "".join(rng.choice(list("abcdefxyzXYZ0123456789"), n))
    parts = [f"secret = {token(12)} é" if i % 3 else token(30) + " \U0001f600" for i in range(6000)]
    texts = [" ".join(parts), "token: " + "0a" * 20 + "-x " + "f" * 30 + "_" + token(5), "a\ue000b\ue001" + "ab1" * 10]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = secrets.report(secrets.scan(df)).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == [slow_spans(t) for t in texts]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for x in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in slow_spans(t).split(","))):
            if x[0] >= at:
                out += [t[at : x[0]], "[SECRET]"]
            at = max(at, x[1])
        assert clean[i] == "".join([*out, t[at:]])


def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.vocabulary(pieces.MODEL)
    texts = ["Hello  there world", " lead", "trail ", "a\nb\tc", "日本語 ☃ é", "x" * 120, "unbelievable tokenization of internationalization"]
    plain = pieces.MergeDropout(v, 1, 0.0, 4)
    split = [pieces.words(t) for t in texts]
    plain.learn(split, [0] * len(texts))
    assert [plain.encode(w, 0).tolist() for w in split] == [sp.encode(t) for t in texts]
    loose = pieces.MergeDropout(v, 1, 0.3, 4)
    ws = sorted({w for s in split for w in s})
    ids = [np.frombuffer(b, "<i4").tolist() for b in loose.batch(ws, 1)]
    assert ids == [loose.agenda(w, 1) for w in ws] and ids != [np.frombuffer(b, "<i4").tolist() for b in loose.batch(ws, 2)]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate([*texts, "▁ mark"])])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, rate=0.3)).collect()}
    assert [back[i] for i in range(len(back))] == [*texts, "▁ mark"]


def test_every_occurrence_draws_its_own_skips(spark):
    v = pieces.vocabulary(pieces.MODEL)
    e = pieces.MergeDropout(v, 1, 0.1)
    ws = ["internationalization"] * 3000
    (ids,) = e.learn([ws], [7])
    keys = pieces.keys_of(np.full(3000, 7, np.uint64), np.arange(3000))
    assert ids.tolist() == [x for w, i in zip(ws, range(3000), strict=True) for x in e._agenda(w, keys[i : i + 1])]
    node = e.root[ws[0]]
    plain, n = e.out[node], int(e.used[node])
    got = e._outcomes(ws, keys)
    assert len(set(got)) > 50 and e.most > len(e.out)
    assert np.mean([x == plain for x in got]) >= 0.9**n - 0.05 and abs(np.mean(e.gaps(keys, 0) >= n) - 0.9**n) < 0.03
    assert pieces.MergeDropout(v, 1, 0.1, 0).encode(ws, 7).tolist() == ids.tolist()
    same = docs_of(spark, [(i, "seeded dropout varies", "en", "s") for i in range(300)])
    rows = pieces.encode(same, rate=0.1).collect()
    assert len({tuple(r["ids"]) for r in rows}) > 20 and all(r["lossless"] for r in rows)


def test_counts_equal_the_unigram_library():
    from tokenizers import Tokenizer, models

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    lib = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())], 0, True))
    c = pieces.counter(pieces.MODEL)
    for t in ["Hello  there world", "trail ", "a\nb", "日本語 ☃ é", "ababab" * 20, "the the the"]:
        assert c.count(t) == len(lib.encode("▁" + t.replace(" ", "▁")).ids)


def test_cosine_links_with_odd_vectors(spark):
    e = [1.0, 0.0, 0.0]
    near = [0.99, math.sqrt(1 - 0.99**2), 0.0]
    rows = [(4, e), (4, e), (2, near), (7, [0.0, 0.0, 1.0]), (8, None), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 0.0]), (11, [float("nan"), 0.0, 1.0]), (None, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in cosine.near_duplicates(df).collect())
    want = [(4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (7, 1, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (None, 1, 7, False)]
    assert got == sorted((repr(a), b, repr(c), d) for a, b, c, d in want)
    assert cosine.near_duplicates(df.limit(0)).count() == 0


def test_search_with_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(90, 5)), 1)
    rows = [(int(i // 2), v[i // 3].tolist()) for i in range(90)] + [(None, v[0].tolist()), (60, None), (80, [1.0, None, 0.0, 0.0, 0.0])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, nodes=5, block_bytes=1).collect()]
    use = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in rows if x and None not in x]
    want = []
    for n, (i, q) in enumerate(use):
        if i is not None and i % 20 == 0:
            found = sorted(((-int(q @ x), j is None, j or 0) for m, (j, x) in enumerate(use) if m != n))[:7]
            want += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_search_with_large_values_and_extra_columns(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[7], v[20], v[33] = 1e10, -3e11, 1e300
    v[40] *= 5000
    rows = [(i, x.tolist(), i, b"x") for i, x in enumerate(v)] + [(61, [1e308 * 10, 0.0, 0.0, 0.0], 0, b"y"), (62, [math.nan, 0.0, 0.0, 0.0], 0, b"y")]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, data binary"), k=5).collect()]
    whole = [[math.floor(64.0 * x) for x in r] for r in v.tolist()]
    want = []
    for i in range(0, 60, 20):
        s = [(-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(whole[i], whole[j], strict=True)))), j) for j in range(60) if j != i]
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(sorted(s)[:5])]
    assert sorted(got) == sorted(want)


def test_search_drops_distant_nodes_of_clustered_vectors():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(64, 64))
    m = np.floor(64 * (centers[rng.integers(0, 64, 8192)] + 0.05 * rng.normal(size=(8192, 64))))
    data, queries = topk.local_rows(0, np.arange(8192), np.ones(8192, np.uint8), np.arange(8192), np.ones(8192, bool), m, "i2", 20)
    s = (queries.vecs.astype(float) @ data.vecs.astype(float).T)
    low = np.sort(s, axis=1)[:, -21]
    least = np.array([low[a:b].min(initial=np.inf) for a, b in zip(queries.starts, queries.starts[1:])])  # noqa: B905
    keep = topk.surviving(queries.tree, queries.radii, queries.tree.least(least), data.tree, data.radii)
    there = np.outer(np.diff(queries.starts) > 0, np.diff(data.starts) > 0)
    assert keep.sum() < 0.1 * there.sum()
    got = topk.search_rows(queries, data, low, np.full(len(low), topk.MOST), 20)
    assert sum(len(g[0]) for g in got) >= 20 * len(low)


def test_joins_drop_distant_runs_of_clustered_vectors():
    rng = np.random.default_rng(9)
    m = cosine.unit(rng.normal(size=(32, 64))[rng.integers(0, 32, 8192)] + 0.05 * rng.normal(size=(8192, 64)))
    axes = cosine.principal_axes(m, 16)
    eps = math.sqrt(0.1)
    cells = np.floor(m @ axes / (eps / cosine.FINE)).astype(int)
    m = m[np.lexsort(cells[:, :7].T[::-1])]
    starts = cosine.run_starts(m @ axes, eps)
    near = cosine.run_gaps(m @ axes, starts, m @ axes, starts) <= eps * eps
    assert near.mean() < 0.3
    counts, label = cosine.link_blocks(m, None, 0.95, axes)
    links = (m @ m.T >= 0.95).sum(axis=1) - 1
    assert (counts == links).all() and len(set(label)) < len(m)


def test_mixing_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    targets = {"lang": {"en": 2.0, "de": 1.0, "fr": 1.0, "es": 1.0, "none": 5.0}}
    got = mixing.mix(docs, targets=targets, fraction=0.2, alpha={"source": 0.8, "lang": 1.0, "topic": 1.0}, topic_of=lambda t: F.when(F.length(t) > 1000, "long").otherwise("short")).toPandas()
    x = got.assign(x=got["__tokens"] * got["__probability"]).groupby("lang").x.sum()
    goal = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    assert all(abs(x[k] / x.sum() - g) < 0.01 * g for k, g in goal.items())
    assert abs(x.sum() - 0.2 * got["__tokens"].sum()) < 1e-3 * x.sum() and got["__probability"].max() <= 1
    assert set(got["__topic"]) == {"long", "short"}


def test_topics_are_the_words_used_most(spark):
    rows = [(i, f"common {'alphas ' * (i % 3)} {'bravos ' * (i % 2)} tail", "en", "a") for i in range(30)]
    df = docs_of(spark, rows)
    assert mixing.marker_words(df, "text", 2, 0.7) == ["alphas", "bravos"]
    topics = {r["doc_id"]: r["__topic"] for r in mixing.mix(df, topics=2, most_docs=0.7).collect()}
    assert topics == {i: "other" if i % 6 == 0 else "bravos" if i % 3 == 0 else "alphas" for i in range(30)}


def test_held_out_languages(spark, sf):
    got = langid.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def slow_phrases(text, known):
    n, i = 0, 0
    while i < len(text):
        k = i + 1
        while k < len(text) and text[i : k + 1] in known:
            k += 1
        n, i = n + 1, k
    return n


def test_languages_equal_a_slow_parse(spark):
    rng = np.random.default_rng(6)
    words = {"aa": ["foo", "fool", "of", "lof"], "bb": ["bar", "rab", "abra", "fo"], "cc": ["żółw", "wół", "ów"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)) + (". X2 ½" if i % 2 else ""), lang if i % 7 else None, "s") for i in range(60) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(100, "½ ² 12 !", "aa", "s"), (101, "日本", None, "s"), (102, None, None, None)]
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(df, docs_per_lang=4).collect()}
    import zlib

    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows}
    fit = spark.createDataFrame([(r[1], r[2]) for r in rows if not fold[r[0]]], "text string, lang string")
    known = {lang: "".join(texts) for lang, texts in langid.training_sample(fit, 4)}
    clean = lambda t: " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
    assert len(known) == 3
    for i, text, _, _ in rows:
        low = clean(text)
        cost = sorted((slow_phrases(f" {low} ", k) * math.log2(len(k) + 1), lang) for lang, k in known.items())
        want = (cost[0][1], 1 - cost[0][0] / cost[1][0]) if low else ("und", 0.0)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (want[0], fold[i]) and math.isclose(got[i]["score"], want[1])


def test_pairs_of_pieces_are_found_by_hash():
    draw = np.random.default_rng(3)
    known = {(int(a), int(b)): int(m) for a, b, m in draw.integers(0, 70_000, (20_000, 3))}
    pairs = pieces.Pairs(known, 70_000)
    a, b = np.array([*known, *draw.integers(-3, 70_000, (20_000, 2)).tolist(), (-2, 5), (5, -3), (-1, -1)]).T
    assert pairs.of(a.astype(np.int32), b.astype(np.int32)).tolist() == [known.get(k, -1) for k in zip(a.tolist(), b.tolist())]
    assert pieces.Pairs({}, 10).of(a, b).max() == -1


def test_an_encoder_searches_no_sorted_pairs(monkeypatch):
    """Each merge looks up three pairs; binary searches for them took a fifth of an encoder's time."""
    e = pieces.MergeDropout(pieces.vocabulary(pieces.MODEL), 1, 0.1)
    monkeypatch.setattr(pieces.np, "searchsorted", None)
    assert e.v.decode(e.encode("a plain text of some words".split(" "), 3).tolist()) == "a plain text of some words"


def test_workers_give_back_what_they_freed():
    """A worker that stays idle after encoding holds little more than before its batch."""
    code = """
import pyarrow as pa
from orogen.llm import pieces
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
list(pieces._encoded(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["warm up"]})]), pieces.MODEL, 17, 0.1))
b = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [" ".join(str(hash((d, i)))[:9] for i in range(4000)) for d in range(40)]})
before, most = held(), 0
for out in pieces._encoded(iter([b]), pieces.MODEL, 17, 0.1):
    most = max(most, held() - before)
del out
assert held() - before < most / 2, (held() - before, most)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_tasks_give_back_what_they_freed():
    """Also where a task ends early or fails."""
    calls = []
    run = common.giving_back(lambda it: (b * 2 for b in it))
    kept, common.give_back = common.give_back, lambda: calls.append(1)
    try:
        assert list(run(iter([1, 2]))) == [2, 4] and calls == [1]
        some = run(iter([1, 2]))
        assert next(some) == 2
        some.close()
        assert calls == [1, 1]
        with pytest.raises(TypeError):
            list(run(iter([None])))
        assert calls == [1, 1, 1]
    finally:
        common.give_back = kept


def test_longest_pieces_of_an_automaton():
    text = "abracadabra alakazam"
    a = langid.SuffixAutomaton(text)
    for s in ("abra", "cadalak", "zzz", "azamabq", ""):
        n, i = 0, 0
        while i < len(s):
            k = i + 1
            while k < len(s) and s[i : k + 1] in text:
                k += 1
            n, i = n + 1, k
        assert a.phrases(s) == n


def slow_model(texts):
    """Kneser-Ney probabilities by plain counting; a function of (context, symbol)."""
    from collections import Counter, defaultdict

    top = Counter()
    for t in texts:
        s = quality.symbols(t).tolist()
        top.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    levels = {4: top}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    tables = {}
    for n, counts in levels.items():
        k = [sum(1 for c in counts.values() if c == i) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.5
        d = [min(float(i), max(0.0, i - (i + 1) * y * k[i] / k[i - 1])) if k[i - 1] else 0.0 for i in (1, 2, 3)]
        by, left = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            by[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = (counts, d, by, left)
    size = len(levels[1]) + 1

    def p(g):
        out = 1 / size
        for n in (1, 2, 3, 4):
            counts, d, by, left = tables[n]
            tail = g[4 - n :]
            if tail[:-1] in by:
                c = counts.get(tail, 0)
                out = ((c - d[min(c, 3) - 1]) if c else 0) / by[tail[:-1]] + left[tail[:-1]] / by[tail[:-1]] * out
        return out

    return p, [g[0] for g in levels[1]]


def test_perplexities_equal_plain_counting(spark):
    rng = np.random.default_rng(1)
    words = "the cat sat on the mat and a dog ran łódź 日本 😀".split()
    rows = [(i, " ".join(rng.choice(words, 15)), "en" if i % 3 else "de", "s") for i in range(40)] + [(50, "xqz jvk", "fr", "s"), (51, "", "en", "s"), (52, None, None, None), (50, "again again again", "en", "s")]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    df = docs_of(spark, rows)
    got = quality.classify(df, labels, quantile=0.9, margin=1.2).collect()
    fold = {r["doc_id"]: r["h"] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("h")).collect()}
    p, alphabet = slow_model([t for i, t, _, _ in rows if i < 30 and i != 3 and not fold[i]])
    some = tuple(quality.symbols("the cat").tolist()[2:5])
    assert math.isclose(sum(p((*some, c)) for c in alphabet) + p((*some, 7)), 1, rel_tol=1e-9)

    def ppl(t):
        s = quality.symbols(t).tolist()
        logs = [math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]
        return math.exp(-sum(logs) / len(logs))

    assert len(got) == len(rows)
    for r in got:
        assert (r["__ppl"] is None) if not r["text"] else math.isclose(r["__ppl"], ppl(r["text"]), rel_tol=1e-5)
    for lang in ("en", "de"):
        mine = sorted(ppl(t) for i, t, x, _ in rows if x == lang and i < 30 and i != 3 and fold[i]) or sorted(ppl(t) for i, t, x, _ in rows if x == lang and i < 30 and i != 3)
        most = mine[math.ceil(0.9 * len(mine)) - 1] * 1.2
        assert all(math.isclose(r["__most"], most, rel_tol=1e-5) and r["__keep"] == (r["__ppl"] is not None and r["__ppl"] <= r["__most"]) for r in got if r["lang"] == lang)
    none = quality.classify(df, labels.limit(0)).collect()
    assert all(r["__keep"] == bool(r["text"]) for r in none)


def test_an_alphabet_too_large_is_split():
    texts = ["".join(chr(c) for c in range(a, a + 40_000)) for a in (0x10000, 0x20000, 0x30000)]
    parts = list(quality.split_batch(texts))
    assert [at for at, _ in parts] == [0, 1, 2] and all(len(b.alphabet) <= 0xFFFF for _, b in parts)


def test_trusted_documents_are_kept_and_junk_goes(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op9_quality_classifier(spark, sf).join(labels, "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    rate = {(r["quality"], r["held"]): r["k"] for r in got.groupBy("quality", "held").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert rate[1, True] > 0.9 and rate[1, False] > 0.97 and rate[0, True] < 0.1 and rate[0, False] < 0.1


def test_a_rare_language_has_its_own_threshold(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 3, "en", "a") for i in range(200)]
    rows += [(1000 + i, f"zażółć gęślą jaźń źdźbło {chr(97 + i % 26)} chrząszcz brzmi w trzcinie", "pl", "a") for i in range(4)] + [(2000, "zażółć gęślą jaźń źdźbło z chrząszcz brzmi w trzcinie", "pl", "a"), (3000, "the mat and the cat", "it", "a")]
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] < 2000], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs_of(spark, rows), labels).collect()}
    assert got[1000]["__most"] == got[2000]["__most"] and got[2000]["__keep"] and got[1000]["__most"] != got[0]["__most"]
    assert got[3000]["__most"] not in (None, got[1000]["__most"])  # without trusted documents: the quantile over all


def test_pages():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <article><h2>Head &amp; more</h2><p>One  two<br>three</p><aside>side</aside><div class="ad">buy</div><p>Last<script>x<p>y</script> word</p>
    <form>name <input></form><section id="comments"><p>reader says</p></section></article><div class="cookie-notice">ok?</div><footer>foot</footer></body></html>"""
    assert html.extract(page) == "Head & more\nOne two three\nLast word"
    assert html.extract(None) == html.extract("") == ""
    plain = "<body><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><h1>A title</h1>" + "<p>It was the best of the times and it was the worst of the times for all of us who were there in the end of it.</p>" * 3 + "<div><a href=z>more links here</a></div>"
    got = html.extract(plain).split("\n")
    assert "Home" not in got and got[-1].startswith("It was") and "more links here" not in got


def test_block_rules_hold_beside_articles():
    body = "It was the best of the times and it was the worst of the times for all of us who were there in the end of it."
    teaser = '<article><h3><a href="/x">Some other story</a></h3><p>Short lead.</p></article>'
    got = html.extract(f"<body><h1>A title</h1><div>{body * 3}</div><p>{body}</p><div><a href=z>more</a></div>{teaser * 3}</body>").split("\n")
    assert got == ["A title", body * 3, body]
    page = f'<main><h2><a href="/s">Linked head</a></h2><p>{body}</p><ul><li><a href="/r">A reference by its name</a></li></ul><p>End.</p></main><footer>x</footer>'
    assert html.extract(page) == f"Linked head\n{body}\nA reference by its name\nEnd."
    foreign = "Szybki brązowy lis przeskakuje nad leniwym psem, który śpi spokojnie przed domem swojego pana."
    assert html.extract(f"<body><ul><li><a href=/a>Home</a></li></ul><p>{body * 2}</p><p>{foreign}</p><p>{body * 2}</p></body>") == f"{body * 2}\n{foreign}\n{body * 2}"


def test_pages_without_ends_take_linear_time():
    import time

    start = time.time()
    for page in ("<a " * 350_000, '<a "x ' * 170_000 + ">", "<div>" * 100_000 + "</span>" * 100_000, "<select>x" * 100_000, "<p>" + "word " * 200_000):
        html.extract(page)
    assert time.time() - start < 60
    assert html.extract("<p>a < b and <b c") == "a < b and <b c" and html.extract('<p class="x>y">in <i title=">">it</i></p>') == "in it"


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (None, None, None), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(repr(tuple(r)) for r in html.main_text(df).collect()) == sorted(map(repr, [(1, "u", "x", 1), (None, None, "", 0), (1, "u", "x", 1)]))
    clash = df.withColumn("text", F.lit("t")).withColumn("n_chars", F.lit(9))
    assert html.main_text(clash).where("page_id = 1").first()["text"] == "x" and html.main_text(df.limit(0)).collect() == []


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.keep_quality(spark, docs, sf)
    assert kept.columns == docs.columns
    words = {r["doc_id"]: slow_fingerprint(r["text"], 5) for r in kept.collect()}
    stay = {r["doc_id"] for r in p.drop_near_duplicates(spark, kept, sf).collect()}
    comp = {k: k for k in words}
    for _ in words:
        new = {a: min(comp[b] for b in words if (words[a] ^ words[b]).bit_count() <= 6) for a in words}
        if new == comp:
            break
        comp = new
    assert stay == set(comp.values())
    out = p.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} <= stay and all(r["lossless"] for r in out) and out


def test_numbers_fall_in_the_buckets_that_spark_deals_them_to(spark):
    ids = [0, -1, 5, 1 << 32, (7 << 32) + 12345, -(1 << 63), (1 << 63) - 1, *range(100, 300)]
    want = {r["id"]: r["b"] for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "pmod(hash(id), 13) b").collect()}
    assert dict(zip(ids, bucket_of(np.array(ids), 13).tolist(), strict=True)) == want


BATCH_RUN = """
import sys
import pyarrow as pa
from orogen.llm import quality
mb = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) / 1024
texts, before = pa.array([open(sys.argv[1], "rb").read()], pa.binary()), mb()
rows = 0
for b in quality._counted(iter([pa.RecordBatch.from_arrays([pa.array([1]), texts, pa.array([[0, 2]])], names=["batch", "texts", "fit"])])):
    rows += b.num_rows
print(rows, mb() - before)
"""


def test_a_worker_holds_little_beside_a_batch(tmp_path):
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 3000)])
    texts = [" ".join(words[rng.integers(0, 3000, 500)]) for _ in range(quality.BATCH_CHARS // 3000)]
    ids = list(range(len(texts)))
    (tmp_path / "batch").write_bytes(quality._stream(pa.table([pa.array(ids), pa.array(["en"] * len(ids)), pa.array(texts)], ["id", "lang", "text"])))
    done = subprocess.run([sys.executable, "-c", BATCH_RUN, str(tmp_path / "batch")], capture_output=True, text=True, check=True)
    rows, mb = map(float, done.stdout.split())
    assert rows > 10_000 and mb < 110  # two such workers are held beside an executor's heap


def test_joins_leave_a_bucketed_table_in_place(spark):
    big = staged_by(spark.range(100).selectExpr("id batch", "cast(id as string) t"), "big", "batch")
    small = spark.range(200).selectExpr("id % 50 batch", "id v").groupBy("batch").agg(F.count("v").alias("n"))
    out = big.hint("merge").join(small, "batch", "left")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(batch") == 1 and "Bucketed: true" in plan
    assert {r["batch"]: r["n"] for r in out.collect()} == {i: 4 if i < 50 else None for i in range(100)}


def test_mix_result_reads_no_texts(spark, sf):
    """Topics and tokens are staged: what writes the result doesn't parse the texts once more."""
    from orogen.llm.mixing import op4_mix_sources

    assert "regexp" not in op4_mix_sources(spark, sf)._jdf.queryExecution().toString().lower()
