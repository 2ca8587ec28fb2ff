"""DuckDB SQL for the operators that SQL can express."""

from orogen.llm.mixing import OP4_SQL

_KINDS = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24),
)


def _spans(k: int) -> str:
    name, pattern, group, least = _KINDS[k]
    return f"""select doc_id, source, {k} as k, '{name}' as kind, pos as start, pos + len(m[i]) as "end", v[i] as value from (
        select *, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as pos from (
        select *, unnest(range(1, len(m) + 1)) as i from (
        select doc_id, source, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as v, regexp_split_to_array(t, '{pattern}') as g
        from (select *, coalesce(text, '') as t from documents) where regexp_matches(t, '{pattern}'))))
        where len(v[i]) >= {least}"""


_LIST = "string_agg(kind || ':' || start || ':' || \"end\", ',' order by start, k)"
OP5_SQL = f"""with base as (select * from ({_spans(0)}) union all select * from ({_spans(1)}) union all select * from ({_spans(2)})),
    extra as (select * from ({_spans(3)}) e where regexp_matches(value, '[0-9]') and not exists (select 1 from base b where b.doc_id = e.doc_id and b.start < e."end" and e.start < b."end")),
    found as (select * from base union all select * from extra),
    own as (select k, value, count(distinct source) < 3 and count(distinct doc_id) < 30 as live from found group by all),
    judged as (select * from found join own using (k, value) where k < 3 or live),
    each as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
        coalesce({_LIST} filter (k < 3), '') as base, {_LIST} as spans, count(*) filter (live) as n_live, count(*) filter (not live) as n_example from judged group by doc_id)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
        coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from documents left join each using (doc_id)"""

_GOOD = "embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))"
OP6_SQL = f"""with q as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings where {_GOOD}),
    s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
    qualify rank <= 20"""

OP7_SQL = f"""with recursive u as materialized (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where {_GOOD} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
    reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join l on r.b = l.a),
    c as (select a as vec_id, min(b) as component_id from reach group by a),
    n as (select a as vec_id, count(*) as n_links from l group by a)
    select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)"""

ORACLES = {"op4_mix_sources": OP4_SQL, "op5_secret_scan": OP5_SQL, "op6_exact_topk": OP6_SQL, "op7_embedding_near_dedup": OP7_SQL}
