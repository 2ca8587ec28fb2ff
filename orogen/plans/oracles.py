"""The same queries as DuckDB SQL, each rebuilt from the raw tables."""

SB, LEAST = 32, 8

EMB = "emb as (select y, x, cast(round(z * 1000.0) as bigint) as q from (select vec_id as y, unnest(range(0, len(embedding))) as x, cast(unnest(embedding) as double) as z from embeddings))"
ORD = "ord as (select o_orderkey // 100 as y, o_orderkey % 100 as x, o_totalprice as z, cast(round(o_totalprice * 100.0) as bigint) as q from orders)"


def _ev(scale: str = "10.0") -> str:
    return f"""ev as (select y, x, z, nodata, case when nodata then 0 else cast(round(z * {scale}) as bigint) end as q from (select event_id // 100 as y, event_id % 100 as x,
        case when event_type = 'error' then -9999.0 else value end as z, event_type = 'error' as nodata from events))"""


EV = _ev()
TILE = f"(y // {SB}) * 1048576 + x // {SB}"
TILES = f"tiles as (select *, {TILE} as sb from emb)"
NODE = f"((y % {SB}) // {LEAST}) * {SB // LEAST} + (x % {SB}) // {LEAST}"
BLOCKS = f"blocks as (select *, 0 as level, {NODE} as node from tiles)"


def near(src: str, keys: str, v: str = "q", out: str = "n", p: str = "") -> str:
    return f"""{out}0 as (select *, lag({v}) over (partition by {keys}, x order by y) as {p}N, lag({v}, 2) over (partition by {keys}, x order by y) as {p}NN from {src}),
        {out} as (select *, lag({v}) over r as {p}W, lag({v}, 2) over r as {p}WW, lag({p}N) over r as {p}NW, lead({p}N) over r as {p}NE, lead({p}NN) over r as {p}NNE from {out}0 window r as (partition by {keys}, y order by x))"""


def left(p: str = "") -> str:
    return f"coalesce({p}W, 0)"


def gradient(p: str = "") -> str:
    return f"(coalesce({p}W, 0) + coalesce({p}N, 0) - coalesce({p}NW, 0))"


def med(p: str = "") -> str:
    w, n, a = (f"coalesce({p}{k}, 0)" for k in ("W", "N", "NW"))
    return f"(case when {a} >= greatest({w}, {n}) then least({w}, {n}) when {a} <= least({w}, {n}) then greatest({w}, {n}) else {w} + {n} - {a} end)"


def edges(inner: str) -> str:
    return f"(case when N is null then coalesce(W, 0) when W is null then N else {inner} end)"


def gap() -> str:
    ne, ww, nn = "coalesce(NE, N)", "coalesce(WW, W)", "coalesce(NN, N)"
    nne = f"coalesce(NNE, {ne})"
    s = f"(abs(W - NW) + abs(N - {nn}) + abs({ne} - {nne}) - abs(W - {ww}) - abs(N - NW) - abs(N - {ne}))"
    b = f"((W + N) // 2 + ({ne} - NW) // 4)"
    return edges(f"case when {s} > 80 then W when {s} < -80 then N when {s} > 32 then ({b} + W) // 2 when {s} > 8 then (3 * {b} + W) // 4 when {s} < -32 then ({b} + N) // 2 when {s} < -8 then (3 * {b} + N) // 4 else {b} end")


AVERAGE = edges("W // 2 + N // 2")
MEDIAN = edges("greatest(least(W, N), least(greatest(W, N), NW))")
LS = edges("(k1 * W + k2 * N + k3 * NW) // 256")


def weights(src: str, keys: str, v: str = "q", out: str = "k") -> str:
    near3 = ("W", "N", "NW")
    there = "W is not null and N is not null"
    s = [f"coalesce(sum(cast({near3[i]} as double) * {near3[j]}) filter ({there}), 0) as a{i}{j}" for i in range(3) for j in range(i, 3)]
    s += [f"coalesce(sum(cast({near3[i]} as double) * {v}) filter ({there}), 0) as b{i}" for i in range(3)]
    a = [[f"a{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]

    def det(m: list[list[str]]) -> str:
        (p, q, r), (t, u, w), (x, y, z) = m
        return f"({p} * ({u} * {z} - {w} * {y}) - {q} * ({t} * {z} - {w} * {x}) + {r} * ({t} * {y} - {u} * {x}))"

    ks = []
    for k, fall in enumerate((256, 256, -256)):
        swapped = [[f"b{i}" if j == k else a[i][j] for j in range(3)] for i in range(3)]
        ks.append(f"cast(case when abs(det) > 1e-5 then round({det(swapped)} / det * 256.0) else {fall} end as bigint) as k{k + 1}")
    return f"{out} as (select {keys}, {', '.join(ks)} from (select *, {det(a)} as det from (select {keys}, {', '.join(s)} from {src} group by {keys})))"


def runs(src: str, keys: str, v: str, out: str = "sym") -> str:
    """Symbols of one context in raster order."""
    return f"""{out}1 as (select *, row_number() over (partition by {keys} order by y, x) as pos, sum(cast({v} <> 0 as bigint)) over (partition by {keys} order by y, x rows unbounded preceding) as island from {src}),
        {out}2 as (select *, (pos - min(pos) filter ({v} = 0) over (partition by {keys}, island)) // 255 as chunk, case when {v} >= 0 then 2 * {v} else -2 * {v} - 1 end as zz from {out}1),
        {out} as (select {keys}, pos as "at", cast(length(bin(zz)) as bigint) as mag, cast(0 as bigint) as run, zz - (cast(1 as bigint) << cast(length(bin(zz)) - 1 as bigint)) as rem from {out}2 where {v} <> 0
        union all select {keys}, min(pos), 0, count(*), 0 from {out}2 where {v} = 0 group by {keys}, island, chunk)"""


def bits(src: str, keys: str, out: str = "cost") -> str:
    """Total bits of the symbols of each key."""
    return f"""{out}m as (select {keys}, mag, count(*) as n from {src} group by {keys}, mag),
        {out}r as (select {keys}, run, count(*) as n from {src} where run > 0 group by {keys}, run),
        {out}mm as (select {keys}, sum(n) * log2(sum(n)) - sum(n * log2(n)) + sum(n * greatest(mag - 1, 0)) as b from {out}m group by {keys}),
        {out}rr as (select {keys}, sum(n) * log2(sum(n)) - sum(n * log2(n)) as b from {out}r group by {keys}),
        {out} as (select {keys}, round({out}mm.b + coalesce({out}rr.b, 0), 6) as bits from {out}mm left join {out}rr using ({keys}))"""


K = "sb, level, node"


def residuals(src: str, prune: bool = True) -> str:
    """All candidate residuals of the blocks of ``src``."""
    one = lambda pid, rank, n, e: f"select {K}, y, x, {pid} as pid, {rank} as rank, {n} as params, q - {e} as r, delta from wide"
    return ", ".join([
        near(src, "sb, level", "q", "s", "s"), near("s", K, "q", "n"), weights("n", K),
        f"span as (select {K}, max(q) - min(q) as delta from {src} group by {K})",
        f"wide as materialized (select * from n join k using ({K}) join span using ({K}))",
        "res as materialized (select * from (" + " union all ".join([one(0, 0, 0, gradient("s")), one(1, 1, 0, left("s")), one(2, 2, 0, med("s")), one(4, 3, 0, gap()), one(5, 4, 3, LS)]) + ")" + (" where case when delta = 0 then pid = 1 when delta > 200 then pid <> 2 else true end" if prune else "") + ")",
    ])


def chosen(src: str) -> str:
    keys = f"{K}, pid, rank, params"
    return ", ".join([residuals(src), runs("res", keys, "r"), bits("sym", keys), f"choice as materialized (select {K}, unnest(arg_min({{'pid': pid, 'bits': t}}, (t, rank))) from (select *, round(bits + 8 + 32 * params, 6) as t from cost) group by {K})"])


def with_pool(src: str) -> str:
    keys, deep = f"{K}, pid, rank, params", f"{K}, pid, second, more"
    one = lambda i, n, e: f"select {K}, pid, {i} as second, {n} as more, y, x, r - {e} as r2 from pw"
    return ", ".join([
        residuals(src), runs("res", keys, "r"), bits("sym", keys),
        f"go as (select {K}, pid from res group by {K}, pid having count(*) filter (r = 0) * 100 <= count(*) * 95)",
        f"todo as (select {K}, pid, y, x, r from res join go using ({K}, pid))",
        near("todo", f"{K}, pid", "r", "p"), weights("p", f"{K}, pid", "r", "pk"), f"pw as materialized (select * from p join pk using ({K}, pid))",
        "pool as (" + " union all ".join([one(1, 0, AVERAGE), one(2, 0, MEDIAN), one(3, 0, left()), one(4, 0, gradient()), one(5, 0, gap()), one(6, 3, LS)]) + ")",
        runs("pool", deep, "r2", "psym"), bits("psym", deep, "pcost"),
        f"least2 as (select {K}, pid, unnest(arg_min({{'second': second, 'b2': b}}, (b, second))) from (select *, bits + 32 * more as b from pcost) group by {K}, pid)",
        f"choice as materialized (select {K}, unnest(arg_min({{'pid': pid, 'second': took, 'bits': t}}, (t, rank))) from (select *, round(case when took > 0 then b2 else bits end + 8 + 32 * params, 6) as t from (select *, case when coalesce(b2 < bits - 16, false) then second else 0 end as took from cost left join least2 using ({K}, pid))) group by {K})",
    ])


def tree() -> str:
    step = lambda a, b, level: f"""{b} as (select y, x, q, sb, {level} as level, node * 4 + case when lower then 2 else 0 end + case when east then 1 else 0 end as node,
        case when east then cols - cols // 2 else cols // 2 end as cols, case when lower then rws - rws // 2 else rws // 2 end as rws, case when east then x0 + cols // 2 else x0 end as x0, case when lower then y0 + rws // 2 else y0 end as y0
        from (select *, x >= x0 + cols // 2 as east, y >= y0 + rws // 2 as lower from {a} where cols > {LEAST} and rws > {LEAST}))"""  # noqa: E731
    return f"""ends as (select sb, max(x) - min(x) + 1 as cols, max(y) - min(y) + 1 as rws, min(x) as x0, min(y) as y0 from tiles group by sb),
        t0 as (select y, x, q, sb, 0 as level, cast(1 as bigint) as node, cols, rws, x0, y0 from tiles join ends using (sb)), {step("t0", "t1", 1)}, {step("t1", "t2", 2)},
        nodes as materialized (select * from t0 union all select * from t1 union all select * from t2), shape as (select {K}, count(*) as cells, min(cols) as w from nodes group by {K})"""


def leaves() -> str:
    return f"""{EMB}, {TILES}, {tree()}, {with_pool("nodes")},
        c as materialized (select * from choice join shape using ({K})),
        c2 as (select *, false as cut, bits + 1 as total from c where level = 2),
        b1 as (select sb, node // 4 as node, sum(total) as below from c2 group by all),
        c1 as (select c.*, coalesce(bits >= cells and below < bits, false) as cut, below from c left join b1 using (sb, node) where level = 1),
        b0 as (select sb, node // 4 as node, sum(case when cut then below else bits end + 1) as below from c1 group by all),
        c0 as (select c.*, coalesce(bits >= cells and below < bits, false) as cut from c left join b0 using (sb, node) where level = 0),
        l1 as (select c1.* from c1 semi join (select sb as s from c0 where cut) on sb = s),
        l2 as (select c2.* from c2 semi join (select sb as s, node as m from l1 where cut) on sb = s and node // 4 = m),
        leaf as materialized (select sb, level, node, pid, second, bits, cells, w from c0 where not cut union all select sb, level, node, pid, second, bits, cells, w from l1 where not cut union all select sb, level, node, pid, second, bits, cells, w from l2)"""


def _residual(keys: str, e: str, src: str = "tiles") -> str:
    return f"with {EMB}, {TILES}, {BLOCKS}, {near(src, keys)} select y, x, q - {e} as r from n"


def _rings(n: int = 8) -> str:
    out = [f"with {EV}, f0 as (select y, x, q, 0 as ring from ev where not nodata)"]
    for i in range(1, n + 1):
        out.append(f"""g{i} as materialized (select h.y, h.x, cast(sum(f.q) as bigint) // count(*) as q, {i} as ring from (select * from ev where nodata) h join f{i - 1} f on (abs(h.y - f.y) + abs(h.x - f.x)) = 1 and f.y between h.y - 1 and h.y + 1
            and f.ring = {i - 1} anti join f{i - 1} d on d.y = h.y and d.x = h.x group by h.y, h.x)""".replace("anti join f%d d on d.y = h.y and d.x = h.x" % (i - 1), f"where not exists (select 1 from f{i - 1} d where d.y = h.y and d.x = h.x)"))
        out.append(f"f{i} as materialized (select * from f{i - 1} union all select * from g{i})")
    return ", ".join(out) + f" select ev.y, ev.x, coalesce(f.q, ev.q) as q, ev.nodata, cast(coalesce(f.ring, -1) as bigint) as ring from ev left join f{n} f on f.y = ev.y and f.x = ev.x"


_CORR = """select case when w < 2 or h < 2 then 0.0 when var <= 0 then 1.0 else round(p / (var * {pairs} / (w * h)), 6) end"""


def _correlation() -> str:
    def one(name: str, dy: int, dx: int, pairs: str) -> str:
        return f"(select round(sum((a.q - m.mean) * (b.q - m.mean)) / (any_value(m.v) * {pairs} / (any_value(m.w) * any_value(m.h))), 6) from emb a join emb b on b.y = a.y + {dy} and b.x = a.x + {dx}, m) as {name}"

    w, h = "any_value(m.w)", "any_value(m.h)"
    return f"with {EMB}, m as (select avg(q) as mean, var_pop(q) * count(*) as v, cast(max(x) + 1 as double) as w, cast(max(y) + 1 as double) as h from emb) select {one('h', 0, 1, f'({w} - 1) * {h}')}, {one('v', 1, 0, f'{w} * ({h} - 1)')}, {one('d', 1, 1, f'({w} - 1) * ({h} - 1)')}"


_PLACES = " union all ".join(f"select {i} as place, (abs(q) // {10**i}) % 10 as digit from ev where not nodata" for i in range(3))
_RANKS = " union all ".join(f"select cast({f} as double) as fraction, s[cast(floor({f} * (len(s) - 1) + 0.5) as bigint) + 1] as value from s" for f in (0.01, 0.25, 0.5, 0.75, 0.99))


def _sweep() -> str:
    parts = []
    for k in range(3):
        parts.append(f"select * from (with {EMB.replace('as q from (', f'// {10**k} as q from (')}, {TILES}, {BLOCKS}, {chosen('blocks')} select cast({k} as bigint) as digits_dropped, count(*) as blocks, round(sum(bits) / 8 + count(*) * 36 + 256, 2) as bytes from choice)")
    return " union all ".join(parts)


def _percentiles(most: int) -> str:
    return f"with {EV}, c as (select greatest(1, count(*) // {most}) as stride from ev), o as (select z, row_number() over (order by y, x) - 1 as i from ev where not nodata), s as (select list_sort(list(z)) as s from o, c where i % stride = 0 and i < stride * {most}) {_RANKS}"


def _lift(src: str, out: str) -> str:
    """One level of the transform along rows of ``src``; rows and columns change places in the result."""
    return f"""{out}a as (select *, row_number() over r - 1 as i, count(*) over (partition by sb, y) as n, lag(q) over r as b, lead(q) over r as f from {src} window r as (partition by sb, y order by x)),
        {out}o as (select *, case when i % 2 = 1 then q - ((b + coalesce(f, b)) >> 1) end as d from {out}a), {out}e as (select *, lag(d) over r as db, lead(d) over r as df from {out}o window r as (partition by sb, y order by x)),
        {out} as (select sb, y as x, case when i % 2 = 1 then (n + 1) // 2 + i // 2 else i // 2 end as y, case when i % 2 = 1 then d when n = 1 then q else q + ((coalesce(db, df) + coalesce(df, db) + 2) >> 2) end as q from {out}e)"""


HEAD = f"with {EMB}, {TILES}, {BLOCKS}"
ORACLES = {
    "quantize": f"with {ORD} select y, x, q from ord",
    "dequantize_error": f"with {ORD} select round(max(abs(q * 0.01 - z)), 6) as worst, cast(sum(cast(abs(q * 0.01 - z) > 0.005 + 1e-9 as bigint)) as bigint) as over, count(*) as n from ord",
    "nodata_mask": f"with {EV} select y, x, q, nodata from ev",
    "dequantize_masked": f"with {EV} select y, x, cast(round(case when nodata then -9999.0 else q * cast(0.1 as double) end, 6) as double) as z from ev",
    "inpaint_rings": _rings(),
    "raw_stats": f"with {EV} select count(*) as valid, min(z) as min, max(z) as max, round(avg(z), 6) as mean, round(stddev_pop(z), 6) as stddev from ev where not nodata",
    "percentiles_nearest_rank": _percentiles(262144),
    "percentiles_of_stride": _percentiles(300),
    "elevation_histogram50": f"with {EV}, e as (select min(z) as lo, max(z) as hi from ev where not nodata), b as (select case when hi > lo then least(49, cast(floor((z - lo) / (hi - lo) * 50) as bigint)) else 0 end as bucket, count(*) as count from ev, e where not nodata group by 1) select bucket, count, round(count / max(count) over (), 6) as height from b",
    "quantized_stats": f"with {EV} select count(*) filter (not nodata) as valid, count(*) filter (nodata) as masked, min(q) filter (not nodata) as min, max(q) filter (not nodata) as max, round(avg(q) filter (not nodata), 6) as mean, round(stddev_pop(q) filter (not nodata), 6) as stddev from ev",
    "spatial_correlation": _correlation(),
    "digit_plane_entropy": f"with {_ev('100.0')}, p as ({_PLACES}), c as (select place, digit, count(*) as n from p group by all) select place, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy from c group by place",
    "split_precision_planes": f"with {ORD} select y, x, q // 100 as m, q % 100 as p, (q // 100) * 100 + q % 100 as back from ord",
    "zigzag_class_hist": f"with {EMB}, z as (select case when q >= 0 then 2 * q else -2 * q - 1 end as u from emb), m as (select case when u = 0 then 0 else length(bin(u)) end as mag, u from z) select cast(mag as integer) as mag, count(*) as n, cast(sum(case when mag = 0 then 0 else u - (cast(1 as bigint) << cast(mag - 1 as bigint)) end) as bigint) as rem_sum, count(*) as round_trips from m group by mag",
    "left_residual": _residual("sb", left()),
    "gradient_residual": _residual("sb", gradient()),
    "jpegls_residual": _residual("sb", med()),
    "gap_residual": _residual(K, gap(), "blocks"),
    "average_residual": _residual(K, AVERAGE, "blocks"),
    "median_residual": _residual(K, MEDIAN, "blocks"),
    "ls_weights": f"{HEAD}, {near('blocks', K)}, {weights('n', K)} select sb, node, k1, k2, k3 from k",
    "ls_residual": f"{HEAD}, {near('blocks', K)}, {weights('n', K)} select y, x, q - {LS} as r from n join k using ({K})",
    "predictor_ranking": f"with {EMB}, {TILES}, whole as (select *, 0 as level, 0 as node from tiles), {residuals('whole', False)}, c as (select pid, r, count(*) as n from res group by all) select pid, cast(sum(n) as bigint) as n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy, round(sum(n * abs(r)) / sum(n), 6) as mean_abs from c group by pid",
    "zero_run_symbols": f"with {EMB}, tiles as (select y, x, q // 100 as v, {TILE} as sb from emb), {runs('tiles', 'sb', 'v')} select * from sym",
    "extended_context_hist": f"with {EMB}, {TILES}, {near('tiles', 'sb')}, g as (select sb, y, x, q - {gradient()} as r from n), {near('g', 'sb', 'r', 'm', 'm')}, a as (select greatest(abs(coalesce(mW, 0)), abs(coalesce(mN, 0))) as a from m) select cast(case when a <= 2 then 0 when a <= 8 then 1 when a <= 32 then 2 else 3 end as bigint) as ctx, count(*) as n from a group by 1",
    "block_cost_estimate": f"{HEAD}, {near('tiles', 'sb')}, g as (select sb, {NODE} as node, y, x, q - {gradient()} as r from n), {runs('g', 'sb, node', 'r')}, {bits('sym', 'sb, node')} select sb, node, round(bits, 4) as bits from cost",
    "best_predictor_per_block": f"{HEAD}, {chosen('blocks')} select sb, node, cast(pid as bigint) as pid, round(bits, 4) as bits from choice",
    "second_pass_choice": f"{HEAD}, {with_pool('blocks')} select sb, node, cast(pid as bigint) as pid, cast(second as bigint) as second, round(bits, 4) as bits from choice",
    "predictor_usage": f"{HEAD}, {chosen('blocks')} select cast(pid as bigint) as pid, count(*) as blocks, round(count(*) / sum(count(*)) over (), 6) as share from choice group by pid",
    "fixed_grid_blocks": f"{HEAD} select sb, node, min(x) as x0, min(y) as y0, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from blocks group by sb, node",
    "quadtree_leaves": f"with {leaves()} select sb, cast(level as bigint) as level, node, cast(pid as bigint) as pid, cast(second as bigint) as second, round(bits, 4) as bits from leaf",
    "quadtree_leaf_counts": f"with {leaves()} select w, count(*) as leaves, cast(sum(cells) as bigint) as cells from leaf group by w",
    "index_offsets": f"with {leaves()}, pay as (select sb, node * cast(power(4, 2 - level) as bigint) as place, cast(ceil(round(bits / 8, 4)) as bigint) as bytes from leaf) select sb, place, cast(coalesce(sum(bytes) over (order by sb, place rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", bytes from pay",
    "entropy_budget": f"with {leaves()}, t as (select count(*) as leaves, cast(sum(cells) as bigint) as cells, sum(bits) as bits, var_pop(bits) as v from leaf), sized as (select *, bits / 8 + leaves * 36 + 256 as size from t) select leaves, cells, round(bits / cells, 4) as bpp, round(size, 2) as file_bytes, round(cells * 4 / size, 4) as ratio, round(sqrt(leaves * v) / 8, 3) as bytes_stddev from sized",
    "mask_rle": f"with {EV}, t as (select *, {TILE} as sb from ev), f as (select *, case when nodata <> coalesce(lag(nodata) over (partition by sb order by y, x), false) then 1 else 0 end as flip from t), s as (select *, sum(flip) over (partition by sb order by y, x rows unbounded preceding) as seq from f) select sb, cast(seq as bigint) as seq, any_value(nodata) as masked, count(*) as run from s group by sb, seq",
    "mask_rle_bytes": f"with {EV}, t as (select *, {TILE} as sb from ev), f as (select *, case when nodata <> coalesce(lag(nodata) over (partition by sb order by y, x), false) then 1 else 0 end as flip from t), s as (select *, sum(flip) over (partition by sb order by y, x rows unbounded preceding) as seq from f), r as (select sb, seq, any_value(nodata) as masked, count(*) as run from s group by sb, seq) select sb, case when min(seq) = 1 then '00' else '' end || string_agg(repeat('FF00', run // 255) || lpad(to_hex(run % 255), 2, '0'), '' order by seq) as bytes from r group by sb",
    "roi_crop": f"with {ORD} select y - 5 as y, x - 17 as x, q from ord where x >= 17 and x < 57 and y >= 5 and y < 8",
    "roi_superblocks": f"{HEAD}, t as (select sb, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from tiles group by sb) select sb, x0, y0 from t where x1 >= 20 and x0 < 50 and y1 >= 40 and y0 < 130",
    "verify_diff": f"with {EV} select count(*) as checked, count(*) filter (not nodata and (y * 100 + x) % 97 = 0) as mismatched from ev",
    "left_decode": f"with {EMB} select y, x, q from emb",
    "gradient_decode": f"with {EMB} select y, x, q from emb",
    "cdf53_row_level1": f"with {EMB}, {TILES}, {_lift('tiles', 'l')} select sb, x as y, y as pos, q as coef from l",
    "cdf53_level1": f"with {EMB}, {TILES}, {_lift('tiles', 'l')}, {_lift('l', 'm')} select sb, y, x, q as coef from m",
    "coarse_precision_sweep": _sweep(),
    "codec_round_trip": f"with {EV} select y, x, q, nodata from ev",
    "region_decode": f"with {EMB} select y - 40 as y, x - 20 as x, q from emb where x >= 20 and x < 50 and y >= 40 and y < 130",
}
