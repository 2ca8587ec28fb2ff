"""NumPy kernels on one tile: prediction, transform, choice and entropy coding. Integers are 64-bit, division cuts towards zero."""

from __future__ import annotations

import math

import numpy as np

GRADIENT, LEFT, MED, POLYNOMIAL, GAP, LEAST_SQUARES = range(6)
BANK = (GRADIENT, LEFT, MED, POLYNOMIAL, GAP, LEAST_SQUARES)
NONE, AVERAGE, MEDIAN, LEFT2, GRADIENT2, GAP2, LEAST_SQUARES2 = range(7)
IDENTITY = 254
POOL_KERNEL = {LEFT2: LEFT, GRADIENT2: GRADIENT, GAP2: GAP, LEAST_SQUARES2: LEAST_SQUARES}
#: Degrees in u and v of the terms of a surface, and terms by order.
U_POWER, V_POWER = (0, 1, 0, 2, 1, 0, 3, 2, 1, 0), (0, 0, 1, 0, 1, 2, 0, 1, 2, 3)
TERMS = {1: 3, 2: 6, 3: 10}
UNIT = 16384
Rect = tuple[int, int, int, int]


def tdiv(a, b):
    """Division cut towards zero."""
    if isinstance(b, int) and b & (b - 1) == 0:
        return a + (a >> 63 & (b - 1)) >> b.bit_length() - 1
    return np.sign(a) * (np.abs(a) // b)


def _around(g: np.ndarray, r: Rect) -> tuple[np.ndarray, ...]:
    """The rectangle, and its left, upper and diagonal neighbours in the whole tile, 0 outside."""
    x, y, w, h = r
    z = np.pad(g, ((1, 0), (1, 0)))
    return z[y + 1 : y + 1 + h, x + 1 : x + 1 + w], z[y + 1 : y + 1 + h, x : x + w], z[y : y + h, x + 1 : x + 1 + w], z[y : y + h, x : x + w]


def _bordered(b: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Prediction of a block: first row from the left, first column from above, ``inner`` elsewhere."""
    p = np.zeros_like(b)
    p[0, 1:] = b[0, :-1]
    p[1:, 0] = b[:-1, 0]
    p[1:, 1:] = inner
    return p


def gap_value(w, n, nw, ne, ww, nn, nne):
    s = abs(w - nw) + abs(n - nn) + abs(ne - nne) - abs(w - ww) - abs(n - nw) - abs(n - ne)
    p = tdiv(w + n, 2) + tdiv(ne - nw, 4)
    tests = [s > 80, s < -80, s > 32, s > 8, s < -32, s < -8]
    return np.select(tests, [w, n, tdiv(p + w, 2), tdiv(3 * p + w, 4), tdiv(p + n, 2), tdiv(3 * p + n, 4)], p)


def _gap(b: np.ndarray) -> np.ndarray:
    h, w = b.shape
    if h < 2 or w < 2:
        return _bordered(b, b[1:, 1:] * 0)
    n = b[:-1, 1:]
    ne = np.concatenate([b[:-1, 2:], b[:-1, -1:]], axis=1)
    left = b[1:, :-1]
    ww = np.concatenate([left[:, :1], b[1:, :-2]], axis=1)
    nn = np.concatenate([n[:1], b[:-2, 1:]])
    nne = np.concatenate([ne[:1], ne[:-1]])
    nne[:, -1] = ne[:, -1]
    return _bordered(b, gap_value(left, n, b[:-1, :-1], ne, ww, nn, nne))


def _det(m: np.ndarray) -> float:
    (a, b, c), (d, e, f), (g, h, i) = m.tolist()
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def least_squares_weights(b: np.ndarray) -> list[int]:
    near = np.stack([b[1:, :-1].ravel(), b[:-1, 1:].ravel(), b[:-1, :-1].ravel()]).astype(float)
    a, y = near @ near.T, near @ b[1:, 1:].ravel().astype(float)
    det = _det(a)
    if abs(det) <= 1e-5:
        return [256, 256, -256]
    out = []
    for k in range(3):
        m = a.copy()
        m[:, k] = y
        out.append(half_away(_det(m) / det * 256.0))
    return out


def _surface(order: int, coefs: list[int], w: int, h: int) -> np.ndarray:
    u, v = 2 * np.arange(w) - (w - 1), 2 * np.arange(h)[:, None] - (h - 1)
    us, vs = max(1, w - 1), max(1, h - 1)
    out = np.zeros((h, w), np.int64)
    for k in range(TERMS[order]):
        i, j = U_POWER[k], V_POWER[k]
        out += tdiv(coefs[k] * (u**i * v**j), UNIT * us**i * vs**j)
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Elimination with row pivots; None if a pivot is under 1e-9."""
    m = np.column_stack([a, b])
    n = len(a)
    for i in range(n):
        p = i + int(np.abs(m[i:, i]).argmax())
        if abs(m[p, i]) < 1e-9:
            return None
        m[[i, p]] = m[[p, i]]
        m[i + 1 :] -= np.outer(m[i + 1 :, i] / m[i, i], m[i])
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        x[i] = (m[i, n] - m[i, i + 1 : n] @ x[i + 1 :]) / m[i, i]
    return x


def shannon(v: np.ndarray) -> float:
    if not v.size:
        return 0.0
    n = np.unique(v, return_counts=True)[1] / v.size
    return float(-(n * np.log2(n)).sum())


def fit_surface(b: np.ndarray) -> list[int]:
    """Order and coefficients of the surface whose residuals cost least by entropy and 32 bits a parameter."""
    h, w = b.shape
    nu = (2 * np.arange(w) - (w - 1)) / max(1, w - 1)
    nv = ((2 * np.arange(h) - (h - 1)) / max(1, h - 1))[:, None]
    best, least = [1, 0, 0, 0], math.inf
    for order, k in TERMS.items():
        f = np.stack([(nu ** U_POWER[i] * nv ** V_POWER[i]).ravel() for i in range(k)])
        c = _solve(f @ f.T, f @ b.ravel().astype(float))
        if c is None:
            continue
        params = [order, *[half_away(max(-2147483600.0, min(2147483600.0, x * UNIT))) for x in c]]
        cost = shannon(b - _surface(order, params[1:], w, h)) * b.size + 32 * len(params)
        if cost < least:
            best, least = params, cost
    return best


def predict(kind: int, g: np.ndarray, r: Rect) -> tuple[np.ndarray, list[int]]:
    """(residuals, parameters) of a rectangle of a tile."""
    b, w, n, nw = _around(g, r)
    if kind == LEFT:
        return b - w, []
    if kind == GRADIENT:
        return b - (w + n - nw), []
    if kind == MED:
        hi, lo = np.maximum(w, n), np.minimum(w, n)
        return b - np.where(nw >= hi, lo, np.where(nw <= lo, hi, w + n - nw)), []
    if kind == GAP:
        return b - _gap(b), []
    if kind == LEAST_SQUARES:
        k = least_squares_weights(b)
        return b - _bordered(b, tdiv(k[0] * b[1:, :-1] + k[1] * b[:-1, 1:] + k[2] * b[:-1, :-1], 256)), k
    params = fit_surface(b)
    return b - _surface(params[0], params[1:], r[2], r[3]), params


def restore(kind: int, res: np.ndarray, params: list[int], g: np.ndarray, r: Rect) -> None:
    """Writes the rectangle's values into the tile; what stands left of and above it must be there."""
    x, y, w, h = r
    if kind == POLYNOMIAL:
        if not params or params[0] not in TERMS or len(params) < 1 + TERMS[params[0]]:
            raise RuntimeError("a surface needs an order from 1 to 3 and its coefficients")
        g[y : y + h, x : x + w] = res + _surface(params[0], params[1:], w, h)
        return
    if kind == LEAST_SQUARES and len(params) < 3:
        raise RuntimeError("least squares needs three weights")
    if kind in (GAP, LEAST_SQUARES):
        out = _from_edges(res)
        _wave(out, res, _gap_wave if kind == GAP else lambda z: tdiv(params[0] * z["W"] + params[1] * z["N"] + params[2] * z["NW"], 256))
        g[y : y + h, x : x + w] = out
        return
    z = np.zeros((h + 1, w + 1), np.int64)  # with what stands left of and above the rectangle
    z[0, 1:] = g[y - 1, x : x + w] if y else 0
    z[1:, 0] = g[y : y + h, x - 1] if x else 0
    z[0, 0] = g[y - 1, x - 1] if x and y else 0
    if kind == MED:
        wide = np.zeros((h + 1, w + 1), np.int64)
        wide[1:, 1:] = res
        _wave(z, wide, lambda n: np.where(n["NW"] >= np.maximum(n["W"], n["N"]), np.minimum(n["W"], n["N"]), np.where(n["NW"] <= np.minimum(n["W"], n["N"]), np.maximum(n["W"], n["N"]), n["W"] + n["N"] - n["NW"])))
        g[y : y + h, x : x + w] = z[1:, 1:]
    elif kind == LEFT:
        g[y : y + h, x : x + w] = np.cumsum(res, axis=1) + z[1:, :1]
    else:
        g[y : y + h, x : x + w] = np.cumsum(np.cumsum(res, axis=0), axis=1) + z[1:, :1] + z[:1, 1:] - z[0, 0]


def _from_edges(res: np.ndarray) -> np.ndarray:
    """A block with its first row summed from the left and its first column from above."""
    out = np.zeros_like(res)
    out[0], out[:, 0] = np.cumsum(res[0]), np.cumsum(res[:, 0])
    return out


def _gap_wave(z: dict[str, np.ndarray]) -> np.ndarray:
    ne = np.where(z["i"] + 1 < z["w"], z["NE"], z["N"])
    nn = np.where(z["j"] > 1, z["NN"], z["N"])
    nne = np.where((z["i"] + 1 < z["w"]) & (z["j"] > 1), z["NNE"], ne)
    return gap_value(z["W"], z["N"], z["NW"], ne, np.where(z["i"] > 1, z["WW"], z["W"]), nn, nne)


#: Rows up and columns back of each neighbour, in a table of fronts: front i + 2j holds all cells that need only earlier fronts.
_FRONT = {"W": (1, 0), "N": (2, 1), "NW": (3, 1), "NE": (1, 1), "WW": (2, 0), "NN": (4, 2), "NNE": (3, 2)}


def _wave(out: np.ndarray, res: np.ndarray, guess) -> None:
    """Fills ``out`` from its first row and column on with guess plus residual, front by front."""
    h, w = out.shape
    if h < 2 or w < 2:
        return
    j, i = np.mgrid[:h, :w]
    at = (i + 2 * j + 4, j + 2)
    fronts, add = np.zeros((w + 2 * h + 4, h + 2), np.int64), np.zeros((w + 2 * h + 4, h + 2), np.int64)
    fronts[at], add[at] = out, res
    for d in range(3, w + 2 * h - 2):
        a, b = max(1, (d - w + 2) // 2), min(h - 1, (d - 1) // 2) + 1
        if a >= b:
            continue
        rows = np.arange(a, b)
        z = {k: fronts[d + 4 - up, a + 2 - back : b + 2 - back] for k, (up, back) in _FRONT.items()}
        z |= {"i": d - 2 * rows, "j": rows, "w": w}
        fronts[d + 4, a + 2 : b + 2] = guess(z) + add[d + 4, a + 2 : b + 2]
    out[:] = fronts[at]


def second_pass(kind: int, res: np.ndarray) -> tuple[np.ndarray, list[int]]:
    h, w = res.shape
    if kind == AVERAGE:
        return res - _bordered(res, tdiv(res[1:, :-1], 2) + tdiv(res[:-1, 1:], 2)), []
    if kind == MEDIAN:
        a, b, c = res[1:, :-1], res[:-1, 1:], res[:-1, :-1]
        return res - _bordered(res, np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))), []
    return predict(POOL_KERNEL[kind], res, (0, 0, w, h))


def undo_second_pass(kind: int, res: np.ndarray, params: list[int]) -> np.ndarray:
    h, w = res.shape
    out = np.zeros_like(res)
    if kind in POOL_KERNEL:
        restore(POOL_KERNEL[kind], res, params, out, (0, 0, w, h))
        return out
    out = _from_edges(res)
    if kind == AVERAGE:
        _wave(out, res, lambda z: tdiv(z["W"], 2) + tdiv(z["N"], 2))
    else:
        _wave(out, res, lambda z: np.maximum(np.minimum(z["W"], z["N"]), np.minimum(np.maximum(z["W"], z["N"]), z["NW"])))
    return out


def _split(v: np.ndarray) -> np.ndarray:
    """One level of the reversible 5/3 transform along the last axis."""
    n = v.shape[-1]
    if n < 2:
        return v.copy()
    even, odd = v[..., ::2], v[..., 1::2]
    right = np.concatenate([even[..., 1:], even[..., -1:]], axis=-1)[..., : odd.shape[-1]]
    d = odd - ((even[..., : odd.shape[-1]] + right) >> 1)
    before = np.concatenate([d[..., :1], d], axis=-1)[..., : even.shape[-1]]
    after = np.concatenate([d, d[..., -1:]], axis=-1)[..., : even.shape[-1]]
    return np.concatenate([even + ((before + after + 2) >> 2), d], axis=-1)


def _join(c: np.ndarray) -> np.ndarray:
    n = c.shape[-1]
    if n < 2:
        return c.copy()
    m = (n + 1) // 2
    s, d = c[..., :m], c[..., m:]
    before = np.concatenate([d[..., :1], d], axis=-1)[..., :m]
    after = np.concatenate([d, d[..., -1:]], axis=-1)[..., :m]
    even = s - ((before + after + 2) >> 2)
    right = np.concatenate([even[..., 1:], even[..., -1:]], axis=-1)[..., : n - m]
    out = np.empty_like(c)
    out[..., ::2], out[..., 1::2] = even, d + ((even[..., : n - m] + right) >> 1)
    return out


def wavelet_levels(w: int, h: int) -> int:
    return next(k for k in (3, 2, 1, 0) if min(w, h) >= 2**k or not k)


def wavelet(b: np.ndarray, levels: int) -> np.ndarray:
    b = b.copy()
    h, w = b.shape
    for _ in range(levels):
        b[:h, :w] = _split(b[:h, :w])
        b[:h, :w] = _split(b[:h, :w].T).T
        h, w = (h + 1) // 2, (w + 1) // 2
    return b


def unwavelet(c: np.ndarray, levels: int) -> np.ndarray:
    c = c.copy()
    sizes = [c.shape]
    for _ in range(levels - 1):
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    for h, w in reversed(sizes[:levels]):
        c[:h, :w] = _join(c[:h, :w].T).T
        c[:h, :w] = _join(c[:h, :w])
    return c


def _activity(v: np.ndarray) -> np.ndarray:
    return np.digitize(np.abs(v), [3, 9, 33])


def contexts(res: np.ndarray, extended: bool, plane: int = 0) -> np.ndarray:
    if not extended:
        return np.full(res.size, 4 * plane)
    z = np.pad(res, ((1, 0), (1, 0)))
    return (np.maximum(_activity(z[1:, :-1]), _activity(z[:-1, 1:])) + 4 * plane).ravel()


def symbols(res: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, class, run, remainder) of a plane in raster order."""
    v = res.ravel()
    zero = v == 0
    edge = np.diff(np.concatenate([[0], zero.view(np.int8), [0]]))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    runs = last - first
    pieces = -(-runs // 255)
    start = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(255, np.repeat(last, pieces) - start)
    some = np.nonzero(~zero)[0]
    zz = np.where(v[some] >= 0, 2 * v[some], -2 * v[some] - 1)
    mag = np.frexp(zz.astype(float))[1].astype(np.int64)
    at = np.concatenate([some, start])
    order = np.argsort(at, kind="stable")
    cols = (ctx[at], np.concatenate([mag, start * 0]), np.concatenate([some * 0, length]), np.concatenate([zz - (1 << np.maximum(mag - 1, 0)), start * 0]))
    return tuple(c[order] for c in cols)


def _entropy_bits(n: np.ndarray) -> float:
    n = n[n > 0].astype(float)
    return float(n.sum() * np.log2(n.sum()) - (n * np.log2(n)).sum()) if n.size else 0.0


def estimate_parts(planes: list[np.ndarray], extended: bool = False) -> tuple[float, float, float]:
    """Bits of class entropy by context, run entropy over all planes, and remainders."""
    ctx, mag, run, _ = (np.concatenate(c) for c in zip(*[symbols(p, contexts(p, extended, i)) for i, p in enumerate(planes)], strict=True))
    classes = sum(_entropy_bits(np.bincount(mag[ctx == c])) for c in np.unique(ctx))
    return classes, _entropy_bits(np.bincount(run[run > 0])), float(np.maximum(mag - 1, 0).sum())


def estimate(res: np.ndarray, extended: bool = False) -> float:
    """Bits of a plane, to six digits, so that sums in another order compare alike."""
    if extended:
        return round(sum(estimate_parts([res], True)), 6)
    v = res.ravel()
    places = np.flatnonzero(v)
    some = v[places]
    mag = (((some << 1) ^ (some >> 63)).astype(np.float64).view(np.int64) >> 52) - 1022  # bits of the zigzag numbers, from their exponents
    at = np.concatenate([[-1], places, [v.size]])
    gaps = np.diff(at) - 1
    gaps = gaps[gaps > 0]
    full, rest = int((gaps // 255).sum()), gaps % 255
    runs = np.bincount(rest[rest > 0], minlength=256)
    runs[255] += full
    classes = np.bincount(mag, minlength=34)
    classes[0] = runs.sum()
    return round(_entropy_bits(classes) + _entropy_bits(runs) + float(mag.sum() - mag.size), 6)


class Choice:
    """What a block is coded with. ``planes``: residuals of the value or metre plane, and of the digit plane if there is one; ``saved``: bits that the second pass saves."""

    saved = 0.0

    def __init__(self, bits, primary=None, second=NONE, params=(), params2=(), digit=None, planes=()):
        self.bits, self.primary, self.second, self.params, self.params2, self.digit, self.planes = bits, primary, second, list(params), list(params2), digit, list(planes)


def select(g: np.ndarray, r: Rect, multiplier: int = 1, extended: bool = False, use_wavelet: bool = False, bank: tuple[int, ...] = BANK) -> Choice:
    """The cheapest coding of a rectangle; earlier candidates win ties."""
    x, y, w, h = r
    b = g[y : y + h, x : x + w]
    if use_wavelet:
        c = wavelet(b, wavelet_levels(w, h))
        return Choice(estimate(c, extended), planes=[c])
    span = int(b.max() - b.min())
    kinds = (LEFT,) if span == 0 else tuple(k for k in bank if k not in (POLYNOMIAL, MED)) if span > 200 else bank
    m = tdiv(g, multiplier) if multiplier > 1 else g
    best = Choice(math.inf)
    for k in kinds:
        res, params = predict(k, m, r)
        base = low = estimate(res, extended)
        took, coded, more = NONE, res, []
        if 100 * int((res == 0).sum()) <= 95 * res.size:
            for s in range(AVERAGE, LEAST_SQUARES2 + 1):
                again, extra = second_pass(s, res)
                cost = 32 * len(extra) + estimate(again, extended)
                if cost < (base - 16 if took == NONE else low):
                    took, coded, more, low = s, again, extra, cost
        bits = 8 + 32 * len(params) + low
        if bits < best.bits:
            best = Choice(bits, k, took, params, more, planes=[coded])
            best.saved = base - (low - 32 * len(more)) if took != NONE else 0.0
    if multiplier > 1:
        p = g - m * multiplier
        low = math.inf
        for k in (GRADIENT, LEFT, GAP, IDENTITY):
            res = p[y : y + h, x : x + w] if k == IDENTITY else predict(k, p, r)[0]
            bits = 8 + estimate(res, extended)
            if bits < low:
                low, best.digit, plane = bits, k, res
        best.bits += low
        best.planes.append(plane)
    return best


def quadtree(g: np.ndarray, least: int, choose) -> list[tuple[Rect, Choice]]:
    """Leaves of a tile in Z order. ``choose(rect)`` gives a :class:`Choice`."""

    def visit(r: Rect) -> tuple[float, list]:
        x, y, w, h = r
        whole = choose(r)
        if w <= least or h <= least or whole.bits < w * h:
            return whole.bits + 1, [(r, whole)]
        a, b = w // 2, h // 2
        parts = [visit(q) for q in ((x, y, a, b), (x + a, y, w - a, b), (x, y + b, a, h - b), (x + a, y + b, w - a, h - b))]
        cost = sum(p[0] for p in parts)
        return (cost + 1, [leaf for p in parts for leaf in p[1]]) if cost < whole.bits else (whole.bits + 1, [(r, whole)])

    return visit((0, 0, g.shape[1], g.shape[0]))[1]
