"""The choice of a predictor for given blocks, in NumPy over many blocks at once.

Rows stay rows: a neighbour is the last cell there is in its column or row, as by windows, so rows of a grid may be missing or end early."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from orogen.operators.kernels import gap_value, tdiv

NAMES = ("sb", "level", "node", "y", "x", "q")
CHOICE = "sb long, level int, node long, pid int, second int, bits double"
RUN = 255


def _numbers(*keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of equal keys."""
    new = np.zeros(keys[0].size, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _before(key: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Index of the cell before each one on its line, -1 where there is none."""
    order = np.lexsort((place, line, key))
    same = (key[order][1:] == key[order][:-1]) & (line[order][1:] == line[order][:-1])
    out = np.full(key.size, -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _of(a: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    return np.where(at >= 0, a[at], none)


def _places(key: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Index of each neighbour of the cells within their key."""
    w, n = _before(key, y, x), _before(key, x, y)
    e = np.full(w.size, -1)
    e[w[w >= 0]] = np.flatnonzero(w >= 0)
    nn = _of(n, n, -1)
    return {"W": w, "N": n, "NW": _of(n, w, -1), "NE": _of(n, e, -1), "WW": _of(w, w, -1), "NN": nn, "NNE": _of(nn, e, -1)}


def _half_away(v: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(v) + 0.5), v)


def _det(m: list) -> np.ndarray:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


class Cells:
    """Cells of whole blocks in order of block and raster. ``of``: the number of each cell's block."""

    def __init__(self, of: np.ndarray, y: np.ndarray, x: np.ndarray):
        self.of, self.count = of, np.bincount(of)
        self.first = np.cumsum(self.count) - self.count
        self.places = p = _places(of, y, x)
        self.top, self.side = p["N"] < 0, p["W"] < 0
        self.inner = ~(self.top | self.side)
        if (self.inner & (p["NW"] < 0)).any():
            raise ValueError("a cell has a left and an upper neighbour, but none beside both")
        n = np.arange(int(self.count.max()) + 1, dtype=float)
        n[1:] *= np.log2(n[1:])
        self.nlog = n
        head = np.zeros(of.size, bool)
        head[self.first] = True
        self.head = head

    def around(self, v: np.ndarray) -> dict[str, np.ndarray]:
        """Values of the neighbours; NE, WW, NN and NNE as what stands in for them."""
        p, z = self.places, {}
        for k, other in (("W", None), ("N", None), ("NW", None), ("NE", "N"), ("WW", "W"), ("NN", "N"), ("NNE", "NE")):
            z[k] = np.where(p[k] >= 0, v[p[k]], 0 if other is None else z[other])
        return z

    def edges(self, inner: np.ndarray, z: dict) -> np.ndarray:
        """First row from the left, first column from above, the corner from nothing."""
        return np.where(self.top, z["W"], np.where(self.side, z["N"], inner))

    def gap(self, v: np.ndarray, z: dict) -> np.ndarray:
        return self.edges(gap_value(z["W"], z["N"], z["NW"], z["NE"], z["WW"], z["NN"], z["NNE"]), z)

    def average(self, v: np.ndarray, z: dict) -> np.ndarray:
        return self.edges(tdiv(z["W"], 2) + tdiv(z["N"], 2), z)

    def median(self, v: np.ndarray, z: dict) -> np.ndarray:
        w, n = z["W"], z["N"]
        return self.edges(np.maximum(np.minimum(w, n), np.minimum(np.maximum(w, n), z["NW"])), z)

    def least_squares(self, v: np.ndarray, z: dict) -> np.ndarray:
        near = [np.where(self.inner, z[k], 0).astype(float) for k in ("W", "N", "NW")]
        x, total = v.astype(float), lambda c: np.add.reduceat(c, self.first)
        a = [[None] * 3 for _ in range(3)]
        for i in range(3):
            for j in range(i, 3):
                a[i][j] = a[j][i] = total(near[i] * near[j])
        b, det = [total(c * x) for c in near], _det(a)
        some, guess = np.abs(det) > 1e-5, 0
        for k, (name, fallback) in enumerate((("W", 256), ("N", 256), ("NW", -256))):
            top = _det([[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)])
            weight = np.where(some, _half_away(top / np.where(some, det, 1.0) * 256.0), fallback)
            if not (np.abs(weight) < 2.0**63).all():
                raise OverflowError("a weight beyond 64 bits")
            guess = guess + weight.astype(np.int64)[self.of] * z[name]
        return self.edges(tdiv(guess, 256), z)

    def bits(self, r: np.ndarray) -> np.ndarray:
        """Bits of each block's residuals, to six digits: class entropy, run-length entropy and remainders."""
        n, zero = self.count.size, r == 0
        some, of = r[~zero], self.of[~zero]
        mag = (((some << 1) ^ (some >> 63)).astype(np.float64).view(np.int64) >> 52) - 1022
        classes = np.bincount(of * 66 + mag, minlength=n * 66).reshape(n, 66)
        start = zero.copy()
        start[1:] &= ~zero[:-1] | self.head[1:]
        of = self.of[start]
        length = np.bincount(np.cumsum(start)[zero] - 1, minlength=of.size)
        full, rest = length // RUN, length % RUN
        runs = np.bincount((of * 256 + rest)[rest > 0], minlength=n * 256).reshape(n, 256)
        runs[:, RUN] += np.bincount(of, full, minlength=n).astype(np.int64)
        t = runs.sum(axis=1)
        classes[:, 0] = t
        left = classes[:, 2:] @ np.arange(1, 65)
        log = self.nlog
        return np.round(log[classes.sum(axis=1)] - log[classes].sum(axis=1) + left + log[t] - log[runs].sum(axis=1), 6)


def _left(v: np.ndarray, z: dict) -> np.ndarray:
    return z["W"]


def _gradient(v: np.ndarray, z: dict) -> np.ndarray:
    return z["W"] + z["N"] - z["NW"]


def _med(v: np.ndarray, z: dict) -> np.ndarray:
    w, n, a = z["W"], z["N"], z["NW"]
    hi, lo = np.maximum(w, n), np.minimum(w, n)
    return np.where(a >= hi, lo, np.where(a <= lo, hi, w + n - a))


def _best(cols: dict[str, np.ndarray], bank: tuple[tuple[int, int], ...], pool: bool) -> tuple[np.ndarray, ...]:
    """(sb, level, node, pid, second, bits) of the blocks of whole superblocks."""
    order = np.lexsort([cols[k] for k in ("x", "y", "node", "level", "sb")])
    sb, level, node, y, x, q = (cols[k][order] for k in NAMES)
    cells = Cells(_numbers(sb, level, node), y, x)
    z = cells.around(q)
    p = _places(_numbers(sb, level), y, x)
    wide = {k: _of(q, p[k], 0) for k in ("W", "N", "NW")}
    guess: dict[int, Callable] = {0: lambda: _gradient(q, wide), 1: lambda: _left(q, wide), 2: lambda: _med(q, wide), 4: lambda: cells.gap(q, z), 5: lambda: cells.least_squares(q, z)}
    again = ((1, 0, cells.average), (2, 0, cells.median), (3, 0, _left), (4, 0, _gradient), (5, 0, cells.gap), (6, 3, cells.least_squares))
    span = np.maximum.reduceat(q, cells.first) - np.minimum.reduceat(q, cells.first)
    best, pid, second = np.full(span.size, np.inf), np.zeros(span.size, np.int32), np.zeros(span.size, np.int32)
    for kind, params in bank:
        allowed = np.where(span == 0, kind == 1, (span <= 200) | (kind != 2))
        if not allowed.any():
            continue
        r = q - guess[kind]()
        low, took = cells.bits(r), np.zeros(span.size, np.int32)
        go = 100 * np.bincount(cells.of, r == 0) <= 95 * cells.count
        if pool and (go & allowed).any():
            near, least, which = cells.around(r), np.full(span.size, np.inf), took.copy()
            for number, more, f in again:
                cost = cells.bits(r - f(r, near)) + 32 * more
                which[cost < least] = number
                least = np.minimum(cost, least)
            take = go & (least < low - 16)
            low, took = np.where(take, least, low), np.where(take, which, 0)
        total = np.round(low + 8 + 32 * params, 6)
        better = allowed & (total < best)
        best[better], pid[better], second[better] = total[better], kind, took[better]
    return sb[cells.first], level[cells.first], node[cells.first], pid, second, best


def chooser(bank: tuple[tuple[int, int], ...], pool: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (sb, level, node, y, x, q) with those of a superblock together, to :data:`CHOICE`. Held at a time: a batch and the superblock that goes on behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(parts: list[dict]) -> pa.RecordBatch:
            out = _best({k: np.concatenate([p[k] for p in parts]) for k in NAMES}, bank, pool)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in CHOICE.split(", ")])

        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for k in NAMES}
            cut = int(np.flatnonzero(np.diff(cols["sb"], prepend=~cols["sb"][0]))[-1])  # where the last superblock begins
            if cut or held and held[-1]["sb"][-1] != cols["sb"][0]:
                yield ready([*held, {k: v[:cut] for k, v in cols.items()}])
                held = []
            held.append({k: v[cut:] for k, v in cols.items()})
        if held:
            yield ready(held)

    return run
