"""Entropy coding of blocks, and whole grids coded tile by tile. A tile never looks outside itself, so tiles are coded anywhere."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators import kernels as kn
from orogen.operators.tiles import by_tile

TILE, LEAST = 512, 64
TOP, CARRY, WHOLE = 1 << 24, 0xFF000000, 0xFFFFFFFF
LENGTHS = struct.Struct("<II")
MOST_COUNT, GAIN, SLOWEST = 1 << 14, 32, 64


class Table:
    """Adaptive counts. Their sums, which the coder reads, are renewed after 4 symbols, then 8, and so on up to every 64."""

    def __init__(self, n: int, start: tuple[int, ...] = ()):
        self.n = [*start, *[1] * (n - len(start))]
        self.step = self.left = 4
        self.sums = [0, *accumulate(self.n)]

    def add(self, s: int) -> None:
        self.n[s] += GAIN
        self.left -= 1
        if not self.left:
            if sum(self.n) > MOST_COUNT:
                self.n = [x + 1 >> 1 for x in self.n]
            self.sums = [0, *accumulate(self.n)]
            self.step = self.left = min(SLOWEST, 2 * self.step)


def _tables() -> tuple[list[Table], Table]:
    """Counts of classes by context, small ones likelier, and of run lengths."""
    return [Table(33, (64, 32, 32, 24, 16, 16, 8, 8, 4, 4)) for _ in range(8)], Table(255, (8, 4, 2))


def code(steps: list[tuple[Table, int]]) -> bytes:
    """A range coder, a byte at a time: each symbol narrows the range to its share of its table's counts."""
    out, low, width = bytearray(), 0, WHOLE
    for t, s in steps:
        sums = t.sums
        unit = width // sums[-1]
        low += unit * sums[s]
        width = unit * (sums[s + 1] - sums[s])
        t.add(s)
        while width < TOP:
            if low > WHOLE:  # carry into what is written
                i = len(out) - 1
                while out[i] == 255:
                    out[i] = 0
                    i -= 1
                out[i] += 1
                low &= WHOLE
            out.append(low >> 24)
            low, width = low << 8 & WHOLE, width << 8
    if low > WHOLE:
        i = len(out) - 1
        while out[i] == 255:
            out[i] = 0
            i -= 1
        out[i] += 1
    return bytes(out) + (low & WHOLE).to_bytes(4, "big")


class Source:
    """The other end of :func:`code`."""

    def __init__(self, data: bytes):
        self.data, self.at, self.width = data, 4, WHOLE
        self.value = int.from_bytes(data[:4], "big")

    def next(self, t: Table) -> int:
        sums = t.sums
        unit = self.width // sums[-1]
        s = min(bisect_right(sums, self.value // unit), len(sums) - 1) - 1
        self.value -= unit * sums[s]
        self.width = unit * (sums[s + 1] - sums[s])
        t.add(s)
        while self.width < TOP:
            if self.at >= len(self.data):
                raise RuntimeError("a block's bit stream ended early")
            self.value = self.value << 8 | self.data[self.at]
            self.at += 1
            self.width <<= 8
        return s


def raw_bits(rem: np.ndarray, n: np.ndarray) -> bytes:
    """The last ``n`` bits of each number, one after another."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.packbits(((np.repeat(rem, n) >> (np.repeat(n, n) - 1 - at)) & 1).astype(np.uint8)).tobytes()


def from_raw_bits(data: bytes, n: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: n.sum()].astype(np.int64)
    if len(bits) < n.sum():
        raise RuntimeError("a block's bit stream ended early")
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    sums = np.concatenate([[0], np.cumsum(bits << (np.repeat(n, n) - 1 - at))])
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n]


def write_plane(tables: tuple[list[Table], Table], res: np.ndarray, extended: bool, plane: int) -> bytes:
    """Lengths of two parts, classes and runs as coded, and the bits below each value's leading one as they are."""
    classes, runs = tables
    ctx, mag, run, rem = kn.symbols(res, kn.contexts(res, extended, plane))
    steps: list[tuple[Table, int]] = []
    for c, m, r in zip(ctx.tolist(), mag.tolist(), run.tolist(), strict=True):
        steps.append((classes[c], m))
        if r:
            steps.append((runs, r - 1))
    body, rest = code(steps), raw_bits(rem, np.maximum(mag - 1, 0))
    return LENGTHS.pack(len(body), len(rest)) + body + rest


def read_plane(tables: tuple[list[Table], Table], data: memoryview, w: int, h: int, extended: bool, plane: int) -> tuple[np.ndarray, int]:
    """The plane and how many bytes it took."""
    if len(data) < LENGTHS.size:
        raise RuntimeError("a block's bit stream ended early")
    (n_body, n_rest), n = LENGTHS.unpack(data[: LENGTHS.size]), w * h
    end = LENGTHS.size + n_body + n_rest
    if end > len(data):
        raise RuntimeError("a block's bit stream ended early")
    src, rest = Source(bytes(data[LENGTHS.size : LENGTHS.size + n_body])), bytes(data[LENGTHS.size + n_body : end])
    classes, runs = tables
    take, at = src.next, 0
    if extended:
        return _read_by_neighbours(classes, runs, src, rest, w, h, plane), end
    t, mags, places = classes[4 * plane], [], []
    while at < n:
        m = take(t)
        if m:
            mags.append(m)
            places.append(at)
            at += 1
        else:
            at += take(runs) + 1
    out, mag = np.zeros(n, np.int64), np.array(mags, np.int64)
    zz = (1 << np.maximum(mag - 1, 0)) + from_raw_bits(rest, np.maximum(mag - 1, 0)) if len(mag) else mag
    out[np.array(places, np.int64)] = np.where(zz & 1, -(zz >> 1) - 1, zz >> 1)
    return out.reshape(h, w), end


def _read_by_neighbours(classes: list[Table], runs: Table, src: Source, rest: bytes, w: int, h: int, plane: int) -> np.ndarray:
    """Where a symbol's context is the activity left of and above it, values are read one by one."""
    out, n, bit = [], w * h, 0
    act = lambda v: (abs(v) > 2) + (abs(v) > 8) + (abs(v) > 32)
    while len(out) < n:
        i = len(out)
        m = src.next(classes[4 * plane + max(act(out[i - 1]) if i % w else 0, act(out[i - w]) if i >= w else 0)])
        if not m:
            out += [0] * min(src.next(runs) + 1, n - i)
            continue
        k = m - 1
        some = int.from_bytes(rest[bit >> 3 : (bit >> 3) + 6].ljust(6, b"\0"), "big") >> (48 - (bit & 7) - k) & ((1 << k) - 1)
        bit += k
        zz = 1 << k | some
        out.append(zz >> 1 if not zz & 1 else -(zz >> 1) - 1)
    if bit > 8 * len(rest):
        raise RuntimeError("a block's bit stream ended early")
    return np.array(out, np.int64).reshape(h, w)


def pack(c: kn.Choice, mask: np.ndarray, split: bool, extended: bool, use_wavelet: bool) -> bytes:
    out = bytearray()
    if not use_wavelet:
        out.append(c.second << 5 | c.primary)
        if split:
            out.append(c.digit)
        for params in (c.params, c.params2)[: 1 + (c.second != kn.NONE)]:
            out.append(len(params))
            out += np.array(params, "<i4").tobytes()
    out.append(int(mask.any()))
    if mask.any():
        flat = mask.ravel()
        cuts = np.concatenate([[0], np.nonzero(np.diff(flat.astype(np.int8)))[0] + 1, [flat.size]])
        for run in ([0] if flat[0] else []) + np.diff(cuts).tolist():
            out += b"\xff\0" * (run // 255) + bytes([run % 255])
    tables = _tables()
    for i, plane in enumerate(c.planes):
        out += write_plane(tables, plane, extended, i)
    return bytes(out)


def _mask(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    out, done, value = np.zeros(n, bool), 0, False
    while done < n:
        run = 0
        while data[at] == 255:  # a long run goes on after a run of none
            run, at = run + 255, at + 2
        run += data[at]
        at += 1
        out[done : done + run] = value
        done, value = done + run, not value
    return out, at


def unpack(data: bytes, tile: np.ndarray, r: kn.Rect, multiplier: int, extended: bool, use_wavelet: bool) -> np.ndarray:
    """Writes a block into its tile and returns its mask; blocks come in Z order."""
    x, y, w, h = r
    src, at = memoryview(data), 0
    split = multiplier > 1 and not use_wavelet
    primary, second, digit, params = 0, kn.NONE, None, [[], []]
    try:
        if not use_wavelet:
            primary, second, at = src[0] & 31, src[0] >> 5, 1
            if split:
                digit, at = src[1], 2
            if primary not in kn.BANK or second > kn.LEAST_SQUARES2 or split and digit not in (kn.GRADIENT, kn.LEFT, kn.GAP, kn.IDENTITY):
                raise RuntimeError("a block names a predictor that there is not")
            for i in range(1 + (second != kn.NONE)):
                n = src[at]
                params[i] = np.frombuffer(src[at + 1 : at + 1 + 4 * n], "<i4").tolist()
                at += 1 + 4 * n
        mask, at = _mask(src, at + 1, w * h) if src[at] else (np.zeros(w * h, bool), at + 1)
    except (IndexError, ValueError):
        raise RuntimeError("a block's head ended early") from None
    tables = _tables()
    res, n = read_plane(tables, src[at:], w, h, extended, 0)
    if use_wavelet:
        tile[y : y + h, x : x + w] = kn.unwavelet(res, kn.wavelet_levels(w, h))
        return mask.reshape(h, w)
    if second != kn.NONE:
        res = kn.undo_second_pass(second, res, params[1])
    if not split:
        kn.restore(primary, res, params[0], tile, r)
        return mask.reshape(h, w)
    low, _ = read_plane(tables, src[at + n :], w, h, extended, 1)
    m = kn.tdiv(tile, multiplier)
    p = tile - m * multiplier
    kn.restore(primary, res, params[0], m, r)
    if digit == kn.IDENTITY:
        p[y : y + h, x : x + w] = low
    else:
        kn.restore(digit, low, [], p, r)
    tile[y : y + h, x : x + w] = (m * multiplier + p)[y : y + h, x : x + w]
    return mask.reshape(h, w)


def multiplier_of(precision: float) -> int:
    return kn.half_away(1.0 / precision) if precision < 1 else 1


def encode_tile(tile: np.ndarray, mask: np.ndarray, precision: float = 1.0, extended: bool = False, use_wavelet: bool = False, tree: bool = True, least: int = LEAST) -> list[tuple[kn.Rect, kn.Choice, bytes]]:
    m = multiplier_of(precision)
    if use_wavelet and m > 1:
        raise ValueError("the wavelet takes whole units only")
    choose = lambda r: kn.select(tile, r, m, extended, use_wavelet)
    h, w = tile.shape
    if tree:
        leaves = kn.quadtree(tile, least, choose)
    else:
        rects = [(x, y, min(least, w - x), min(least, h - y)) for y in range(0, h, least) for x in range(0, w, least)]
        leaves = [(r, choose(r)) for r in rects]
    return [((x, y, bw, bh), c, pack(c, mask[y : y + bh, x : x + bw], m > 1, extended, use_wavelet)) for (x, y, bw, bh), c in leaves]


BLOCKS = "sb long, leaf int, x long, y long, w int, h int, predictor int, second int, bits double, payload binary, crc long"


def encode(grid: DataFrame, precision: float = 1.0, extended: bool = False, use_wavelet: bool = False, tree: bool = True, size: int = TILE, least: int = LEAST) -> DataFrame:
    """Blocks of a grid (y, x, q, nodata): one shuffle by tile, then each tile on its own.

    A tile has a bound on its size, so a group does too. The result does not depend on the partitioning."""

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(df.x.min()), int(df.y.min())
        shape = (int(df.y.max()) - y0 + 1, int(df.x.max()) - x0 + 1)
        tile, mask = np.zeros(shape, np.int64), np.zeros(shape, bool)
        tile[df.y - y0, df.x - x0] = df.q
        mask[df.y - y0, df.x - x0] = df.nodata
        rows = [(key[0], i, x0 + x, y0 + y, w, h, -1 if c.primary is None else c.primary, c.second, c.bits, data, zlib.crc32(data)) for i, ((x, y, w, h), c, data) in enumerate(encode_tile(tile, mask, precision, extended, use_wavelet, tree, least))]
        return pd.DataFrame(rows, columns=["sb", "leaf", "x", "y", "w", "h", "predictor", "second", "bits", "payload", "crc"])

    sb = F.floor(F.col("y") / size) * (1 << 20) + F.floor(F.col("x") / size)
    return by_tile(grid.select(sb.alias("sb"), "y", "x", "q", "nodata")).applyInPandas(one, BLOCKS)


def decode(blocks: DataFrame, precision: float = 1.0, extended: bool = False, use_wavelet: bool = False) -> DataFrame:
    """(y, x, q, nodata) from blocks; a tile's blocks are decoded in Z order."""
    m = multiplier_of(precision)

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("leaf")
        x0, y0 = int(df.x.min()), int(df.y.min())
        shape = (int((df.y + df.h).max()) - y0, int((df.x + df.w).max()) - x0)
        tile, mask = np.zeros(shape, np.int64), np.zeros(shape, bool)
        for b in df.itertuples():
            if zlib.crc32(b.payload) != b.crc:
                raise RuntimeError(f"Block [{b.x},{b.y}] corrupt")
            r = (int(b.x) - x0, int(b.y) - y0, int(b.w), int(b.h))
            mask[r[1] : r[1] + r[3], r[0] : r[0] + r[2]] = unpack(bytes(b.payload), tile, r, m, extended, use_wavelet)
        y, x = np.mgrid[: shape[0], : shape[1]]
        return pd.DataFrame({"y": y.ravel() + y0, "x": x.ravel() + x0, "q": tile.ravel(), "nodata": mask.ravel()})

    return by_tile(blocks).applyInPandas(one, "y long, x long, q long, nodata boolean")


def region(blocks: DataFrame, x: int, y: int, w: int, h: int, size: int = TILE) -> DataFrame:
    """Blocks of the tiles that a region meets: a range filter on the tile key's parts, which reaches the scan."""
    row, col = F.shiftright("sb", 20), F.col("sb").bitwiseAND((1 << 20) - 1)
    return blocks.where(row.between(y // size, (y + h - 1) // size) & col.between(x // size, (x + w - 1) // size))
