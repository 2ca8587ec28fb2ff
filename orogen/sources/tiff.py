"""Rasters as TIFF files: the first band as pixels (y, x, z), and back as tiled, deflated doubles.

Reads strips and tiles, plain or deflated, with or without differences, of whole numbers and
floats of 8 to 64 bits in either byte order, in files of the classic and the 64-bit kind. A task reads
some chunks of the file; chunks outside a region are not read."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orogen.api import Raster, _shape
from orogen.plans.staging import stage
from orogen.report import crs_of
from orogen.sources.container import IDENTITY, _exactly, _file_system

# Fixed values of the format: tags, then the size and code of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 1025, 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CODES = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
PLAIN, DEFLATE = 1, (8, 32946)
NO_DIFFERENCES, HORIZONTAL, FLOATING = 1, 2, 3

TILE = 256
CELLS_A_TASK, CELLS_A_BATCH = 4 << 20, 1 << 20
SMALL_FILE = 4_000_000_000  # above it offsets take 64 bits
PIXEL = pa.schema([("y", pa.int64()), ("x", pa.int64()), ("z", pa.float64())])


@dataclass(frozen=True)
class Layout:
    """What every task needs to know of a file."""

    width: int
    height: int
    chunk_width: int
    chunk_height: int
    samples: int  # in a chunk's pixel
    kind: str  # of a sample, as NumPy names it, with the byte order
    compression: int
    predictor: int
    nodata: float | None
    transform: tuple[float, ...]
    wkt: str

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk_width)

    @property
    def chunks(self) -> int:
        return self.across * -(-self.height // self.chunk_height)


def _fields(f, size: int) -> tuple[str, dict[int, tuple]]:
    """The byte order and the fields of the first directory."""
    head = _exactly(f, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise RuntimeError("not a TIFF file")
    big = kind == 43
    word = order + ("Q" if big else "I")
    (at,) = struct.unpack(word, _exactly(f, 8) if big else head[4:])
    f.seek(min(at, size))
    (n,) = struct.unpack(order + ("Q" if big else "H"), _exactly(f, 8 if big else 2))
    entry = struct.Struct(order + ("HHQ8s" if big else "HHI4s"))
    if n * entry.size > size:
        raise RuntimeError("the file's directory is larger than the file")
    out = {}
    for tag, code, count, value in list(entry.iter_unpack(_exactly(f, n * entry.size))):
        if code not in TYPES:
            continue
        c = TYPES[code]
        length = count * struct.calcsize("<" + c)
        if length > size:
            raise RuntimeError("a field is larger than the file")
        if length > len(value):
            f.seek(min(struct.unpack(word, value)[0], size))
            value = _exactly(f, length)
        out[tag] = (value[:count].split(b"\0")[0].decode("latin-1"),) if c == "s" else struct.unpack(f"{order}{count}{c}", value[:length])
    return order, out


def _transform(fields: dict[int, tuple]) -> tuple[float, ...]:
    if len(fields.get(MATRIX, ())) == 16:
        m = fields[MATRIX]
        return (m[3], m[0], m[1], m[7], m[4], m[5])
    scale, tie = fields.get(PIXEL_SCALE, ()), fields.get(TIE_POINT, ())
    if len(scale) < 2 or len(tie) < 6:
        return IDENTITY
    return (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])


def _wkt(keys: tuple) -> str:
    """A projection text that holds the code, which is all that the file gives."""
    known = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    for key, kind in ((PROJECTED_KEY, "PROJCS"), (GEOGRAPHIC_KEY, "GEOGCS")):
        if 0 < known.get(key, 0) < 32767:
            return f'{kind}["EPSG:{known[key]}",AUTHORITY["EPSG","{known[key]}"]]'
    return ""


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def open_layout(path: str) -> tuple[Layout, tuple, tuple]:
    """Layout, offsets and lengths of the first band's chunks; a RuntimeError if the file cannot be read."""
    where, inner = _file_system(path)
    size = where.get_file_info(inner).size
    if size is None:
        raise RuntimeError(f"cannot open {path}")
    with where.open_input_file(inner) as f:
        order, fields = _fields(f, size)
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    tiled = TILE_OFFSETS in fields
    chunk = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not (width > 0 and height > 0 and min(chunk) > 0):
        raise RuntimeError("the raster has no pixels")
    bits, form = one(BITS, 1), one(SAMPLE_FORMAT, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(form, "") + str(bits // 8)
    if kind not in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8") or bits % 8:
        raise RuntimeError(f"samples of {bits} bits and format {form} are not read")
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, NO_DIFFERENCES)
    if compression != PLAIN and compression not in DEFLATE:
        raise RuntimeError(f"compression {compression} is not read")
    if predictor not in (NO_DIFFERENCES, HORIZONTAL, FLOATING) or (predictor == FLOATING and form != 3):
        raise RuntimeError(f"predictor {predictor} is not read")
    layout = Layout(width, height, *chunk, samples if one(PLANAR, 1) == 1 else 1, order + kind, compression, predictor, _number(one(NODATA, "")), _transform(fields), _wkt(fields.get(GEO_KEYS, ())))
    offsets, lengths = (fields.get(t, ())[: layout.chunks] for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if len(offsets) != layout.chunks or len(lengths) != layout.chunks or any(o + n > size for o, n in zip(offsets, lengths, strict=True)):
        raise RuntimeError("a part of the raster lies outside the file")
    return layout, offsets, lengths


def unpack(data: bytes, rows: int, layout: Layout) -> np.ndarray:
    """The first band of a chunk of ``rows`` rows."""
    dtype = np.dtype(layout.kind)
    across = layout.chunk_width * layout.samples
    if layout.compression != PLAIN:
        try:
            data = zlib.decompress(data)
        except zlib.error as e:
            raise RuntimeError("a part of the raster is corrupt") from e
    need = rows * across * dtype.itemsize
    if len(data) < need:
        raise RuntimeError("a part of the raster is too short")
    flat = np.frombuffer(data, np.uint8, need).reshape(rows, across * dtype.itemsize)
    if layout.predictor == FLOATING:  # differences of bytes, the highest bytes of all samples first
        sums = np.cumsum(flat.reshape(rows, -1, layout.samples), axis=1, dtype=np.uint8)
        flat = np.ascontiguousarray(sums.reshape(rows, dtype.itemsize, across).transpose(0, 2, 1))
        return flat.reshape(rows, -1).view(dtype.newbyteorder(">"))[:, :: layout.samples].astype(np.float64)
    band = flat.view(dtype)[:, :: layout.samples]
    if layout.predictor == HORIZONTAL:
        whole = np.dtype(f"u{dtype.itemsize}")
        sums = np.cumsum(flat.view(whole.newbyteorder(layout.kind[0]))[:, :: layout.samples].astype(whole), axis=1, dtype=whole)
        band = sums.view(dtype.newbyteorder("="))
    return band.astype(np.float64)


@dataclass
class Chunks(InputPartition):
    entries: list[tuple[int, int, int]]


class TiffReader(DataSourceReader):
    """Options: ``path``; ``region`` as x,y,w,h, to read only what lies in it."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.layout = open_layout(self.path)[0]
        whole = (0, 0, self.layout.width, self.layout.height)
        self.region = tuple(int(v) for v in options["region"].split(",")) if options.get("region") else whole

    def _origin(self, i: int) -> tuple[int, int]:
        return i % self.layout.across * self.layout.chunk_width, i // self.layout.across * self.layout.chunk_height

    def partitions(self) -> list[InputPartition]:
        layout, offsets, lengths = open_layout(self.path)
        rx, ry, rw, rh = self.region
        met = []
        for i, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
            x, y = self._origin(i)
            if x < rx + rw and rx < x + layout.chunk_width and y < ry + rh and ry < y + layout.chunk_height:
                met.append((i, at, n))
        each = max(1, CELLS_A_TASK // (layout.chunk_width * layout.chunk_height))
        return [Chunks(met[i : i + each]) for i in range(0, len(met), each)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        layout = self.layout
        rx, ry, rw, rh = self.region
        where, inner = _file_system(self.path)
        with where.open_input_file(inner) as f:
            for i, at, n in partition.entries:
                x0, y0 = self._origin(i)
                inside = min(layout.chunk_height, layout.height - y0)
                if n == 0:  # a part that was never written
                    z = np.full((inside, layout.chunk_width), 0.0 if layout.nodata is None else layout.nodata)
                else:
                    f.seek(at)
                    z = unpack(_exactly(f, n), inside, layout)
                left, right = max(x0, rx), min(x0 + layout.chunk_width, rx + rw, layout.width)
                top, bottom = max(y0, ry), min(y0 + inside, ry + rh)
                z = z[top - y0 : bottom - y0, left - x0 : right - x0]
                step = max(1, CELLS_A_BATCH // max(1, z.shape[1]))
                for r in range(0, z.shape[0], step):
                    part = z[r : r + step]
                    ys, xs = np.mgrid[top + r : top + r + part.shape[0], left:right]
                    yield pa.RecordBatch.from_arrays([pa.array(ys.ravel()), pa.array(xs.ravel()), pa.array(part.ravel())], schema=PIXEL)


class Tiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orogen_tiff"

    def schema(self) -> str:
        return "y long, x long, z double"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read(spark: SparkSession, path: str, region: tuple[int, int, int, int] | None = None) -> Raster:
    """The first band as a raster, in the whole file's coordinates; with ``region`` (x, y, w, h) its pixels alone."""
    layout = open_layout(path)[0]
    spark.dataSource.register(Tiff)
    r = spark.read.format("orogen_tiff")
    return Raster((r.option("region", ",".join(map(str, region))) if region else r).load(path), layout.nodata, layout.transform, layout.wkt)


def pack(z: np.ndarray) -> bytes:
    """A tile of doubles: bytes in order of weight, as differences, deflated."""
    rows, across = z.shape
    planes = z.astype(">f8").view(np.uint8).reshape(rows, across, 8).transpose(0, 2, 1).reshape(rows, -1)
    return zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((rows, 1), np.uint8)).tobytes())


def _directory(fields: list[tuple[int, str, tuple | bytes]], big: bool) -> bytes:
    """Header, directory and the values that do not fit it."""
    room, word = (8, "<Q") if big else (4, "<I")
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    entry = "<HHQ" if big else "<HHI"
    start = len(head) + (8 if big else 2) + len(fields) * (struct.calcsize(entry) + room) + room
    out, more = head + struct.pack("<Q" if big else "<H", len(fields)), b""
    for tag, c, values in sorted(fields):
        data = values if c == "s" else struct.pack(f"<{len(values)}{c}", *values)
        out += struct.pack(entry, tag, CODES[c], len(values))
        if len(data) <= room:
            out += data.ljust(room, b"\0")
        else:
            out += struct.pack(word, start + len(more))
            more += data + b"\0" * (-len(data) % 8)
    return out + b"\0" * room + more


def write(raster: Raster, path: str) -> tuple[int, int]:
    """The raster as a file of doubles in tiles of 256 x 256; its width and height.

    Executors pack the tiles and write them to the shared folder; one writer can append to a file, so the
    driver copies them in order, a partition at a time, and holds the length of each. Pixels that are missing, and null ones, have the
    no-data value, or are NaN where there is none. Of pixels named twice one stays. Tiles without pixels are left out."""
    width, height = _shape(raster.pixels)
    across, down = -(-width // TILE), -(-height // TILE)
    empty = math.nan if raster.nodata is None else raster.nodata

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        z = np.full((TILE, TILE), empty)
        got = t.column("z").to_numpy()
        z[t.column("y").to_numpy() % TILE, t.column("x").to_numpy() % TILE] = np.where(t.column("z").is_null().to_numpy(), empty, got)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([pack(z)], pa.binary())})

    y, x = (F.col(c).cast("long") for c in "yx")
    cells = raster.pixels.select(y.alias("y"), x.alias("x"), F.col("z").cast("double").alias("z"))
    ready = stage(cells.groupBy((F.expr(f"y div {TILE}") * across + F.expr(f"x div {TILE}")).alias("tile")).applyInArrow(tile, "tile long, payload binary"), "tiles")
    lengths = np.zeros(across * down, np.int64)
    for r in ready.select("tile", F.length("payload").alias("n")).toLocalIterator():
        lengths[r["tile"]] = r["n"]
    big = int(lengths.sum()) + 16 * len(lengths) > SMALL_FILE
    word = "Q" if big else "I"
    ox, pw, rx, oy, ry, ph = raster.transform
    fields: list[tuple[int, str, tuple | bytes]] = [(WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (64,)), (COMPRESSION, "H", (DEFLATE[0],)), (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (1,)), (PLANAR, "H", (1,)), (PREDICTOR, "H", (FLOATING,))]
    fields += [(TILE_WIDTH, "H", (TILE,)), (TILE_HEIGHT, "H", (TILE,)), (SAMPLE_FORMAT, "H", (3,))]
    if tuple(raster.transform) != IDENTITY:
        plain = not rx and not ry and pw > 0 > ph
        fields += [(PIXEL_SCALE, "d", (pw, -ph, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, ox, oy, 0.0))] if plain else [(MATRIX, "d", (pw, rx, 0.0, ox, ry, ph, 0.0, oy, *[0.0] * 7, 1.0))]
    code, unit = crs_of(raster.wkt)
    if code.startswith("EPSG:") and code[5:].isdigit() and int(code[5:]) < 32767:
        flat = unit == "m"
        fields.append((GEO_KEYS, "H", (1, 1, 0, 3, MODEL_KEY, 0, 1, 1 if flat else 2, RASTER_KEY, 0, 1, 1, PROJECTED_KEY if flat else GEOGRAPHIC_KEY, 0, 1, int(code[5:]))))
    if raster.nodata is not None:
        fields.append((NODATA, "s", f"{raster.nodata!r}".encode() + b"\0"))
    index = lambda offsets: _directory([*fields, (TILE_OFFSETS, word, tuple(offsets)), (TILE_COUNTS, word, tuple(lengths.tolist()))], big)
    start = len(index([0] * len(lengths)))
    offsets = np.where(lengths > 0, start + np.cumsum(lengths) - lengths, 0)
    where, inner = _file_system(path)
    with where.open_output_stream(inner) as out:
        out.write(index(offsets.tolist()))
        for r in ready.orderBy("tile").select("payload").toLocalIterator():
            out.write(bytes(r["payload"]))
    return width, height
