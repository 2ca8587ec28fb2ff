"""A grid's blocks in one file: header, payloads, index. Written in tile order, read by ranges of the index.

``spark.read.format("orogen")`` after :func:`register`, or :func:`read`. A task reads a
range of index entries and the payloads that they name, so neither the index
nor the file has to fit anywhere; blocks outside a region are not read."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orogen.plans.staging import stage

# Fixed values of the format: little-endian header, then the flags' bits, then an index entry.
MAGIC = b"OROG"
HEAD, AFTER_WKT, OFFSET_AT_END, NODATA = "<4sHB6dI", "<IIdH", "<Q", "<d"
HAS_NODATA, NO_TREE = 2, 8
ENTRY = struct.Struct("<IIIIQQI")
COUNT = struct.Struct("<I")

TILE, ENTRIES_A_TASK, BYTES_A_BATCH = 512, 4096, 8 << 20
IDENTITY = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
INDEX = "sb long, leaf int, x long, y long, w int, h int, offset long, length long, crc long"


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    precision: float = 1.0
    transform: tuple[float, ...] = IDENTITY  # origin x, pixel width, rotation x, origin y, rotation y, pixel height
    wkt: str = ""
    nodata: float | None = None
    extended: bool = False
    use_wavelet: bool = False
    tree: bool = True
    index_offset: int = 0

    def pack(self) -> bytes:
        flags = (HAS_NODATA if self.nodata is not None else 0) | (0 if self.tree else NO_TREE)
        wkt = self.wkt.encode()
        out = struct.pack(HEAD, MAGIC, flags, int(self.use_wavelet), *self.transform, len(wkt)) + wkt
        out += struct.pack(AFTER_WKT, self.width, self.height, self.precision, int(self.extended)) + struct.pack(OFFSET_AT_END, self.index_offset)
        return out + (struct.pack(NODATA, self.nodata) if self.nodata is not None else b"")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise RuntimeError("the container ends early")
    return got


def read_header(path: str) -> tuple[Header, int]:
    """Header and the number of blocks; a RuntimeError if the file cannot be such a container."""
    where, inner = _file_system(path)
    size = where.get_file_info(inner).size
    if size is None:
        raise RuntimeError(f"cannot open {path}")
    with where.open_input_file(inner) as f:
        magic, flags, wavelet, *transform, n = struct.unpack(HEAD, _exactly(f, struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise RuntimeError("not a container of this format")
        if n > size:
            raise RuntimeError("the container ends early")
        wkt = _exactly(f, n).decode()
        width, height, precision, model = struct.unpack(AFTER_WKT, _exactly(f, struct.calcsize(AFTER_WKT)))
        (at,) = struct.unpack(OFFSET_AT_END, _exactly(f, 8))
        nodata = struct.unpack(NODATA, _exactly(f, 8))[0] if flags & HAS_NODATA else None
        if model > 1:
            raise RuntimeError("the container names a context model that there is not")
        if not 0 < at <= size - COUNT.size:
            raise RuntimeError("the index lies outside the container")
        f.seek(at)
        (blocks,) = COUNT.unpack(_exactly(f, COUNT.size))
        if at + COUNT.size + blocks * ENTRY.size > size:
            raise RuntimeError("the index is larger than the container")
    return Header(width, height, precision, tuple(transform), wkt, nodata, bool(model), bool(wavelet), not flags & NO_TREE, at), blocks


def write(blocks: DataFrame, header: Header, path: str, name: str = "blocks") -> tuple[int, int]:
    """Blocks of :func:`orogen.operators.codec.encode` to one file; the number of blocks and of bytes.

    Blocks are coded by the executors and written to the shared folder first. One
    writer can append to a file, so it is the driver that copies them, a partition at a
    time in tile order; index entries go to a spool of their own beside the file."""
    ready = stage(blocks.select("sb", "leaf", "x", "y", "w", "h", "payload", "crc"), name).orderBy("sb", "leaf")
    where, inner = _file_system(path)
    start = len(header.pack())
    at, n = start, 0
    with where.open_output_stream(inner + ".payload") as payload, where.open_output_stream(inner + ".index") as index:
        for b in ready.toLocalIterator():
            payload.write(b.payload)
            index.write(ENTRY.pack(b.x, b.y, b.w, b.h, at, len(b.payload), b.crc))
            at, n = at + len(b.payload), n + 1
    with where.open_output_stream(inner) as out:
        out.write(replace(header, index_offset=at).pack())
        for part, before in ((inner + ".payload", b""), (inner + ".index", COUNT.pack(n))):
            out.write(before)
            with where.open_input_stream(part) as f:
                while chunk := f.read(BYTES_A_BATCH):
                    out.write(chunk)
            where.delete_file(part)
    return n, at + COUNT.size + n * ENTRY.size


@dataclass
class Entries(InputPartition):
    first: int
    last: int


class BlockReader(DataSourceReader):
    """Options: ``path``; ``region`` as x,y,w,h, to read only blocks of tiles that it meets; ``payload`` false for the index alone."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.region = tuple(int(v) for v in options["region"].split(",")) if options.get("region") else None
        self.header, self.n = read_header(self.path)

    def partitions(self) -> list[InputPartition]:
        return [Entries(i, min(i + ENTRIES_A_TASK, self.n)) for i in range(0, self.n, ENTRIES_A_TASK)] or [Entries(0, 0)]

    def _wanted(self, x: int, y: int) -> bool:
        if self.region is None:
            return True
        rx, ry, rw, rh = self.region
        return rx // TILE <= x // TILE <= (rx + rw - 1) // TILE and ry // TILE <= y // TILE <= (ry + rh - 1) // TILE

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sb", pa.int64()), ("leaf", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
        if self.payload:
            schema = schema.append(pa.field("payload", pa.binary()))
        where, inner = _file_system(self.path)
        at = self.header.index_offset + COUNT.size
        with where.open_input_file(inner) as f:
            f.seek(at + partition.first * ENTRY.size)
            rows, size = [], 0
            for i, (x, y, w, h, offset, length, crc) in enumerate(ENTRY.iter_unpack(_exactly(f, (partition.last - partition.first) * ENTRY.size)), partition.first):
                if not self._wanted(x, y):
                    continue
                row = [(y // TILE << 20) + x // TILE, i, x, y, w, h, offset, length, crc]
                if self.payload:
                    if offset + length > self.header.index_offset:
                        raise RuntimeError("a block lies outside the container")
                    f.seek(offset)
                    row.append(_exactly(f, length))
                    size += length
                rows.append(row)
                if size >= BYTES_A_BATCH:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orogen"

    def schema(self) -> str:
        return INDEX + (", payload binary" if self.options.get("payload", "true").lower() == "true" else "")

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Blocks)


def read(spark: SparkSession, path: str, region: tuple[int, int, int, int] | None = None, payload: bool = True) -> DataFrame:
    """Index entries of a container, with their payloads; ``leaf`` is the place in the index, which is Z order within a tile."""
    register(spark)
    r = spark.read.format("orogen").option("payload", str(payload).lower())
    return (r.option("region", ",".join(map(str, region))) if region else r).load(path)
