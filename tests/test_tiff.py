"""TIFF files: round trips, and files of other layouts put together by hand."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from orogen import api
from orogen.__main__ import main
from orogen.sources import tiff

PLACE = (500000.0, 10.0, 0.0, 4500000.0, 0.0, -10.0)


def pixels(spark, z):
    y, x = np.mgrid[: z.shape[0], : z.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "z": z.ravel()}))


def grid(df, shape):
    out = np.full(shape, np.inf)
    got = df.toPandas()
    out[got.y, got.x] = got.z
    assert len(got) == shape[0] * shape[1]
    return out


@pytest.fixture(scope="module")
def terrain():
    y, x = np.mgrid[:530, :600]
    z = 1500 + 1.5 * x - 0.75 * y + np.random.default_rng(3).uniform(-0.4, 0.4, (530, 600))
    z[250:282, 280:312] = -9999
    return z


@pytest.mark.parametrize("place, wkt", [(PLACE, 'PROJCS["a",AUTHORITY["EPSG","3857"]]'), ((1.0, 2.0, 0.5, 3.0, 0.25, 4.0), 'GEOGCS["b",AUTHORITY["EPSG","4326"]]'), (tiff.IDENTITY, "")])
def test_file_round_trip(spark, terrain, tmp_path, place, wkt):
    path = str(tmp_path / "a.tif")
    assert tiff.write(api.Raster(pixels(spark, terrain), -9999.0, place, wkt), path) == (600, 530)
    got = tiff.read(spark, path)
    assert np.array_equal(grid(got.pixels, terrain.shape), terrain)
    assert (got.nodata, got.transform) == (-9999.0, place) and tiff.crs_of(got.wkt) == tiff.crs_of(wkt)


def test_a_region_reads_its_tiles_alone(spark, terrain, tmp_path):
    path = str(tmp_path / "a.tif")
    tiff.write(api.Raster(pixels(spark, terrain)), path)
    x, y, w, h = 250, 500, 20, 30
    part = tiff.read(spark, path, (x, y, w, h)).pixels.toPandas()
    assert len(part) == w * h and (terrain[part.y, part.x] == part.z).all()
    reader = tiff.TiffReader({"path": path, "region": "0,0,256,256"})
    assert sum(len(p.entries) for p in reader.partitions()) == 1


def test_missing_and_null_pixels_and_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "SMALL_FILE", 0)  # offsets of 64 bits
    path = str(tmp_path / "a.tif")
    df = spark.createDataFrame([(0, 0, 1.5), (0, 2, None), (600, 1, 2.5)], "y int, x int, z double")
    tiff.write(api.Raster(df, -1.0), path)
    want = np.full((601, 3), -1.0)
    want[0, 0], want[600, 1] = 1.5, 2.5
    assert np.array_equal(grid(tiff.read(spark, path).pixels, want.shape), want)
    assert tiff.open_layout(path)[2][1] == 0  # rows 256 to 511 have no pixels
    tiff.write(api.Raster(df), path)
    assert np.isnan(tiff.read(spark, path).pixels.where("y = 0 and x = 1").first()["z"])


def by_hand(path, z, order, samples=1, deflate=False, predictor=1, rows=3):
    """A file of strips, in plain Python."""
    kind = z.dtype.newbyteorder(order)
    strips = []
    for r in range(0, z.shape[0], rows):
        v = np.repeat(z[r : r + rows, :, None], samples, axis=2)
        if predictor == 2:
            whole = v.view(f"u{z.dtype.itemsize}")
            v = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1).view(z.dtype)
        data = v.astype(kind).tobytes()
        strips.append(zlib.compress(data) if deflate else data)
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    n = len(strips)
    extra = struct.pack(f"{order}{n}I", *offsets) + struct.pack(f"{order}{n}I", *map(len, strips))
    form = {"u": 1, "i": 2, "f": 3}[z.dtype.kind]
    tags = [(256, z.shape[1]), (257, z.shape[0]), (258, 8 * z.dtype.itemsize), (259, 8 if deflate else 1), (273, at), (277, samples), (278, rows), (279, at + 4 * n), (317, predictor), (339, form)]
    body = struct.pack(order + "H", len(tags))
    for tag, v in tags:
        body += struct.pack(order + "HHII", tag, 4, n if tag in (273, 279) else 1, v)
    mark = b"II" if order == "<" else b"MM"
    path.write_bytes(mark + struct.pack(order + "HI", 42, at + len(extra)) + b"".join(strips) + extra + body + b"\0" * 4)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind, how", [("u1", {}), ("i2", {"deflate": True, "predictor": 2}), ("u4", {"samples": 3}), ("i4", {"samples": 2, "predictor": 2}), ("f4", {"deflate": True}), ("f8", {})])
def test_strips_by_hand(spark, tmp_path, order, kind, how):
    z = np.random.default_rng(1).integers(0, 120, (10, 7)).astype(kind) * (-1 if kind[0] == "i" else 1)
    z = z.astype(kind)
    by_hand(tmp_path / "a.tif", z, order, **how)
    assert np.array_equal(grid(tiff.read(spark, str(tmp_path / "a.tif")).pixels, z.shape), z.astype(float))


def test_what_cannot_be_read(tmp_path):
    path = tmp_path / "a.tif"
    by_hand(path, np.arange(70, dtype="i4").reshape(10, 7), "<")
    good = path.read_bytes()
    for data in (b"", b"II", b"PNG" + good[3:], good[:30], good[:-20]):
        path.write_bytes(data)
        with pytest.raises(RuntimeError):
            tiff.open_layout(str(path))
    with pytest.raises(RuntimeError):
        tiff.open_layout(str(tmp_path / "none.tif"))


def test_command_line(spark, tmp_path, capsys):
    y, x = np.mgrid[:40, :50]
    z = (100 + x + 2 * y).astype(float)
    z[3, 4] = -9999
    a, b, c = (str(tmp_path / n) for n in ("a.tif", "b", "c.tif"))
    tiff.write(api.Raster(pixels(spark, z), -9999.0, PLACE), a)
    assert main(["encode", a, "-o", b]) == 0 and main(["verify", b, a]) == 0 and main(["decode", b, "-o", c]) == 0
    got = tiff.read(spark, c)
    assert np.array_equal(grid(got.pixels, z.shape), z) and (got.nodata, got.transform) == (-9999.0, PLACE)
    assert main(["analyze", str(tmp_path / "none.tif")]) == 1
