import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orogen import api
from orogen.sources import container as ct

W, H = 600, 530


@pytest.fixture(scope="module")
def raster(spark):
    y, x = np.mgrid[:H, :W]
    z = 1500 + 1.5 * x - 0.75 * y + np.random.default_rng(3).uniform(-0.4, 0.4, (H, W))
    z[250:282, 280:312] = -9999
    df = spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "z": z.ravel()}))
    return api.Raster(df, -9999.0, (500000.0, 10.0, 0.0, 4500000.0, 0.0, -10.0), "LOCAL")


@pytest.fixture(scope="module")
def coded(raster, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("c") / "a.oro")
    return path, api.encode(raster, path, 1.0, disable_quadtree=True)


def test_file_round_trip(spark, raster, coded):
    path, got = coded
    assert (got.width, got.height) == (W, H) and sum(got.predictor_counts.values()) == got.total_blocks
    facts = api.info(spark, path)
    assert facts.block_count == got.total_blocks and facts.total_payload_bytes < got.output_bytes < 4 * W * H
    assert facts.header.nodata == -9999 and facts.header.transform == raster.transform and not facts.header.tree
    ok = api.verify(spark, path, raster)
    assert ok.passed and ok.message == f"Verification passed: {W * H} pixels are identical." and ok.mismatched_pixels == 0
    assert api.verify(spark, path).message == f"All {got.total_blocks} block checksums are valid."


def test_region_is_a_crop(spark, raster, coded):
    x, y, w, h = 480, 230, 100, 40
    part = api.decode(spark, coded[0], (x, y, w, h))
    a = {(r.y, r.x): r.z for r in part.pixels.collect()}
    whole = api.decode(spark, coded[0]).pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    assert a == {(r.y - y, r.x - x): r.z for r in whole.collect()} and len(a) == w * h
    assert part.transform == (500000.0 + 10 * x, 10.0, 0.0, 4500000.0 - 10 * y, 0.0, -10.0)
    assert ct.read(spark, coded[0], (0, 0, 10, 10)).select("sb").distinct().count() == 1


def test_a_changed_source_fails(spark, raster, coded):
    changed = api.Raster(raster.pixels.withColumn("z", F.when((F.col("y") == 1) & (F.col("x") < 7), 0.0).otherwise(F.col("z"))), -9999.0)
    got = api.verify(spark, coded[0], changed)
    assert not got.passed and got.message == f"7 of {W * H} pixels differ."
    small = api.Raster(raster.pixels.where("x < 10"), -9999.0)
    assert api.verify(spark, coded[0], small).message == f"Dimension mismatch ({W}x{H} vs 10x{H})"


def test_corruption_is_found(spark, coded, tmp_path):
    data = bytearray(open(coded[0], "rb").read())
    data[len(data) // 3] ^= 0xFF
    bad = tmp_path / "bad.oro"
    bad.write_bytes(data)
    got = api.verify(spark, str(bad))
    assert not got.passed and "corrupt" in got.message
    for change in (lambda d: b"NOPE" + d[4:], lambda d: d[: len(d) // 2], lambda d: d[:40]):
        bad.write_bytes(change(open(coded[0], "rb").read()))
        with pytest.raises(RuntimeError):
            ct.read_header(str(bad))


@pytest.mark.parametrize("how", [{"precision": 0}, {"precision": 0.1, "pipeline": "wavelet"}, {"context": "none"}, {"pipeline": "none"}])
def test_bad_options(raster, how):
    with pytest.raises(ValueError):
        api.encode(raster, "/nowhere", **how)


def test_split_planes_and_wavelet(spark, tmp_path):
    y, x = np.mgrid[:70, :90]
    df = spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "z": (1000 + 0.5 * x + 0.3 * y).ravel()}))
    for name, how in (("a", {"precision": 0.01, "context": "extended"}), ("b", {"pipeline": "wavelet"})):
        path = str(tmp_path / name)
        api.encode(api.Raster(df), path, **how)
        assert api.verify(spark, path, api.Raster(df)).passed
    with pytest.raises(ValueError):
        api.decode(spark, path, (0, 0, 5, 0))


def test_precision_names():
    assert [api.parse_precision(t) for t in ("m", "cm", "0.5", "x")] == [1.0, 0.01, 0.5, -1.0]
