import json

import numpy as np
import pandas as pd
import pytest

from orogen import __main__ as cli
from orogen import api
from orogen.operators import codec
from orogen.report import analyze, bounds, crs_of, digits_of


def _raster(spark, z, nodata=None, **more):
    y, x = np.mgrid[: z.shape[0], : z.shape[1]]
    return api.Raster(spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "z": z.astype(float).ravel()})), nodata, **more)


def test_plane(spark):
    got = analyze(_raster(spark, np.full((512, 600), 1000)), wavelets=True)
    assert got["encoder_choice"] == "left" and got["encoder_choice_usage_pct"] == 100
    assert got["compressibility"]["bpp"] < 0.1 and got["dataset"]["spatial_correlation"]["h"] == 1
    assert got["quadtree"] == {"leaves": {"512": 1, "256": 0, "128": 0, "64": 1}, "total_blocks": 2}
    assert got["wavelet"]["evaluated"] and "smooth terrain" in got["verdicts"]


def test_noise_and_structure(spark):
    z = np.random.default_rng(5).integers(0, 1000, (192, 160))
    z[:64, :64] = 7
    got = analyze(_raster(spark, z, -9999.0))
    tile = codec.encode_tile(z.astype(np.int64), np.zeros(z.shape, bool))
    assert got["quadtree"]["total_blocks"] == len(tile) and got["dataset"]["nodata_count"] == 0
    own = sum(c.bits - 32 * len(c.params2) for _, c, _ in tile) / z.size  # the budget leaves the second pass's parameters out
    assert own < got["compressibility"]["bpp"] < own + 0.1 and got["compressibility"]["bpp"] > 5
    assert [p["rank"] for p in got["predictors"]] == [1, 2, 3, 4, 5, 6]
    assert got["dataset"]["elevation"]["valid_pixels"] == z.size and len(got["dataset"]["elevation"]["histogram"]) == 50


def test_digits_and_sweep(spark):
    got = analyze(_raster(spark, np.random.default_rng(2).uniform(100, 200, (96, 128))), 0.01)
    assert [p["place"] for p in got["compressibility"]["digit_planes"]] == [0, 1, 2]
    sweep = got["compressibility"]["precision_estimates"]
    assert [round(s["precision"], 6) for s in sweep] == [0.01, 0.1, 1.0] and sweep[-1]["bpp"] < sweep[0]["bpp"]


def test_metadata():
    assert digits_of(0.01) == 2 and digits_of(2.0) == 0 and digits_of(0.3) == -1
    assert crs_of('PROJCS["a",GEOGCS["b",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","3857"]]') == ("EPSG:3857", "m")
    assert crs_of('GEOGCS["b",AUTHORITY["EPSG","4326"]]') == ("EPSG:4326", "deg") and crs_of("") == ("", "")
    assert bounds((10.0, 2.0, 0.0, 50.0, 0.0, -1.0), 5, 4) == (10.0, 46.0, 20.0, 50.0)


def test_command_line(spark, tmp_path, capsys):
    z = np.add.outer(np.arange(40), np.arange(50))
    src, out, back = (str(tmp_path / n) for n in ("src", "a.oro", "back"))
    _raster(spark, z).pixels.write.parquet(src)
    for argv in (["encode", src, "-o", out], ["info", out], ["verify", out, src], ["decode", out, "-o", back, "--region", "5", "6", "7", "8"], ["analyze", src, "--compact"]):
        assert cli.main(argv) == 0
        json.loads(capsys.readouterr().out)
    assert spark.read.parquet(back).count() == 56
    assert cli.main(["encode", src, "-o", out, "--precision", "none"]) == 1
    assert cli.main(["version"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["encode", src])
