import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import pixel as px
from orogen.operators import codec, kernels as kn
from orogen.operators.inpaint import inpaint

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("kind", kn.BANK)
@pytest.mark.parametrize("shape", [(64, 64), (20, 15), (1, 10), (10, 1)])
def test_predictors_invert(kind, shape):
    g = RNG.integers(-1000, 5000, shape)
    r = (0, 0, shape[1], shape[0])
    res, params = kn.predict(kind, g, r)
    out = np.zeros_like(g)
    kn.restore(kind, res, params, out, r)
    assert (out == g).all()


@pytest.mark.parametrize("kind", range(1, 7))
def test_second_passes_invert(kind):
    g = RNG.integers(-50, 50, (17, 19))
    res, params = kn.second_pass(kind, g)
    assert (kn.undo_second_pass(kind, res, params) == g).all()


def test_wavelet_inverts():
    v = np.array([[10, 25, -5, 100, 3, 0, -42, 18, 9]])
    assert (kn._split(v) != v).any() and (kn._join(kn._split(v)) == v).all()
    g = RNG.integers(-1000, 1000, (64, 61))
    assert (kn.unwavelet(kn.wavelet(g, 3), 3) == g).all()


def test_cubic_surface_fits():
    u = (np.arange(64) - 31.5) / 31.5
    v = u[:, None]
    g = np.trunc(5000 * (u**3 - 3 * u * v * v) + 2000 * (v**3 - 3 * v * u * u) + 1000 * u * v).astype(np.int64)
    res, params = kn.predict(kn.POLYNOMIAL, g, (0, 0, 64, 64))
    assert len(params) == 11 and np.abs(res).max() < 100


@pytest.mark.parametrize("options", [{}, {"extended": True}, {"use_wavelet": True}, {"precision": 0.1}, {"precision": 0.01, "extended": True}, {"tree": False}])
def test_tiles_round_trip(options):
    y, x = np.mgrid[:61, :70]
    g = (1000 + 0.5 * x + 0.3 * y + 25 * np.sin(0.05 * x) * np.cos(0.04 * y) + 40 * np.sin(0.6 * x + 0.4 * y)).astype(np.int64) * 3 - 2500
    mask = RNG.random(g.shape) < 0.02
    mask[10:40, 5:60] = True
    out, holes = np.zeros_like(g), np.zeros(g.shape, bool)
    for r, _, data in codec.encode_tile(g, mask, least=16, **options):
        m = codec.multiplier_of(options.get("precision", 1.0))
        holes[r[1] : r[1] + r[3], r[0] : r[0] + r[2]] = codec.unpack(data, out, r, m, options.get("extended", False), options.get("use_wavelet", False))
    assert (out == g).all() and (holes == mask).all()


def test_a_cut_stream_is_noticed():
    g = RNG.integers(-500, 500, (64, 64))
    (r, _, data), *_ = codec.encode_tile(g, np.zeros(g.shape, bool), tree=False)
    with pytest.raises(RuntimeError):
        codec.unpack(data[: len(data) // 2], np.zeros_like(g), r, 1, False, False)


def test_grids_round_trip_in_spark(spark):
    grid = spark.range(50 * 70).select((F.col("id") / 70).cast("long").alias("y"), (F.col("id") % 70).alias("x"), (F.col("id") % 97 * 3).alias("q"), (F.col("id") % 41 == 0).alias("nodata"))
    blocks = codec.encode(grid, size=32, least=16).cache()
    again = codec.encode(grid.repartition(7), size=32, least=16)
    assert blocks.select("sb", "leaf", "payload").exceptAll(again.select("sb", "leaf", "payload")).count() == 0
    back = codec.decode(blocks)
    assert grid.exceptAll(back.select("y", "x", "q", "nodata")).count() == 0
    part = codec.decode(codec.region(blocks, 40, 0, 20, 20, 32))
    assert part.agg(F.min("x"), F.max("y")).first() == (32, 31)


def test_quantize_known_values(spark):
    df = spark.createDataFrame([(4231.37,), (-12.5,), (8848.86,), (0.04,), (float("nan"),)], "z double")
    assert [r[0] for r in df.select(px.quantize(F.col("z"), 0.01)).collect()] == [423137, -1250, 884886, 4, 0]


def test_a_hole_is_filled(spark):
    rows = [(y, x, 0 if (y, x) == (1, 1) else 10 * (3 * y + x + 1), (y, x) == (1, 1)) for y in range(3) for x in range(3)]
    got = inpaint(spark.createDataFrame(rows, "y long, x long, q long, nodata boolean")).where("nodata").first()
    assert got["q"] == 50 and got["ring"] == 1


@pytest.mark.parametrize("most", [1, 3, 50, 10**6])
def test_estimates_are_sums_of_their_parts(most):
    r = RNG.integers(-most, most + 1, (40, 70))
    r[5:20] = 0
    assert abs(kn.estimate(r) - sum(kn.estimate_parts([r]))) < 1e-5


def test_level_ground_stays_whole(spark):
    from orogen.operators import selection as sel

    g = RNG.integers(-500, 500, (64, 96))
    g[:16, :16] = 5
    y, x = np.mgrid[:64, :96]
    df = spark.createDataFrame(list(zip(y.ravel().tolist(), x.ravel().tolist(), g.ravel().tolist())), "y long, x long, q long")  # noqa: B905
    leaves = sel.quadtree(df, 32, 8).collect()
    assert sum(r["cells"] for r in leaves) == g.size
    level = [r for r in leaves if r["sb"] == 0 and (r["level"], r["node"]) == (1, 4)]
    assert len(level) == 1 and level[0]["pid"] == kn.LEFT and level[0]["bits"] < 256
    assert sel.path_of((24, 8, 8, 8), 32, 32) == (2, 4 * (4 + 1) + 3)


def test_planes_cut_anywhere_are_noticed():
    g = RNG.integers(-500, 500, (32, 32))
    (r, _, data), *_ = codec.encode_tile(g, RNG.random(g.shape) < 0.1, tree=False, least=32)
    for n in (0, 1, 3, len(data) // 3, len(data) - 1):
        with pytest.raises(RuntimeError):
            codec.unpack(data[:n], np.zeros_like(g), r, 1, False, False)
