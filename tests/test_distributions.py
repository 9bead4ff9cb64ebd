from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from emberframe.operators import correlation as C
from emberframe.operators import distributions as D
from emberframe.operators import stats as B
from tests.helpers import WATER, rows, tables


def of(atoms, e):
    return atoms.filter(F.col("element") == e)


def test_rdf_of_water(spark):
    frames, atoms, _ = tables(spark, [WATER] * 4)
    found = rows(D.rdf(of(atoms, "O"), of(atoms, "H"), frames, rmax=4.0, dr=0.02, integrate=True))
    top = max(found, key=lambda r: r[2])
    assert abs(top[1] - 0.96) <= 0.02 and all(r[2] == 0 for r in found if r[1] > 2)
    assert found[-1][3] == pytest.approx(2.0)


def test_rdf_has_no_self_pair(spark):
    frames, atoms, _ = tables(spark, [(["O"], [(0, 0, 0)])])
    assert all(r[2] == 0 for r in rows(D.rdf(atoms, atoms, frames, rmax=3.0, dr=0.1)))
    frames, atoms, _ = tables(spark, [(["O", "O"], [(0, 0, 0), (2.5, 0, 0)])])
    found = rows(D.rdf(atoms, atoms, frames, rmax=4.0, dr=0.1))
    assert abs(max(found, key=lambda r: r[2])[1] - 2.5) <= 0.1
    assert D.default_rmax(frames) == 15.0


def test_angles(spark):
    for second, expected in (((0, 0.96, 0), 90.0), ((-0.96, 0, 0), 180.0)):
        frames, atoms, topo = tables(spark, [(["O", "H", "H"], [(0, 0, 0), (0.96, 0, 0), second])], molecules=[[[0, 1, 2]]])
        (angle,) = rows(D.angles(atoms, topo, frames).select("angle"))
        assert angle[0] == pytest.approx(expected, abs=1e-2)
    frames, atoms, topo = tables(spark, [(["O", "H"], [(0, 0, 0), (1, 0, 0)])], molecules=[[[0, 1]]])
    assert rows(D.adf(D.angles(atoms, topo, frames))) == []


def test_perfect_tetrahedron(spark):
    s = 2 / math.sqrt(3)
    frames, atoms, _ = tables(spark, [(["O"] * 5, [(0, 0, 0), (s, s, s), (s, -s, -s), (-s, s, -s), (-s, -s, s)])])
    assert rows(D.tetrahedral_order(atoms, frames, rcut=2.5))[0][1] == pytest.approx(1.0)
    assert rows(D.tetrahedral_order(atoms, frames, rcut=1.0)) == [(0, None)]


def test_hbonds(spark):
    symbols = ["O", "H", "H", "O", "O"]
    places = [(0, 0, 0), (0.96, 0, 0), (0, 0.96, 0), (2.16, 0, 0), (0, 2.16, 0)]
    frames, atoms, topo = tables(spark, [(symbols, places)] * 3, molecules=[[[0, 1, 2], [3], [4]]])
    found = D.hbonds(atoms, topo, frames, 2.0)
    assert rows(D.hbond_count(found, frames)) == [(0, 2), (1, 2), (2, 2)]
    assert rows(C.hbond_acf(found, 3, 4)) == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]


def test_shells(spark):
    curve = spark.createDataFrame([(i, (i + 0.5) * 0.1, float(g), float(n)) for i, (g, n) in enumerate(zip([0] * 9 + [2, 5, 2, 0.2, 0.1, 0.3, 1, 2, 1, 0.5], range(19)))], "bin int, r double, g double, n double")
    found = rows(D.rdf_shells(curve))
    assert [round(r[1], 3) for r in found] == [1.05, 1.65] and [round(r[3], 3) for r in found] == [1.35, 1.85]
    assert [r[4] for r in found] == pytest.approx([13.0, 18.0])


def test_spatial_density_puts_the_bond_on_z(spark):
    frames, atoms, topo = tables(spark, [(["O", "H", "He"], [(1, 1, 1), (1, 2, 1), (1, 4, 1)])], molecules=[[[0, 1], [2]]])
    points, meta = D.aligned(of(atoms, "O"), of(atoms, "H"), of(atoms, "He"), topo, frames)
    (p,) = rows(points.select("x", "y", "z"))
    assert p == pytest.approx((0, 0, 3), abs=1e-9) and tuple(meta.first()) == (1, 1.0)
    for down in ((1, 1, 0), (1, 1, 2)):
        frames, atoms, topo = tables(spark, [(["O", "H", "He"], [(1, 1, 1), down, (2, 1, 1)])], molecules=[[[0, 1], [2]]])
        (p,) = rows(D.aligned(of(atoms, "O"), of(atoms, "H"), of(atoms, "He"), topo, frames)[0].select("x", "y", "z"))
        assert p == pytest.approx((1, 0, 0), abs=1e-9)
    with pytest.raises(ValueError):
        D.spatial_densities(atoms, atoms, atoms, topo, frames, "C9v")
    with pytest.raises(ValueError):
        D.spatial_densities(atoms, atoms, atoms, topo, frames, "C2v")


def test_last_bin_is_closed(spark):
    from emberframe.functions.geometry import bin_of

    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.01,)], "v double")
    assert [r[1] for r in rows(df.select("v", bin_of(F.col("v"), 0.0, 1.0, 2).alias("b")))] == [0, 1, 1, None]


def test_msd(spark):
    tracks = spark.createDataFrame([(0, t, 2.0 * t, 0.0, 0.0) for t in range(8)] + [(1, t, 5.0, 0.0, 0.0) for t in range(8)], "track int, idx int, x double, y double, z double")
    found = rows(C.pooled_msd(tracks, 3).select("lag", "msd"))
    assert found == [(k, pytest.approx(2.0 * k * k)) for k in (1, 2, 3)]
    short = rows(C.pooled_msd(tracks.filter("track = 0 and idx < 3"), 5).select("lag", "msd"))
    assert [m for _, m in short] == [4.0, 16.0, None, None, None]
    blocks = rows(C.block_msd(tracks, 2, 4).select("lag", "msd", "n", "stderr"))
    assert blocks[0][1] == pytest.approx(2.0) and blocks[0][2] == 4 and blocks[0][3] == pytest.approx(math.sqrt(16 / 3) / 2)
    with pytest.raises(ValueError):
        C.msd(tracks, block_size=2, n_blocks=2)
    with pytest.raises(ValueError):
        C.msd(tracks.filter("idx < 0"))


def test_diffusive_window(spark):
    curve = spark.createDataFrame([(k, 6.0 * k) for k in range(1, 21)], "lag int, msd double")
    r = C.diffusive_window(curve).first()
    assert r["alpha"] == pytest.approx(1.0) and r["r2"] == pytest.approx(1.0)
    assert B.slope_over_six(curve).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        C.diffusive_window(curve.filter("lag < 4"))


def test_van_hove(spark):
    tracks = spark.createDataFrame([(0, t, 1.25 * t, 0.0, 0.0) for t in range(30)], "track int, idx int, x double, y double, z double")
    curves = C.van_hove(tracks, (1, 2), rmax=5.0, dr=0.1)
    for lag in (1, 2):
        own = rows(curves.filter(F.col("lag") == lag), "bin")
        assert sum(r[3] for r in own) * 0.1 == pytest.approx(1.0)
        assert abs(max(own, key=lambda r: r[3])[2] - 1.25 * lag) <= 0.1
    peaks = rows(C.van_hove_peaks(curves), "lag")
    assert peaks[0][1] == pytest.approx(1.25, abs=0.1)
    kde = rows(C.van_hove_kde(curves, tracks, 0.1, 0.2).filter("lag = 1"))
    assert sum(r[3] for r in kde) * 0.1 == pytest.approx(1.0)
    top = rows(C.van_hove_map(curves).filter("lag = 1"), "bin")
    assert max(r[3] for r in top) == pytest.approx(1.0)


def test_blocks(spark):
    series = spark.createDataFrame(list(enumerate([0.0, 0.0, 2.0, 2.0])), "i int, v double")
    assert tuple(B.block_average(series, 2).first()) == (1.0, 1.0, 2)
    with pytest.raises(ValueError):
        B.split_blocks(25, 10)
    with pytest.raises(ValueError):
        B.split_blocks(3, 2)


def test_spectra_agree(spark):
    import numpy as np

    v = [math.sin(0.3 * i) + 0.1 * i % 1 for i in range(60)]
    series = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "series int, i int, v double")
    a = rows(B.spectrum(series, 60).select("k", "wavenumber", "power"), "k")
    b = rows(B.spectrum_fft(series).select("k", "wavenumber", "power"), "k")
    assert np.allclose(a, b)


def test_smoothing_matches_numpy(spark):
    import numpy as np

    v = [float((7 * i) % 11) for i in range(40)]
    series = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    kernel = np.array(B.gaussian(2.0))
    half = len(kernel) // 2
    wide = np.concatenate([v[:half][::-1], v, v[-half:][::-1]])
    assert [r[1] for r in rows(B.smooth(series, 40, 2.0), "i")] == pytest.approx(list(np.convolve(wide, kernel, "valid")))
    assert [r[1] for r in rows(B.convolve(series, list(kernel), 40, mirror=False), "i")] == pytest.approx(list(np.convolve(v, kernel, "same")))
