from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberframe.engine import Trajectory
from emberframe.functions import geometry as G
from emberframe.operators import perception as P
from emberframe.operators import selectors as S
from tests.helpers import WATER, rows, tables


def groups(topo):
    out = {}
    for f, a, m in rows(topo.select("frame_id", "atom_idx", "mol_id")):
        out.setdefault((f, m), []).append(a)
    return sorted(out.values())


def test_water_pair_and_scales(spark):
    symbols = WATER[0] * 2
    places = [*WATER[1], *[(x + 8, y, z) for x, y, z in WATER[1]]]
    frames, atoms, _ = tables(spark, [(symbols, places)], 20.0)
    assert groups(P.build_molecules(atoms, frames)) == [[0, 1, 2], [3, 4, 5]]
    assert len(groups(P.build_molecules(atoms, frames, bond_scale=0.0))) == 6
    assert groups(P.build_molecules(atoms, frames, bond_scale=10.0)) == [[0, 1, 2, 3, 4, 5]]
    mols = P.molecules(atoms, P.build_molecules(atoms, frames))
    assert [r[2] for r in rows(mols)] == ["H2O", "H2O"]


def test_bond_across_border(spark):
    frames, atoms, _ = tables(spark, [(["O", "H"], [(0.1, 5, 5), (9.9, 5, 5)])], 10.0)
    (bond,) = rows(P.bonds(atoms, frames))
    assert bond[:3] == (0, 0, 1) and bond[3] == pytest.approx(0.2)


def test_spheres(spark):
    symbols = ["Be", *WATER[0]]
    near = [(2.0, 0, 0), (2.96, 0, 0), (2.0, 0.96, 0)]
    for shift, expected in ((0.0, [[0, 1, 2, 3]]), (2.0, [[0], [1, 2, 3]])):
        frames, atoms, _ = tables(spark, [(symbols, [(0, 0, 0), *[(x + shift, y, z) for x, y, z in near]])])
        assert groups(P.build_spheres(atoms, frames, {("Be", "O"): 2.5})) == expected


def test_sphere_cutoff_of_ring(spark):
    import math

    places = [(0, 0, 0), *[(2 * math.cos(k * math.pi / 3), 2 * math.sin(k * math.pi / 3), 0) for k in range(6)]]
    frames, atoms, _ = tables(spark, [(["Be", *["O"] * 6], places)] * 5)
    assert rows(S.coordination_centers(atoms)) == [("Be",)]
    found = rows(P.detect_sphere_cutoffs(atoms, frames, ["Be"]))
    assert [(r[0], r[1]) for r in found] == [("Be", "O")] and 1.5 < found[0][2] < 4.5


def test_components_agree(spark):
    rng = random.Random(3)
    n = 12
    frames, atoms, _ = tables(spark, [(["O"] * n, [(0, 0, 0)] * n)] * 4)
    edges = spark.createDataFrame([(f, *sorted(rng.sample(range(n), 2))) for f in range(4) for _ in range(7)], "frame_id int, i int, j int")
    assert rows(P.components(atoms, edges)) == rows(P.iterative_components(atoms, edges))


def test_cells_find_all_pairs(spark):
    rng = random.Random(5)
    frames, atoms, _ = tables(spark, [(["O"] * 40, [tuple(rng.uniform(-3, 15) for _ in range(3)) for _ in range(40)])], 12.0)
    plain = P.pairs(atoms, atoms, frames).filter("d < 3").select("a_idx", "b_idx")
    assert rows(P.pairs_within(atoms, atoms, frames, 3.0).select("a_idx", "b_idx")) == rows(plain)


def test_persistence_filter(spark):
    a, b = [[0, 1], [2]], [[0], [1, 2]]
    _, _, topo = tables(spark, [(["O"] * 3, [(0, 0, 0)] * 3)] * 7, molecules=[a, a, b, a, b, b, b])
    kept = P.persistence_filter(topo, 2)
    per = {f: groups(kept.filter(F.col("frame_id") == f)) for f in range(7)}
    assert per[2] == sorted(a) and per[4] == sorted(b) and per[0] == sorted(a)


def test_formula_and_selection(spark):
    frames, atoms, topo = tables(spark, [(["O", "H", "H", "O", "H"], [(0, 0, 0)] * 5)], molecules=[[[0, 1, 2], [3, 4]]])
    mols = P.molecules(atoms, topo)
    assert [r[0] for r in rows(S.select(atoms, {"HO": "O"}, topo, mols).select("atom_idx"))] == [3]
    assert len(rows(S.select(atoms, {"H2O": None}, topo, mols))) == 3
    assert [r[0] for r in rows(S.by_formula(mols, ["HO", "H2O", "HO"]).select("place"))] == [0, 1, 2]
    with pytest.raises(ValueError):
        S.select(atoms, 3)
    with pytest.raises(ValueError):
        S.parse_cutoffs({"A-B-C": 1})
    assert S.parse_cutoffs({" Be - O ": 2}) == {("Be", "O"): 2.0}
    assert rows(S.molecule_of(atoms, topo.filter("mol_id = 0")).filter("mol_id = -1").select("atom_idx")) == [(3,), (4,)]
    assert rows(S.validate(atoms, topo)) == []


CELL = [[4.0, 0.0, 0.0], [1.0, 4.0, 0.0], [0.5, 0.5, 4.0]]


def test_triclinic_nearest_image(spark):
    df = spark.createDataFrame([(CELL, 3.4, 3.1, -2.9)], "cell array<array<double>>, x double, y double, z double")
    got = df.select(*G.Cell().mic((F.col("x"), F.col("y"), F.col("z")))).first()
    import itertools

    best = min((sum((d - sum(n[i] * c[i][k] for i in range(3))) ** 2 for k, d in enumerate((3.4, 3.1, -2.9))) for c in [CELL] for n in itertools.product(range(-2, 3), repeat=3)))
    assert sum(v * v for v in got) == pytest.approx(best)


def test_engine_modes(spark, tmp_path):
    frames, atoms, _ = tables(spark, [(WATER[0], WATER[1])] * 3, 12.0)
    t = Trajectory(frames, atoms)
    assert rows(t.summary()) == [("H2O", 3)]
    assert rows(t.lifetime_segments().select("formula", "start", "stop")) == [("H2O", 0, 3)]
    t.extract_segments("H2O", str(tmp_path / "out"))
    assert (tmp_path / "out" / "name=H2O_0_3").is_dir()
    with pytest.raises(ValueError):
        t.extract_segments("HO", str(tmp_path / "no"))
