from __future__ import annotations

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import runs as R
from emberframe.operators import stats as B
from emberframe.operators import tracks as K
from emberframe.sources import trajectory as T
from emberframe.streaming.states import advance
from tests.helpers import rows, tables


def states(spark, *series):
    data = [(e, t, s) for e, seq in enumerate(series) for t, s in enumerate(seq)]
    return spark.createDataFrame(data, "entity int, t int, state string")


def machine(seq, persistence):
    """Transitions and residence of one entity, step by step."""
    committed, candidate, seen, stay, out = seq[0], None, 0, 0, []
    for t, s in list(enumerate(seq))[1:]:
        if s == committed:
            candidate, seen, stay = None, 0, stay + 1
        else:
            seen = seen + 1 if seen and s == candidate else 1
            candidate = s
            if seen >= persistence:
                out.append((t, committed, s))
                committed, candidate, seen, stay = s, None, 0, 0
    return out, stay


@pytest.mark.parametrize("persistence", [1, 2, 3])
def test_track_is_the_state_machine(spark, persistence):
    rng = random.Random(persistence)
    series = [list("AABBB"), list("ABBAA"), list("A" * 20), *[[rng.choice(["A", "B", None]) for _ in range(rng.randint(1, 14))] for _ in range(40)]]
    moves, stays = R.track(states(spark, *series), persistence)
    expected = [machine(s, persistence) for s in series]
    got = {}
    for e, t, a, b in rows(moves, "entity", "t"):
        got.setdefault(e, []).append((t, a, b))
    assert got == {e: m for e, (m, _) in enumerate(expected) if m}
    assert dict(rows(stays)) == {e: r for e, (_, r) in enumerate(expected)}


def test_stream_step_is_the_state_machine():
    rng = random.Random(9)
    for _ in range(200):
        seq = [rng.choice("AB") for _ in range(12)]
        cut = rng.randint(0, 12)
        held, moves = (None, None, 0, False), []
        for part in (list(enumerate(seq))[:cut], list(enumerate(seq))[cut:]):
            *held, some = advance(*held, part, 2)
            moves += some
        assert moves == machine(seq, 2)[0]


def test_hop_and_unbound(spark):
    places = [[(0, 0, 0), (5, 0, 0), (x, 0, 0)] for x in (0.9, 0.9, 4.1, 4.1)]
    frames, atoms, _ = tables(spark, [(["O", "O", "H"], p) for p in places])
    assert rows(R.atom_hop(atoms, frames)[0]) == [(2, 2, 0, 1)]
    frames, atoms, _ = tables(spark, [(["O", "H"], [(0, 0, 0), (x, 0, 0)]) for x in (0.9, 2.0, 0.9)])
    assert sorted(rows(R.atom_hop(atoms, frames)[0], "t")) == [(1, 1, 0, None), (1, 2, None, 0)]


def test_segments_kinetics_windows(spark):
    mols = spark.createDataFrame([(f, "HO") for f in (0, 1, 4, 5, 6, 9)] + [(1, "HO")], "frame_id int, formula string")
    segments = R.lifetime_segments(mols)
    assert rows(segments, "segment") == [("HO", 0, 0, 2), ("HO", 1, 4, 7), ("HO", 2, 9, 10)]
    assert R.segment(segments, "HO", -1) == (9, 10)
    with pytest.raises(IndexError):
        R.segment(segments, "HO", 3)
    with pytest.raises(ValueError):
        R.segment(segments, "H2O", 0)
    (k,) = rows(R.reaction_kinetics(segments, 10, 2.0))
    assert k == ("HO", 3, 4.0, 4.0, 0.15)
    assert rows(R.reaction_windows(segments, 10, 2, "death").filter("segment = 2")) == [("HO", 2, 10, 8, 10)]
    with pytest.raises(ValueError):
        R.reaction_windows(segments, 10, 2, "middle")


def test_bond_break(spark):
    frames, atoms, _ = tables(spark, [(["O", "H"], [(0, 0, 0), (x, 0, 0)]) for x in (0.96, 0.96, 4.0)])
    from emberframe.operators.perception import bonds

    assert rows(R.bond_events(bonds(atoms, frames), frames)) == [(2, "broken", 0, 1)]
    (event,) = R.bond_events(bonds(atoms, frames), frames, atoms).collect()
    assert (event["event"], event["element_i"], event["element_j"]) == ("broken", "O", "H")


def test_count_segments(spark):
    counts = spark.createDataFrame([(f, 1 if f < 100 else 2) for f in range(200)], "frame_id int, n int")
    assert rows(B.count_segments(counts, 200, 50)) == [(0, 0, 100), (1, 100, 200)]


def test_tracks_cross_borders_and_stitch(spark):
    frames, atoms, _ = tables(spark, [(["O", "O"], [((8 + t) % 10, 1, 1), (2, 5, 5)]) for t in range(6)], 10.0)
    mols = atoms.selectExpr("frame_id", "atom_idx as mol_id", "'O' as formula", "x as cx", "y as cy", "z as cz")
    segments = R.lifetime_segments(mols)
    found = rows(K.greedy_tracks(mols, segments, frames), "track", "idx")
    assert [r[5] for r in found if r[2] == 0] == [8, 9, 10, 11, 12, 13]
    some = mols.filter("mol_id = 0 and frame_id <> 3")
    segments = R.lifetime_segments(some)
    chains, links = K.stitch(K.greedy_tracks(some, segments, frames), some, segments, frames, "O")
    assert rows(links) == [(3, 4, 1, 2.0)]
    assert [r[2] for r in rows(chains, "idx")] == [8, 9, 10, 12, 13]


def test_whole_molecules(spark):
    frames, atoms, topo = tables(spark, [(["O", "H"], [(0.1, 1, 1), (9.5, 1, 1)])], 10.0, molecules=[[[0, 1]]])
    assert [r[4] for r in rows(K.make_whole(atoms, topo, frames), "atom_idx")] == pytest.approx([0.1, -0.5])
    assert [r[4] for r in rows(K.vacuum(atoms, topo, frames, center_atoms=[0]), "atom_idx")] == pytest.approx([0.0, -0.6])
    moved = rows(K.recenter(atoms, frames, center_atoms=[0], wrap=True), "atom_idx")
    assert [r[3] for r in moved] == pytest.approx([5.0, 4.4])
    near = rows(K.cluster_around(atoms, topo, frames, center_atoms=[0]), "atom_idx")
    assert [r[4] for r in near] == pytest.approx([0.0, -0.6])


def test_xyz_round_trip(spark, tmp_path):
    frames, atoms, _ = tables(spark, [(["O", "H"], [(0, 0, t), (0.96, 0, t)]) for t in range(3)], 12.0)
    windows = spark.createDataFrame([("all", 0, 3)], "name string, first int, stop int")
    T.write_windows(atoms, windows, str(tmp_path / "x"), frames)
    fr, at = T.read_xyz(spark, f"{tmp_path}/x/name=all")
    assert rows(at.select("frame_id", "atom_idx", "element", "x", "y", "z")) == rows(atoms)
    assert [r[1] for r in rows(fr.select("frame_id", "lx"))] == [12.0] * 3


def test_cache_key_and_address(spark, tmp_path):
    a = T.cache_key("/t", "sphere", 1.0, 1.3, None, {("Be", "O"): 2.5, ("Li", "O"): 3.0})
    b = T.cache_key("/t", "sphere", 1.0, 1.3, None, {("Li", "O"): 3.0, ("Be", "O"): 2.5})
    assert a == b and len(a) == 64 and a != T.cache_key("/t", "sphere", 1.0, 1.3, 5)
    assert T.parse_address("a/b@c@12") == ("a/b@c", 12) and T.parse_address("a.xyz") == ("a.xyz", None)
    (tmp_path / "log").write_text("head line\n 1 2.5\n 3  4.5\n")
    assert rows(T.read_log(spark, str(tmp_path / "log"), 1)) == [(0, 2.5), (1, 4.5)]
    per = spark.createDataFrame([(0, 1.5)], "frame_id int, energy double")
    T.append_results(per, str(tmp_path / "r"))
    T.append_results(per.filter("energy < 0"), str(tmp_path / "r"))
    frames, atoms, _ = tables(spark, [(["O"], [(0, 0, 0)])] * 2)
    assert [r[4] for r in rows(T.attach(frames, atoms, spark.read.parquet(str(tmp_path / "r")))[0])] == [1.5, None]


def test_tracks_are_streamed(spark):
    # ends and beginnings out of order, and more rows than a batch
    rng = np.random.default_rng(8)
    many = [(f, m, *map(float, rng.uniform(0, 9, 3))) for f in range(4000) for m in range(2 + int(f % 7 == 3) - int(f % 11 == 5) + 2 * int(f % 13 == 0))]
    mols = spark.createDataFrame(many, "frame_id long, mol_id int, cx double, cy double, cz double").withColumn("formula", F.lit("W"))
    frames = spark.range(4000).select(F.col("id").alias("frame_id"), *[(F.lit(9.0) + F.col("id") % 3 / 10).alias(c) for c in ("lx", "ly", "lz")])
    at = [np.array([list(r[2:]) for r in group]) for _, group in groupby(many, key=lambda r: r[0])]
    for longest in (None, 3.0):
        live, done = [], []
        for f in range(4000):
            centers = at[f]
            free, following = np.ones(len(centers), dtype=bool), []
            for where, history in live:
                if free.any():
                    step = centers - where
                    step = step - (9.0 + f % 3 / 10) * np.rint(step / (9.0 + f % 3 / 10))
                    far = np.where(free, (step * step).sum(1), np.inf)
                    j = int(far.argmin())
                    if longest is None or far[j] <= longest * longest:
                        free[j] = False
                        history.append((f, history[-1][1] + step[j]))
                        following.append((centers[j], history))
                        continue
                done.append(history)
            live = following + [(centers[j], [(f, centers[j])]) for j in np.flatnonzero(free)]
        want = [h for h in [*done, *(h for _, h in live)] if len(h) > 1]
        found = K.greedy_tracks(mols, R.lifetime_segments(mols), frames, max_step=longest)
        assert "MapInPandas" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan
        assert rows(found) == [("W", 0, t, i, f, *map(float, p)) for t, h in enumerate(want) for i, (f, p) in enumerate(h)]


def test_xyz_files_are_streamed(spark, tmp_path):
    # frames cut by blocks and pieces, one longer than a piece, comments of any text, a file that ends at a blank line and one without a last newline
    sizes = {"a.xyz": [3, 400, 1, 7, *[5] * 200], "b.xyz": [2, 90], "c.xyz": [1]}
    want, number = [], 0
    for name, counts in sizes.items():
        text = ""
        for n in counts:
            atoms = [("H", n * 0.5, i + 0.25, float(number)) for i in range(n)]
            comment = {0: "12", 1: "é" * 30}.get(number % 3, 'Lattice="5.0 0.0 0.0 0.0 6.0 0.0 0.0 0.0 7.0"')
            text += f"{n}\n{comment}\n" + "".join(f"{e} {x} {y} {z}\n" for e, x, y, z in atoms)
            want += [(number, i, *a, 5.0 if number % 3 == 2 else None) for i, a in enumerate(atoms)]
            number += 1
        (tmp_path / name).write_text(text + "\n9\nnot read\n" if name == "b.xyz" else text.rstrip("\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        fr, at = T.read_xyz(spark, str(tmp_path))
        assert "MapInPandas" not in at._jdf.queryExecution().optimizedPlan().toString()
        found = sorted(tuple(r) for r in at.join(fr.select("frame_id", "lx"), "frame_id").select("frame_id", "atom_idx", "element", "x", "y", "z", "lx").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted(want)
