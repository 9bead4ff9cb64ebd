from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.engine import Trajectory
from emberframe.functions import geometry as G
from emberframe.functions.elements import RADII, radius
from emberframe.operators import perception as P
from emberframe.operators import runs as R
from emberframe.operators import tracks as K
from emberframe.sources import trajectory as sources

CELL = [[10.0, 0.0, 0.0], [3.0, 9.0, 0.0], [-2.0, 1.0, 8.0]]


def slanted(spark, frames):
    return spark.createDataFrame([(f, CELL) for f in range(frames)], "frame_id long, cell array<array<double>>")


def walk(frames, atoms=2, seed=3):
    """Unwrapped positions, and the same folded into the cell."""
    rng = np.random.default_rng(seed)
    own = rng.uniform(0, 8, (1, atoms, 3)) + np.cumsum(rng.normal(0, 0.6, (frames, atoms, 3)), axis=0)
    parts = own @ np.linalg.inv(np.array(CELL))
    return own, (parts - np.floor(parts)) @ np.array(CELL)


def as_atoms(spark, points):
    rows = [(f, a, "O", *map(float, points[f, a])) for f in range(points.shape[0]) for a in range(points.shape[1])]
    return spark.createDataFrame(rows, "frame_id long, atom_idx int, element string, x double, y double, z double")


def test_the_kind_of_cell_follows_from_the_frames(spark):
    assert G.cell_of(slanted(spark, 2)) is G.CELL
    box = spark.createDataFrame([(0, [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 6.0]], 4.0, 5.0, 6.0)], "frame_id long, cell array<array<double>>, lx double, ly double, lz double")
    assert G.cell_of(box) is G.BOX and G.cell_of(box.drop("cell")) is G.BOX and G.cell_of(box.drop("lx", "ly", "lz")) is G.CELL


def test_paths_in_slanted_cells_do_not_jump(spark):
    own, folded = walk(12)
    atoms, frames = as_atoms(spark, folded), slanted(spark, 12)
    for unwrap in (K.unwrap, K.unwrap_in_order):
        found = {(r["atom_idx"], r["frame_id"]): (r["x"], r["y"], r["z"]) for r in unwrap(atoms, frames, box=G.CELL).collect()}
        for (a, f), p in found.items():
            assert np.allclose(np.array(p) - found[a, 0], own[f, a] - own[0, a])


def test_tracks_and_chains_in_slanted_cells(spark):
    own, folded = walk(12, atoms=1)
    mols = as_atoms(spark, folded).select("frame_id", F.lit(0).alias("mol_id"), F.lit("O").alias("formula"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    frames = slanted(spark, 12)
    track = sorted((r["idx"], r["x"], r["y"], r["z"]) for r in K.greedy_tracks(mols, R.lifetime_segments(mols), frames, box=G.CELL).collect())
    assert np.allclose(np.array(track)[:, 1:] - track[0][1:], own[:, 0] - own[0, 0])
    some = mols.filter("frame_id <> 6")
    segments = R.lifetime_segments(some)
    chains, links = K.stitch(K.greedy_tracks(some, segments, frames, box=G.CELL), some, segments, frames, "O", max_gap=3, max_jump=5.0, box=G.CELL)
    chain = sorted((r["idx"], r["x"], r["y"], r["z"]) for r in chains.collect())
    assert links.count() == 1 and np.allclose(np.array(chain)[:, 1:] - chain[0][1:], np.delete(own[:, 0], 6, axis=0) - own[0, 0])


def test_slanted_cells_survive_xyz(spark, tmp_path):
    _, folded = walk(3)
    atoms, frames = as_atoms(spark, folded), slanted(spark, 3)
    sources.xyz_text(atoms, frames).coalesce(1).sortWithinPartitions("frame_id").select("value").write.text(str(tmp_path / "w"))
    path = str(next((tmp_path / "w").glob("part-*")).rename(tmp_path / "w.xyz"))
    t = Trajectory.read(spark, path)
    assert t.box is G.CELL and [r["cell"] for r in t.frames.collect()] == [CELL] * 3
    moved = K.recenter(t.atoms, t.frames, center_atoms=[0], wrap=True, box=t.box).filter("atom_idx = 0").collect()
    assert all(np.allclose((r["x"], r["y"], r["z"]), np.array(CELL).sum(0) / 2) for r in moved)
    with pytest.raises(ValueError, match="not a format"):
        Trajectory.read(spark, "x.dcd")


def test_pairs_by_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    atoms = as_atoms(spark, rng.uniform(-20, 40, (2, 120, 3)))
    long = spark.createDataFrame([(f, [[x * 3 for x in row] for row in CELL]) for f in range(2)], "frame_id long, cell array<array<double>>")
    boxes = spark.createDataFrame([(0, 30.0, 25.0, 6.0), (1, 11.0, 40.0, 30.0)], "frame_id long, lx double, ly double, lz double")
    for frames, box in ((long, G.CELL), (boxes, G.BOX)):
        plain = {(r["frame_id"], r["a_idx"], r["b_idx"]) for r in P.pairs(atoms, atoms, frames, box=box).filter("d <= 3.5").collect()}
        near = [(r["frame_id"], r["a_idx"], r["b_idx"]) for r in P.pairs(atoms, atoms, frames, box=box, cutoff=3.5).collect()]
        assert len(plain) > 300 and len(near) == len(plain) and set(near) == plain


def test_a_frame_of_many_atoms(spark):
    # 6,750 waters on a lattice 3 apart: as many molecules
    side = 15
    grid = spark.range(2 * side**3).select(F.lit(0).cast("long").alias("frame_id"), F.col("id").alias("n"), *[(F.floor(F.col("id") / side**k) % (2 * side if k == 2 else side)).cast("double").alias(f"g{k}") for k in range(3)])
    parts = [("O", 0.0, 0.0), ("H", 0.96, 0.0), ("H", -0.24, 0.93)]
    atoms = grid.select("frame_id", F.posexplode(F.array(*[F.struct(F.lit(e).alias("element"), (F.col("g0") * 3 + x).alias("x"), (F.col("g1") * 3 + y).alias("y"), (F.col("g2") * 3).alias("z")) for e, x, y in parts])).alias("k", "p"), "n").select("frame_id", (F.col("n") * 3 + F.col("k")).cast("int").alias("atom_idx"), "p.*")
    frames = spark.createDataFrame([(0, 3.0 * side, 3.0 * side, 6.0 * side)], "frame_id long, lx double, ly double, lz double")
    topo = P.build_molecules(atoms, frames)
    assert atoms.count() == 20_250
    sizes = {r["formula"]: r["n"] for r in P.molecules(atoms, topo).groupBy("formula").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"H2O": 6_750}


def test_long_chains_are_one_component(spark):
    n = 5_000
    order = np.random.default_rng(6).permutation(n)
    edges = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(order, order[1:])], "frame_id long, i int, j int")
    atoms = spark.range(n + 1).select(F.lit(0).cast("long").alias("frame_id"), F.col("id").cast("int").alias("atom_idx"))
    found = {r["mol_id"]: r["count"] for r in P.components(atoms, edges).groupBy("mol_id").count().collect()}
    assert found == {0: n, 1: 1}


def test_radii_of_all_elements(spark):
    df = spark.createDataFrame([("K",), ("Fe",), ("Cm",), ("Og",)], "e string").select("e", radius(F.col("e")).alias("r"))
    assert {r["e"]: r["r"] for r in df.collect()} == {"K": 2.03, "Fe": 1.32, "Cm": 1.69, "Og": 0.2} and len(RADII) == 96


def test_kinetics_of_an_absent_formula(spark):
    segments = spark.createDataFrame([("HO", 0, 2, 5), ("HO", 1, 8, 9)], "formula string, segment int, start int, stop int")
    found = {r["formula"]: r for r in R.reaction_kinetics(segments, 10, formulas=["HO", "H9"]).collect()}
    assert found["HO"]["n_events"] == 2 and found["HO"]["rate"] == 0.2
    assert found["H9"]["n_events"] == 0 and found["H9"]["rate"] == 0 and np.isnan(found["H9"]["mean_lifetime"]) and np.isnan(found["H9"]["median_lifetime"])


def test_segment_frames_by_name(spark):
    atoms = spark.createDataFrame([(f, 0, "O", 1.0, 1.0, 1.0) for f in (0, 1, 4, 5, 6)], "frame_id long, atom_idx int, element string, x double, y double, z double")
    t = Trajectory(sources.box_frames(spark, 8, 10.0), atoms)
    assert [r["frame_id"] for r in t.segment_frames("O", -1).orderBy("frame_id").collect()] == [4, 5, 6]


def test_segment_frames_of_few_segments(spark, tmp_path):
    # events in each frame, then in none at all: the query has no frames, as SQL has, and the operator refuses
    import duckdb

    from emberframe.plans.queries import ORACLE_SQL, QUERIES

    events = spark.range(20).selectExpr("id as event_id", "timestamp_micros(1704067200000000 + id * 600000000) as ts", "id as user_id", "'buy' as event_type")
    for name, own in (("full", events), ("none", events.limit(0))):
        own.coalesce(1).write.parquet(str(tmp_path / name / "events.parquet"))
        found = QUERIES["segment_frames"](spark, str(tmp_path / name))
        sql = duckdb.connect()
        sql.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts AT TIME ZONE 'UTC' AS ts) FROM '{tmp_path}/{name}/events.parquet/*.parquet'")
        assert found.columns == ["frame_id"] and found.count() == 0 and sql.execute(ORACLE_SQL["segment_frames"]).fetchall() == []
    segments = spark.createDataFrame([("buy", 0, 0, 20)], "formula string, segment int, start int, stop int")
    with pytest.raises(IndexError):
        R.segment_frames(spark.range(20).withColumnRenamed("id", "frame_id"), segments, "buy", 3)


def test_long_paths_in_changing_cells_take_linear_time(spark):
    # folded inside one row, 30,000 frames took minutes
    n = 30_000
    at = [F.pmod(F.col("frame_id") * 7 * (k + 2) + F.floor(F.col("frame_id") / 11), F.lit(97)).cast("double") / 10 for k in range(3)]
    frames = spark.range(n).select(F.col("id").alias("frame_id"), *[(F.lit(9.7) + F.pmod(F.col("id") + k, F.lit(5)) / 100).alias(c) for k, c in enumerate(("lx", "ly", "lz"))])
    points = frames.select("frame_id", F.lit(4).alias("atom_idx"), *[x.alias(a) for a, x in zip("xyz", at)])
    began = time.time()
    found = K.unwrap_in_order(points, frames).orderBy("frame_id").collect()
    assert time.time() - began < 45 and found[0].asDict().keys() == {"atom_idx", "frame_id", "x", "y", "z"} and len(found) == n
    cells, before = {r["frame_id"]: np.array(r[1:]) for r in frames.collect()}, None
    for p, r in zip(points.orderBy("frame_id").collect(), found):
        place = np.array(p[2:])
        if before is not None:
            step = place - before
            place = before + (step - cells[p["frame_id"]] * np.rint(step / cells[p["frame_id"]]))
        assert r["frame_id"] == p["frame_id"] and tuple(r[2:]) == tuple(place)
        before = place


def test_paths_with_gaps_in_their_numbers(spark):
    points = spark.createDataFrame([(a, f, None if (a, f) == (0, 1) else (f * 4.0) % 10, 1.0, float("nan") if (a, f) == (1, 1) else 2.0) for a in range(2) for f in range(3)], "atom_idx int, frame_id int, x double, y double, z double")
    cells = spark.createDataFrame([(f, [[10.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 10.0]]) for f in range(3)], "frame_id int, cell array<array<double>>")
    boxes = cells.select("frame_id", *[F.lit(10.0).alias(c) for c in G.BOX.columns])
    box = [tuple(map(str, r[2:])) for r in K.unwrap_in_order(points, boxes).orderBy("atom_idx", "frame_id").collect()]
    assert box == [("0.0", "1.0", "2.0"), ("None", "1.0", "2.0"), ("None", "1.0", "2.0"), ("0.0", "1.0", "2.0"), ("4.0", "1.0", "nan"), ("8.0", "1.0", "nan")]
    cell = [tuple(map(str, r[2:])) for r in K.unwrap_in_order(points.filter("atom_idx = 0"), cells, box=G.CELL).orderBy("frame_id").collect()]
    assert cell == [("0.0", "1.0", "2.0"), ("None",) * 3, ("None",) * 3]
    free = [r["x"] for r in K.unwrap_in_order(points.filter("atom_idx = 1"), cells, box=G.Open()).orderBy("frame_id").collect()]
    assert free == [0.0, 4.0, 8.0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_recenter_gathers_no_path_in_one_row(spark, tiny):
    from emberframe.plans.queries import QUERIES

    plan = plan_of(QUERIES["recenter"](spark, tiny))
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_cluster_around_gathers_no_path_in_one_row(spark, tiny):
    from emberframe.plans.queries import QUERIES

    plan = plan_of(QUERIES["cluster_around"](spark, tiny))
    assert "collect_list" not in plan and "MapInArrow" in plan
