"""Tracks of molecules whose numbers change from frame to frame, and positions that do not jump at borders.

Matching from one frame to the next depends on the match before, so it runs inside one task per formula and segment, and paths in
cells that change inside one per entity. Such a task streams through its sorted rows and holds the last positions. Everything else is windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.operators.selectors import FRAME

TRACK_SCHEMA = "formula string, segment int, track int, idx int, frame_id long, x double, y double, z double"


def _nearest(delta: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The image in the cell (rows are its vectors, all zero for none) by rounding its parts along them."""
    if not cell.any():
        return delta
    lengths = np.diagonal(cell)
    if not (cell - np.diag(lengths)).any():
        return delta - lengths * np.rint(delta / lengths)
    parts = delta @ np.linalg.inv(cell)
    return delta - np.rint(parts) @ cell


class _Tracks:
    """The live tracks of one segment: each in turn takes the nearest centre still free; tracks that get none end, centres left over begin new ones. Only their last positions are held."""

    def __init__(self, max_step: float | None):
        self.max_step, self.live, self.begun = max_step, [], 0

    def step(self, frame, centers: np.ndarray, cell: np.ndarray) -> list[tuple]:
        """The rows (born, idx, frame, x, y, z) of one frame; a track's first row comes with its second, so tracks of one frame have none."""
        free, rows, following = np.ones(len(centers), dtype=bool), [], []
        for where, born, idx, at, since in self.live:
            if not free.any():
                break
            step = _nearest(centers - where, cell)
            far = np.where(free, (step * step).sum(1), np.inf)
            j = int(far.argmin())
            if self.max_step is None or far[j] <= self.max_step * self.max_step:
                free[j] = False
                if idx == 0:
                    rows.append((born, 0, since, *at.tolist()))
                at = at + step[j]
                rows.append((born, idx + 1, frame, *at.tolist()))
                following.append((centers[j], born, idx + 1, at, None))
        for j in np.flatnonzero(free):
            following.append((centers[j], self.begun, 0, centers[j], frame))
            self.begun += 1
        self.live = following
        return rows


def greedy_tracks(mols: DataFrame, segments: DataFrame, frames: DataFrame, formulas: list[str] | None = None, *, max_step: float | None = None, box: G.Box = G.BOX) -> DataFrame:
    """formula, segment, track, idx, frame_id, x, y, z: unwrapped centres of molecules followed through each segment. max_step, if given, is the longest step that a track takes.

    Tracks are numbered in the order of their ends, those that end together in the order of their beginnings.
    """
    import pyarrow as pa

    own = segments if formulas is None else segments.filter(F.col("formula").isin(formulas))
    cell = [F.get(F.flatten("cell"), i).alias(f"cell_{i}") for i in range(9)]
    points = mols.select(FRAME, "mol_id", "formula", "cx", "cy", "cz").join(own, "formula").filter((F.col(FRAME) >= F.col("start")) & (F.col(FRAME) < F.col("stop"))).join(frames.select(FRAME, box.matrix().alias("cell")), FRAME)
    points = points.select("formula", "segment", FRAME, "mol_id", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "cz")], *cell)
    kinds = pa.schema([("formula", pa.string()), ("segment", pa.int32()), ("born", pa.int64()), ("idx", pa.int32()), ("frame_id", pa.int64()), *[(a, pa.float64()) for a in "xyz"]])

    def follow(batches):
        key, tracks, frame, held = None, None, None, []  # held: the numbers of one frame, which batches may cut

        def ended() -> list[tuple]:
            numbers = np.array(held, dtype=float)
            return [(*key, *row) for row in tracks.step(frame, numbers[:, :3], numbers[0, 3:].reshape(3, 3))]

        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for segment, at, numbers in zip(zip(*columns[:2]), columns[2], zip(*columns[4:])):
                if held and (segment != key or at != frame):
                    found += ended()
                    held = []
                if segment != key:
                    key, tracks = segment, _Tracks(max_step)
                frame = at
                held.append(numbers)
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], f.type) for k, f in enumerate(kinds)], schema=kinds)
        if held:
            found = ended()
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], f.type) for k, f in enumerate(kinds)], schema=kinds)

    rows = points.repartition("formula", "segment").sortWithinPartitions("formula", "segment", FRAME, "mol_id").mapInArrow(follow, TRACK_SCHEMA.replace("track int", "born long"))
    rows = rows.withColumn("last", F.max("frame_id").over(W.partitionBy("formula", "segment", "born")))
    number = F.dense_rank().over(W.partitionBy("formula", "segment").orderBy("last", "born")) - 1
    return rows.select("formula", "segment", number.cast("int").alias("track"), "idx", "frame_id", "x", "y", "z")


def stitch(tracks: DataFrame, mols: DataFrame, segments: DataFrame, frames: DataFrame, formula: str, *, max_gap: int = 50, max_jump: float = 4.0, box: G.Box = G.BOX) -> tuple[DataFrame, DataFrame]:
    """Chains (chain, idx, x, y, z) of a formula's segments, and links (from_stop, to_start, gap, jump).

    Of each segment the longest track counts (the first of equals). A segment goes on in the segment that starts within max_gap frames after
    its end and whose first centre is nearest to its last one, at most max_jump away in the last frame's box; each segment is taken once,
    in the order of ends. Segments of one formula do not overlap, so at each end one segment looks for one successor.
    """
    import pandas as pd

    own = segments.filter(F.col("formula") == formula)
    if own.isEmpty():
        raise ValueError(f"no frame has {formula}")
    lengths = tracks.filter(F.col("formula") == formula).groupBy("segment", "track").agg(F.count("*").alias("len"))
    longest = lengths.groupBy("segment").agg(F.max(F.struct("len", (-F.col("track")).alias("t"))).alias("m")).select("segment", (-F.col("m.t")).alias("track"))
    path = tracks.filter(F.col("formula") == formula).join(longest, ["segment", "track"])
    first = mols.filter(F.col("formula") == formula).groupBy(FRAME).agg(F.min(F.struct("mol_id", "cx", "cy", "cz")).alias("m")).select(FRAME, "m.cx", "m.cy", "m.cz")
    at = own.join(longest.select("segment"), "segment").select("segment", "start", "stop")
    at = at.join(first.select(F.col(FRAME).alias("start"), F.array("cx", "cy", "cz").alias("a")), "start").join(first.select((F.col(FRAME) + 1).alias("stop"), F.array("cx", "cy", "cz").alias("b")), "stop")
    ends = path.groupBy("segment").agg(F.min(F.struct("idx", "x", "y", "z")).alias("p"), F.max(F.struct("idx", "x", "y", "z")).alias("q"))
    at = at.join(ends, "segment").select("segment", "start", "stop", "a", "b", F.array("p.x", "p.y", "p.z").alias("p"), F.array("q.x", "q.y", "q.z").alias("q"))
    last = frames.groupBy().agg(F.max(F.struct(FRAME, box.matrix().alias("cell"))).alias("m")).select("m.cell")
    at = at.crossJoin(F.broadcast(last)).withColumn("formula", F.lit(formula))  # last: one row

    def chain(pdf):
        pdf = pdf.sort_values("start", ignore_index=True)
        a, b, p, q = (np.array(pdf[c].tolist(), dtype=float) for c in "abpq")
        cell, start, stop = np.array([list(row) for row in pdf["cell"][0]], dtype=float), pdf["start"].to_numpy(), pdf["stop"].to_numpy()
        nxt, taken = np.full(len(pdf), -1), np.zeros(len(pdf), dtype=bool)
        for i in np.argsort(stop, kind="stable"):
            can = (start >= stop[i]) & (start <= stop[i] + max_gap) & ~taken
            far = np.sqrt((_nearest(a - b[i], cell) ** 2).sum(1))
            can &= far <= max_jump
            if can.any():
                j = int(np.where(can, far, np.inf).argmin())
                nxt[i], taken[j] = j, True
        rows = []
        for head, chain_no in zip(np.flatnonzero(~taken), range(len(pdf))):
            i, place, offset, jump, before = int(head), 0, np.zeros(3), None, -1
            while i >= 0:
                rows.append((chain_no, place, int(pdf["segment"][i]), *map(float, offset), None if before < 0 else int(stop[before]), int(start[i]), jump))
                j = int(nxt[i])
                if j >= 0:
                    d = _nearest(a[j] - b[i], cell)
                    offset = q[i] + offset + d - p[j]
                    jump = float(np.sqrt((d * d).sum()))
                i, before, place = j, i, place + 1
        return pd.DataFrame(rows, columns=["chain", "place", "segment", "ox", "oy", "oz", "from_stop", "to_start", "jump"]).astype({"from_stop": "Int64", "jump": "float64"})

    plan = at.groupBy("formula").applyInPandas(chain, "chain int, place int, segment int, ox double, oy double, oz double, from_stop long, to_start long, jump double")
    order = W.partitionBy("chain").orderBy("place", "idx")
    chains = path.join(plan, "segment").select("chain", (F.row_number().over(order) - 1).alias("idx"), (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), (F.col("z") + F.col("oz")).alias("z"))
    links = plan.filter("from_stop is not null").select("from_stop", "to_start", (F.col("to_start") - F.col("from_stop")).alias("gap"), "jump")
    return chains, links


def unwrap(points: DataFrame, frames: DataFrame, *, entity: str = "atom_idx", box: G.Box = G.BOX) -> DataFrame:
    """entity, frame_id, x, y, z without jumps: the first position plus the nearest images of all steps, each in the box of its later frame. Equal to following the unwrapped position itself where the box is constant, as whole boxes then drop out."""
    by = W.partitionBy(entity).orderBy(FRAME)
    own = points.select(entity, FRAME, "x", "y", "z").join(frames.select(FRAME, *box.columns), FRAME)
    own = own.withColumns({f"p{a}": F.lag(a).over(by) for a in "xyz"})
    step = box.mic(G.minus(G.vector(""), G.vector("p")))
    own = own.withColumns({f"s{a}": F.coalesce(s, F.col(a)) for a, s in zip("xyz", step)})
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    return own.select(entity, FRAME, *[F.sum(f"s{a}").over(so_far).alias(a) for a in "xyz"])


def unwrap_in_order(points: DataFrame, frames: DataFrame, *, entity: str = "atom_idx", box: G.Box = G.BOX) -> DataFrame:
    """unwrap for cells that change: each position is the image nearest to the unwrapped one before, followed along the entity's sorted frames.

    A task streams through its entities and holds one position, whatever their frames; nulls stay null from the first one on.
    """
    import pyarrow as pa

    cell = {f"cell_{i}": c for i, c in enumerate(box.numbers())}
    own = points.select(entity, FRAME, *[F.col(a).cast("double").alias(a) for a in "xyz"]).join(frames.select(FRAME, *[c.alias(n) for n, c in cell.items()]), FRAME)
    own = own.select(entity, FRAME, *"xyz", *cell)
    image, boxed = type(box).image, bool(cell)

    def follow(batches):
        of, before = None, None
        for batch in batches:
            names, values = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[2:]]
            places = []
            for name, place, lengths in zip(names, zip(*values[:3]), zip(*values[3:]) if boxed else [()] * batch.num_rows):
                if before is not None and name == of:
                    if None in place or None in before or None in lengths:
                        place = _with_nulls(image, before, place, lengths)
                    else:
                        step = image([p - q for p, q in zip(place, before)], lengths)
                        place = [q + d for q, d in zip(before, step)]
                of, before = name, place
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([p[k] for p in places], pa.float64()) for k in range(3)]], names=[entity, FRAME, *"xyz"])

    kinds = [own.schema[c].dataType.simpleString() for c in (entity, FRAME)]
    return own.repartition(entity).sortWithinPartitions(entity, FRAME, *"xyz").mapInArrow(follow, f"`{entity}` {kinds[0]}, `{FRAME}` {kinds[1]}, x double, y double, z double")


def _with_nulls(image, before, place, lengths) -> list[float | None]:
    """The next position where some numbers are missing, as SQL would have it: an axis of a box is null by itself, all axes of another cell are."""
    if len(lengths) == 9:
        return [None] * 3
    if not lengths:
        return [None if p is None or q is None else q + (p - q) for p, q in zip(place, before)]
    return [None if None in (p, q, length) else q + image([p - q], [length])[0] for p, q, length in zip(place, before, lengths)]


def make_whole(atoms: DataFrame, topo: DataFrame, frames: DataFrame, *, anchors: list[int] | None = None, box: G.Box = G.BOX) -> DataFrame:
    """frame_id, atom_idx, element, mol_id, x, y, z: each molecule around its first atom (or its first anchor), across borders."""
    own = atoms.select(FRAME, "atom_idx", "element", "x", "y", "z").join(topo, [FRAME, "atom_idx"]).join(frames.select(FRAME, *box.columns), FRAME)
    rank = F.when(F.col("atom_idx").isin(anchors), 0).otherwise(1) if anchors else F.lit(1)
    first = F.min(F.struct(rank.alias("k"), "atom_idx", "x", "y", "z")).over(W.partitionBy(FRAME, "mol_id"))
    own = own.withColumn("f", first)
    ref = (F.col("f.x"), F.col("f.y"), F.col("f.z"))
    near = box.mic(G.minus(G.vector(""), ref))
    is_ref = F.col("atom_idx") == F.col("f.atom_idx")
    return own.select(FRAME, "atom_idx", "element", "mol_id", *[F.when(is_ref, F.col(a)).otherwise(r + d).alias(a) for a, r, d in zip("xyz", ref, near)])


def _center(whole: DataFrame, *, atoms: list[int] | None, formula: str | None, instance: int, mols: DataFrame | None) -> DataFrame | None:
    """frame_id, ax, ay, az: the mean of some atoms, or of a molecule of a formula, of each frame that has them."""
    if atoms is not None:
        own = whole.filter(F.col("atom_idx").isin(atoms))
    elif formula is not None and mols is not None:
        pick = mols.filter(F.col("formula") == formula).withColumn("k", F.row_number().over(W.partitionBy(FRAME).orderBy("mol_id")) - 1).filter(F.col("k") == instance)
        own = whole.join(pick.select(FRAME, "mol_id"), [FRAME, "mol_id"])
    else:
        return None
    return own.groupBy(FRAME).agg(*[F.avg(a).alias(f"a{a}") for a in "xyz"])


def vacuum(atoms: DataFrame, topo: DataFrame, frames: DataFrame, *, center_atoms: list[int] | None = None, center_formula: str | None = None, center_instance: int = 0, mols: DataFrame | None = None, box: G.Box = G.BOX) -> DataFrame:
    """Whole molecules without a box, the centre at the origin if one is named; frames without it stay where they are."""
    whole = make_whole(atoms, topo, frames, box=box)
    center = _center(whole, atoms=center_atoms, formula=center_formula, instance=center_instance, mols=mols)
    if center is None:
        return whole
    moved = whole.join(center, FRAME, "left")
    return moved.select(FRAME, "atom_idx", "element", "mol_id", *[(F.col(a) - F.coalesce(f"a{a}", F.lit(0.0))).alias(a) for a in "xyz"])


def cluster_around(atoms: DataFrame, topo: DataFrame, frames: DataFrame, *, center_atoms: list[int] | None = None, center_coords: tuple[float, float, float] | None = None, center_formula: str | None = None, center_instance: int = 0, mols: DataFrame | None = None, box: G.Box = G.BOX) -> DataFrame:
    """Whole molecules that gather around the anchor in the first frame, and from then on move without jumps; the anchor's place in each frame becomes the origin (fixed coordinates choose the images of the first frame only)."""
    whole = make_whole(atoms, topo, frames, anchors=center_atoms, box=box)
    first = whole.agg(F.min(FRAME).alias("first"))
    start = whole.join(F.broadcast(first), F.col(FRAME) == F.col("first")).drop("first")
    anchor = _center(start, atoms=center_atoms, formula=None if center_coords is not None else center_formula, instance=center_instance, mols=mols) if center_coords is None or center_atoms is not None else None
    middle = start.groupBy(FRAME).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    if center_coords is not None:
        middle = middle.select(FRAME, *[F.lit(float(c)).alias(f"m{a}") for a, c in zip("xyz", center_coords)])
        anchor = None
    start = start.join(frames.select(FRAME, *box.columns), FRAME).join(middle, FRAME)
    if anchor is not None:
        start = start.join(anchor, FRAME, "left")
    goal = tuple(F.coalesce(F.col(f"a{a}"), F.col(f"m{a}")) if anchor is not None else F.col(f"m{a}") for a in "xyz")
    mol = W.partitionBy(FRAME, "mol_id")
    start = start.withColumns({f"c{a}": F.avg(a).over(mol) for a in "xyz"})
    away = G.minus(G.vector("c"), goal)  # type: ignore[arg-type]
    near = box.mic(away)
    placed = start.select(FRAME, "atom_idx", "element", "mol_id", *[(F.col(a) + n - w).alias(a) for a, n, w in zip("xyz", near, away)])
    later = whole.join(F.broadcast(first), F.col(FRAME) > F.col("first")).drop("first")
    both = placed.unionByName(later)
    moving = unwrap_in_order(both, frames, box=box)
    found = moving.join(whole.select(FRAME, "atom_idx", "element", "mol_id"), [FRAME, "atom_idx"])
    shift = _center(found, atoms=center_atoms, formula=None if center_coords is not None else center_formula, instance=center_instance, mols=mols)
    if shift is None:
        return found.select(FRAME, "atom_idx", "element", "mol_id", "x", "y", "z")
    return found.join(shift, FRAME, "left").select(FRAME, "atom_idx", "element", "mol_id", *[(F.col(a) - F.coalesce(f"a{a}", F.lit(0.0))).alias(a) for a in "xyz"])


def recenter(atoms: DataFrame, frames: DataFrame, *, center_atoms: list[int] | None = None, center_coords: tuple[float, float, float] | None = None, wrap: bool = False, box: G.Box = G.BOX) -> DataFrame:
    """Atoms that move without jumps, shifted so that the centre of some atoms (or a fixed point) lies in the middle of the cell; wrap folds them back into it."""
    moving = unwrap_in_order(atoms, frames, box=box).join(frames.select(FRAME, *box.columns), FRAME).join(atoms.select(FRAME, "atom_idx", "element"), [FRAME, "atom_idx"])
    if center_atoms is not None:
        ref = moving.filter(F.col("atom_idx").isin(center_atoms)).groupBy(FRAME).agg(*[F.avg(a).alias(f"a{a}") for a in "xyz"])
        moving = moving.join(ref, FRAME)
        goal = G.vector("a")
    elif center_coords is not None:
        goal = tuple(F.lit(float(c)) for c in center_coords)  # type: ignore[assignment]
    else:
        goal = box.center()
    moved = tuple(F.col(a) + (c - g) for a, c, g in zip("xyz", box.center(), goal))
    if wrap:
        moved = box.wrap(moved)  # type: ignore[arg-type]
    return moving.select(FRAME, "atom_idx", "element", *[m.alias(a) for a, m in zip("xyz", moved)])
