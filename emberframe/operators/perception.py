"""Molecules from distances, frame by frame.

Pairs are an equi-join with the distance as residual. Where a cutoff is known the key is the frame and a cell of at least the
cutoff's width, so rows grow with the atoms and no task gets a whole large frame; along an axis shorter than three cutoffs there is
one cell, and in small frames the key is the frame alone. Components are found by numpy, many frames at a time, in time near linear
in a frame's bonds; frames whose bonds don't fit a task go through ``iterative_components``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.functions.elements import LIGANDS, formula_of, radius
from emberframe.operators.selectors import FRAME

#: Padding of each radius in the neighbour search: by distance rules of molecules, and by those of coordination spheres.
SKIN, SPHERE_SKIN = 0.3, 0.1


def _sides(atoms: DataFrame, other: DataFrame | None = None, carry: tuple[str, ...] = ("element",)) -> tuple[DataFrame, DataFrame]:
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(FRAME, F.col("atom_idx").alias(f"{p}idx"), *[F.col(c).alias(f"{p}{c}") for c in ("x", "y", "z", *carry)])

    return side(atoms, "a_"), side(atoms if other is None else other, "b_")


def _in_cells(df: DataFrame, p: str, own: DataFrame, box: G.Box, spread: bool) -> DataFrame:
    """df with its atoms' cells cx, cy, cz; with spread, once for each cell around."""
    placed = df.join(own, FRAME)
    for axis, f in zip("xyz", box.fractional(G.vector(p))):
        n = F.col(f"n{axis}")
        placed = placed.withColumn(f"c{axis}", F.least(F.floor((f - F.floor(f)) * n).cast("int"), n - 1))
    if spread:
        for axis in "xyz":
            n = F.col(f"n{axis}")
            step = F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1))))
            placed = placed.withColumn("step", step).withColumn(f"c{axis}", F.pmod(F.col(f"c{axis}") + F.col("step"), n)).drop("step")
        placed = placed.drop(*box.columns)
    return placed.drop("nx", "ny", "nz")


def pairs(a: DataFrame, b: DataFrame, frames: DataFrame, *, box: G.Box = G.BOX, carry: tuple[str, ...] = ("element",), cutoff: float | Column | None = None) -> DataFrame:
    """All pairs of atoms of a and b in one frame, with the nearest image's displacement (dx, dy, dz) from a to b and d; with a cutoff (a number, or a column of frames), those with d <= cutoff."""
    left, right = _sides(a, b, carry)
    reach = F.lit(cutoff) if cutoff is None or isinstance(cutoff, (int, float)) else cutoff
    cells = frames.select(FRAME, *box.columns, reach.cast("double").alias("reach"))
    if cutoff is None or not box.columns:
        both = left.join(right, FRAME).join(cells, FRAME)
    else:
        # cells a little wider than the cutoff: rounding must not part a pair from its neighbour
        wide = F.col("reach") * (1 + 1e-9) + 1e-12
        own = cells.withColumns({f"n{axis}": F.when(h >= 3 * wide, F.least(F.floor(h / wide), F.lit(1 << 20))).otherwise(1).cast("int") for axis, h in zip("xyz", box.heights())})
        both = _in_cells(left, "a_", own, box, False).join(_in_cells(right, "b_", own, box, True).drop("reach"), [FRAME, "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    away = G.minus(G.vector("b_"), G.vector("a_"))
    if isinstance(box, G.Cell):
        # an image nearer than half of each height has all its parts below a half, so rounding finds it: no other need be tried
        near = F.array(F.struct(F.lit(0.0).alias("d2"), *[x.alias(name) for x, name in zip(box.rounded(away), "xyz")]))
        names = both.columns
        both = both.select(*names, F.inline(F.when(2 * F.col("reach") <= F.least(*box.heights()), near).otherwise(box.nearest(away)))).toDF(*names, "d2", "dx", "dy", "dz").drop("d2")
    else:
        both = both.withColumns(dict(zip(("dx", "dy", "dz"), box.mic(away))))
    both = both.withColumn("d", G.norm((F.col("dx"), F.col("dy"), F.col("dz"))))
    return (both if cutoff is None else both.filter(F.col("d") <= F.col("reach"))).drop("reach")


def pairs_within(a: DataFrame, b: DataFrame, frames: DataFrame, cutoff: float, carry: tuple[str, ...] = ("element",), *, box: G.Box = G.BOX) -> DataFrame:
    """pairs with d < cutoff."""
    return pairs(a, b, frames, box=box, carry=carry, cutoff=cutoff).filter(F.col("d") < cutoff)


def bonds(atoms: DataFrame, frames: DataFrame, *, scale: float = 1.0, skin: float = SKIN, centers: list[str] | None = None, box: G.Box = G.BOX) -> DataFrame:
    """frame_id, i, j (i < j), d: atoms nearer than scale times the sum of their radii plus two skins. Elements in centers have radius 0."""

    own = radius(F.col("element"))
    if centers:
        own = F.when(F.col("element").isin(centers), F.lit(0.0)).otherwise(own)
    sized = atoms.select(FRAME, "atom_idx", "x", "y", "z", own.alias("radius"))
    # no bond of a frame is longer than one between two of its largest atoms
    largest = sized.groupBy(FRAME).agg(F.max("radius").alias("largest"))
    near = pairs(sized, sized, frames.join(largest, FRAME), box=box, carry=("radius",), cutoff=2 * scale * F.col("largest") + 2 * skin).filter("a_idx < b_idx").filter(F.col("d") < scale * (F.col("a_radius") + F.col("b_radius")) + 2 * skin)
    return near.select(FRAME, F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), "d")


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by spreading labels and jumping to labels' labels."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        # a root takes the smallest label that any of its nodes' bonds lead to
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def components(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """frame_id, atom_idx, mol_id: components of each frame's edges; molecules are numbered by their smallest atom. Atoms are numbered from 0."""
    spine = atoms.groupBy(FRAME).agg(F.max("atom_idx").alias("last"))
    linked = edges.groupBy(FRAME).agg(F.collect_list(F.struct("i", "j")).alias("e")).select(FRAME, F.transform("e", lambda e: e["i"]).alias("i"), F.transform("e", lambda e: e["j"]).alias("j"))

    def label(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["last"].to_numpy() + 1
            base = np.cumsum(size) - size
            ends = []
            for c in "ij":
                lists = [np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in pdf[c]]
                ends.append(np.concatenate([b + x for b, x in zip(base, lists)]))
            found = _labels(int(size.sum()), *ends)
            frame = np.repeat(np.arange(len(pdf)), size)
            yield pd.DataFrame({FRAME: pdf[FRAME].to_numpy()[frame], "atom_idx": np.arange(len(found)) - base[frame], "label": found - base[frame]})

    kind = atoms.schema[FRAME].dataType.simpleString()
    found = spine.join(linked, FRAME, "left").mapInPandas(label, f"{FRAME} {kind}, atom_idx int, label int")
    found = found.join(atoms.select(FRAME, "atom_idx"), [FRAME, "atom_idx"])
    return found.withColumn("mol_id", (F.dense_rank().over(W.partitionBy(FRAME).orderBy("label")) - 1).cast("int")).select(FRAME, "atom_idx", "mol_id")


def iterative_components(atoms: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """components for frames of any size: the smallest label spreads over edges; each round is checkpointed."""
    both = edges.select(FRAME, F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select(FRAME, "j", "i"))
    labels = atoms.select(FRAME, F.col("atom_idx").alias("a"), F.col("atom_idx").alias("label"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("a", "b"), [FRAME, "b"]).groupBy(FRAME, "a").agg(F.min("label").alias("near"))
        step = labels.join(near, [FRAME, "a"], "left").select(FRAME, "a", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        root = step.select(FRAME, F.col("a").alias("mid"), F.col("mid").alias("root"))
        step = step.join(root, [FRAME, "mid"]).select(FRAME, "a", "old", F.least("mid", "root").alias("label")).checkpoint()
        labels = step.select(FRAME, "a", "label")
        if step.filter("label != old").isEmpty():
            break
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return labels.withColumn("mol_id", (F.dense_rank().over(W.partitionBy(FRAME).orderBy("label")) - 1).cast("int")).select(FRAME, F.col("a").alias("atom_idx"), "mol_id")


def molecules(atoms: DataFrame, topo: DataFrame) -> DataFrame:
    """frame_id, mol_id, formula, n_atoms, cx, cy, cz: the plain mean of the positions as they are."""
    return atoms.join(topo, [FRAME, "atom_idx"]).groupBy(FRAME, "mol_id").agg(
        formula_of(F.collect_list("element")).alias("formula"), F.count("*").cast("int").alias("n_atoms"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz")
    )


def build_molecules(atoms: DataFrame, frames: DataFrame, mode: str = "molecular", *, bond_scale: float = 1.0, coordination_scale: float = 1.3, box: G.Box = G.BOX) -> DataFrame:
    """topo of each frame; another mode than these two leaves the radii as they are."""
    scale = {"molecular": bond_scale, "coordination": coordination_scale}.get(mode, 1.0)
    return components(atoms, bonds(atoms, frames, scale=scale, box=box))


def build_spheres(atoms: DataFrame, frames: DataFrame, cutoffs: dict[tuple[str, str], float], *, bond_scale: float = 1.0, box: G.Box = G.BOX) -> DataFrame:
    """topo where centres (first elements of cutoffs) join the ligands nearer than their cutoff, besides bonds between the others."""
    covalent = bonds(atoms, frames, scale=bond_scale, skin=SPHERE_SKIN, centers=sorted({a for a, _ in cutoffs}), box=box)
    limit = F.lit(None).cast("double")
    for (a, b), d in cutoffs.items():
        limit = F.when((F.col("a_element") == a) & (F.col("b_element") == b), F.lit(d)).otherwise(limit)
    centers, ligands = sorted({a for a, _ in cutoffs}), sorted({b for _, b in cutoffs})
    near = pairs(atoms.filter(F.col("element").isin(centers)), atoms.filter(F.col("element").isin(ligands)), frames, box=box, cutoff=max(cutoffs.values(), default=0.0)).filter(F.col("d") < limit).filter("a_idx <> b_idx")
    sphere = near.select(FRAME, F.least("a_idx", "b_idx").alias("i"), F.greatest("a_idx", "b_idx").alias("j"), "d")
    return components(atoms, covalent.unionByName(sphere))


def sphere_samples(n_frames: int) -> int:
    """The step between frames that cutoffs are detected on."""
    return max(1, n_frames // max(1, min(50, n_frames)))


def detect_sphere_cutoffs(atoms: DataFrame, frames: DataFrame, centers: list[str], *, ligands: list[str] = LIGANDS, rmax: float = 5.0, dr: float = 0.05, box: G.Box = G.BOX) -> DataFrame:
    """center, ligand, cutoff, peak: the first minimum after the first peak of the smoothed histogram of distances; pairs without one are absent."""
    n = len(G.edges(rmax, dr)) - 1
    near = pairs(atoms.filter(F.col("element").isin(centers)), atoms.filter(F.col("element").isin(ligands)), frames, box=box, cutoff=n * dr).filter("d > 0.3")
    counts = near.withColumn("bin", G.bin_of(F.col("d"), 0.0, n * dr, n)).filter("bin is not null").groupBy(F.col("a_element").alias("center"), F.col("b_element").alias("ligand"), "bin").agg(F.count("*").alias("c"))
    spine = counts.select("center", "ligand").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    half = max(1, round(0.25 / dr)) // 2
    by = W.partitionBy("center", "ligand").orderBy("bin")
    smooth = spine.join(counts, ["center", "ligand", "bin"], "left").withColumn("g", F.sum(F.coalesce("c", F.lit(0))).over(by.rowsBetween(-half, half)) / (2 * half + 1.0))
    smooth = smooth.withColumn("lo", F.lag("g").over(by)).withColumn("hi", F.lead("g").over(by))
    last = max(2, int(0.55 * rmax / dr))
    peak = smooth.filter((F.col("bin") >= 1) & (F.col("bin") < last)).groupBy("center", "ligand").agg(F.max(F.struct("g", -F.col("bin"))).alias("p")).select("center", "ligand", (-F.col("p.col2")).alias("peak_bin"), F.col("p.g").alias("top")).filter("top >= 1")
    low = smooth.join(peak, ["center", "ligand"]).filter("bin > peak_bin and g <= lo and g <= hi").groupBy("center", "ligand").agg(F.min("bin").alias("bin"), F.first("peak_bin").alias("peak_bin"))
    return low.select("center", "ligand", ((F.col("bin") + 0.5) * dr).alias("cutoff"), ((F.col("peak_bin") + 0.5) * dr).alias("peak"))


def persistence_filter(topo: DataFrame, persistence: int) -> DataFrame:
    """topo without short episodes: an atom's run of one membership set that is shorter than persistence frames, not first or last, with equal sets before and after, takes that set. Runs are those of the given topo."""
    members = topo.groupBy(FRAME, "mol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("atom_idx")), lambda x: F.lpad(x.cast("string"), 9, "0")), ",").alias("set"), F.collect_list("atom_idx").alias("atoms"))
    each = members.select(FRAME, "set", F.explode("atoms").alias("atom_idx"))
    by = W.partitionBy("atom_idx").orderBy(FRAME)
    marked = each.withColumn("new", (~F.col("set").eqNullSafe(F.lag("set").over(by))).cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = marked.groupBy("atom_idx", "run").agg(F.first("set").alias("own"), F.count("*").alias("len"))
    order = W.partitionBy("atom_idx").orderBy("run")
    runs = runs.withColumn("before", F.lag("own").over(order)).withColumn("after", F.lead("own").over(order))
    fixed = runs.select("atom_idx", "run", F.when((F.col("len") < persistence) & (F.col("before") == F.col("after")), F.col("before")).otherwise(F.col("own")).alias("kept"))
    each = marked.join(fixed, ["atom_idx", "run"]).select(FRAME, "atom_idx", "kept")
    first = each.groupBy(FRAME, "kept").agg(F.min("atom_idx").alias("least")).withColumn("mol_id", (F.row_number().over(W.partitionBy(FRAME).orderBy("least", "kept")) - 1).cast("int"))
    return each.join(first, [FRAME, "kept"]).select(FRAME, "atom_idx", "mol_id")
