"""Pair, angular and spatial distributions: histograms of one equi-join per frame, partial sums before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.operators.perception import pairs
from emberframe.operators.selectors import FRAME
from emberframe.operators.stats import convolve, gaussian


def default_rmax(frames: DataFrame, box: G.Box = G.BOX) -> float:
    """Half the mean length of the cells' vectors."""
    return 0.5 * frames.agg(F.avg(box.mean_length())).first()[0]


def rdf_partial(centers: DataFrame, targets: DataFrame, frames: DataFrame, n: int, dr: float, *, box: G.Box = G.BOX) -> tuple[DataFrame, DataFrame]:
    """Counts (bin, hits) and one row of additive totals (norm, density, frames): they add up over parts of a trajectory."""
    near = pairs(centers, targets, frames, box=box, carry=(), cutoff=n * dr).filter("a_idx <> b_idx")
    counts = near.select(G.bin_of(F.col("d"), 0.0, n * dr, n).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("hits"))
    c = centers.groupBy(FRAME).agg(F.count("*").alias("nc"))
    t = targets.groupBy(FRAME).agg(F.count("*").alias("nt"))
    each = c.join(t, FRAME).join(frames.select(FRAME, *box.columns), FRAME).withColumn("rho", F.col("nt") / box.volume())
    totals = each.agg(F.sum(F.col("nc") * F.col("rho")).alias("norm"), F.sum("rho").alias("density"), F.count("*").alias("frames"))
    return counts, totals


def rdf(centers: DataFrame, targets: DataFrame, frames: DataFrame, *, rmax: float | None = None, dr: float = 0.02, integrate: bool = False, box: G.Box = G.BOX) -> DataFrame:
    """bin, r, g and, with integrate, n: the radial distribution of targets around centers, an atom's own distance left out.

    Frames without one of both count neither for the norm nor for the mean density. Without any, g and n are 0.
    """
    n = len(G.edges(rmax if rmax is not None else default_rmax(frames, box), dr)) - 1
    counts, totals = rdf_partial(centers, targets, frames, n, dr, box=box)
    spine = frames.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    r = (F.col("bin") + 0.5) * dr
    shell = 4.0 * math.pi * r * r * dr
    curve = spine.join(counts, "bin", "left").crossJoin(F.broadcast(totals))  # totals: one row
    curve = curve.withColumn("r", r).withColumn("g", F.coalesce(F.col("hits") / (F.col("norm") * shell), F.lit(0.0)))
    if not integrate:
        return curve.select("bin", "r", "g")
    so_far = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row per bin
    return curve.withColumn("n", F.coalesce(F.col("density") / F.col("frames"), F.lit(0.0)) * F.sum(F.col("g") * shell).over(so_far)).select("bin", "r", "g", "n")


def rdf_blocks(centers: DataFrame, targets: DataFrame, frames: DataFrame, block: int, *, rmax: float, dr: float = 0.02, box: G.Box = G.BOX) -> DataFrame:
    """bin, r, g, stderr, n_blocks: mean and standard error of the distributions of blocks of frames; one join for all blocks."""
    n = len(G.edges(rmax, dr)) - 1
    number = F.floor(F.col(FRAME) / block).cast("int").alias("block")
    near = pairs(centers, targets, frames, box=box, carry=(), cutoff=n * dr).filter("a_idx <> b_idx")
    counts = near.select(number, G.bin_of(F.col("d"), 0.0, n * dr, n).alias("bin")).filter("bin is not null").groupBy("block", "bin").agg(F.count("*").alias("hits"))
    c, t = centers.groupBy(FRAME).agg(F.count("*").alias("nc")), targets.groupBy(FRAME).agg(F.count("*").alias("nt"))
    norms = c.join(t, FRAME).join(frames.select(FRAME, *box.columns), FRAME).groupBy(number).agg(F.sum(F.col("nc") * F.col("nt") / box.volume()).alias("norm"))
    spine = norms.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = (F.col("bin") + 0.5) * dr
    each = spine.join(counts, ["block", "bin"], "left").withColumn("g", F.coalesce("hits", F.lit(0)) / (F.col("norm") * (4.0 * math.pi * r * r * dr)))
    return each.groupBy("bin").agg(F.avg("g").alias("g"), (F.stddev_samp("g") / F.sqrt(F.count("*"))).alias("stderr"), F.count("*").alias("n_blocks")).select("bin", r.alias("r"), "g", "stderr", "n_blocks")


def rdf_shells(curve: DataFrame, *, peak_min_g: float = 0.5, smooth_sigma: float = 0.0) -> DataFrame:
    """shell, peak, inner, outer and, if the curve has n, cn (up to outer): peaks of g beyond 0.5, with the lowest place between neighbours as border; the last border is the last r."""
    by = W.orderBy("bin")  # a row per bin
    own = curve
    if smooth_sigma > 0:
        first = curve.orderBy("bin").limit(2).collect()
        bins, n = smooth_sigma / (first[1]["r"] - first[0]["r"]), curve.count()
        half = max(1, int(4 * bins))
        kernel = gaussian(bins, half / bins)
        own = curve.join(convolve(curve.select("bin", "g"), kernel, n, place="bin", value="g", mirror=False, out="gs"), "bin")
    else:
        own = curve.withColumn("gs", F.col("g"))
    far = own.filter("r > 0.5").withColumn("lo", F.lag("gs").over(by)).withColumn("hi", F.lead("gs").over(by))
    peaks = far.filter((F.col("gs") > F.col("lo")) & (F.col("gs") > F.col("hi")) & (F.col("gs") > peak_min_g)).select("bin", F.col("r").alias("peak"))
    peaks = peaks.withColumn("shell", (F.row_number().over(by) - 1).cast("int")).withColumn("next", F.lead("peak").over(by))
    between = peaks.filter("next is not null").join(F.broadcast(own.select("r", "gs")), (F.col("r") >= F.col("peak")) & (F.col("r") <= F.col("next")))
    low = between.groupBy("shell").agg(F.count("*").alias("places"), F.min(F.struct("gs", "r")).alias("m"), F.first(0.5 * (F.col("peak") + F.col("next"))).alias("middle")).select("shell", F.when(F.col("places") < 3, F.col("middle")).otherwise(F.col("m.r")).alias("outer"))
    end = own.agg(F.max("r").alias("last"))
    shells = peaks.join(low, "shell", "left").crossJoin(F.broadcast(end)).select("shell", "peak", F.coalesce("outer", "last").alias("outer"))
    shells = shells.withColumn("inner", F.coalesce(F.lag("outer").over(W.orderBy("shell")), F.lit(0.0)))
    if "n" not in curve.columns:
        return shells.select("shell", "peak", "inner", "outer")
    steps = curve.withColumn("r2", F.lead("r").over(by)).withColumn("n2", F.lead("n").over(by))
    here = (F.col("outer") >= F.col("r")) & ((F.col("outer") < F.col("r2")) | F.col("r2").isNull())
    inside = shells.join(F.broadcast(steps.select("r", "n", "r2", "n2")), here)
    return inside.withColumn("cn", F.when(F.col("r2").isNull() | (F.col("outer") == F.col("r")), F.col("n")).otherwise(F.col("n") + (F.col("n2") - F.col("n")) * (F.col("outer") - F.col("r")) / (F.col("r2") - F.col("r")))).select("shell", "peak", "inner", "outer", "cn")


def pairs_at_distance(centers: DataFrame, targets: DataFrame, frames: DataFrame, r_min: float, r_max: float, *, same: bool = False, stride: int = 1, box: G.Box = G.BOX) -> DataFrame:
    """frame_id, center, target, d with r_min <= d <= r_max; same says that both are one selection, whose pairs count once."""
    at = frames if stride == 1 else frames.filter(F.col(FRAME) % stride == 0)
    near = pairs(centers, targets, at, box=box, carry=(), cutoff=r_max).filter(F.col("d") >= r_min)
    if same:
        near = near.filter("a_idx < b_idx")
    return near.select(FRAME, F.col("a_idx").alias("center"), F.col("b_idx").alias("target"), "d")


def environments(hits: DataFrame, atoms: DataFrame, topo: DataFrame, targets: DataFrame, frames: DataFrame, shells: DataFrame, *, n_each: int = 3, cumulative: bool = False, max_neighbors: int | None = None, box: G.Box = G.BOX) -> DataFrame:
    """shell, cluster, frame_id, center, atom_idx, element, x, y, z, is_center: the surroundings of the first hits of each shell.

    hits: shell, frame_id, center, target. The first hit of each frame counts, n_each frames a shell. A cluster holds the centre's molecule and
    the molecules whose nearest target atom lies in the shell (in all up to it, if cumulative), the nearest max_neighbors if given, as
    nearest images around the centre.
    """
    first = W.partitionBy("shell", FRAME).orderBy("center", "target")
    order = W.partitionBy("shell").orderBy(FRAME)
    chosen = hits.withColumn("k", F.row_number().over(first)).filter("k = 1").withColumn("cluster", F.row_number().over(order) - 1).filter(F.col("cluster") < n_each).select("shell", "cluster", FRAME, "center")
    where = atoms.join(topo, [FRAME, "atom_idx"])
    center = chosen.join(where.select(FRAME, F.col("atom_idx").alias("center"), F.col("mol_id").alias("own"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("z").alias("a_z")), [FRAME, "center"]).join(frames.select(FRAME, *box.columns), FRAME)
    around = center.join(where.select(FRAME, "atom_idx", "element", "mol_id", F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("z").alias("b_z")), FRAME)
    dx, dy, dz = box.mic(G.minus(G.vector("b_"), G.vector("a_")))
    around = around.withColumns({"dx": dx, "dy": dy, "dz": dz}).withColumn("d", G.norm((F.col("dx"), F.col("dy"), F.col("dz"))))
    marked = around.join(targets.select(FRAME, "atom_idx", F.lit(True).alias("is_target")), [FRAME, "atom_idx"], "left")
    mol = ["shell", "cluster", "mol_id"]
    nearest = marked.filter("is_target and mol_id >= 0 and mol_id <> own").groupBy(*mol).agg(F.min("d").alias("nearest"))
    borders = F.broadcast(shells.select(F.col("shell").alias("in_shell"), "inner", "outer"))
    inside = (F.col("nearest") >= F.col("inner")) & (F.col("nearest") < F.col("outer"))
    placed = nearest.join(borders, inside).filter(F.col("in_shell") <= F.col("shell") if cumulative else F.col("in_shell") == F.col("shell"))
    if max_neighbors is not None:
        placed = placed.withColumn("k", F.row_number().over(W.partitionBy("shell", "cluster").orderBy("nearest", "mol_id"))).filter(F.col("k") <= max_neighbors)
    kept = marked.join(placed.select(*mol, F.lit(True).alias("near")), mol, "left").filter(F.col("near") | (F.col("mol_id") == F.col("own")))
    return kept.select("shell", "cluster", FRAME, "center", "atom_idx", "element", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), (F.col("atom_idx") == F.col("center")).alias("is_center"))


def peak_environments(centers: DataFrame, targets: DataFrame, atoms: DataFrame, topo: DataFrame, frames: DataFrame, curve: DataFrame, *, n_per_peak: int = 3, peak_dr: float = 0.12, stride: int = 20, same: bool = False, peak_min_g: float = 0.5, smooth_sigma: float = 0.0, cumulative: bool = False, max_neighbors: int | None = None, box: G.Box = G.BOX) -> DataFrame:
    """environments around pairs at each peak's distance, give or take peak_dr."""
    shells = rdf_shells(curve, peak_min_g=peak_min_g, smooth_sigma=smooth_sigma)
    return _around(shells, F.col("peak") - peak_dr, F.col("peak") + peak_dr, centers, targets, atoms, topo, frames, n_per_peak, stride, same, cumulative, max_neighbors, box)


def shell_environments(centers: DataFrame, targets: DataFrame, atoms: DataFrame, topo: DataFrame, frames: DataFrame, curve: DataFrame, *, n_per_shell: int = 3, stride: int = 20, same: bool = False, peak_min_g: float = 0.5, smooth_sigma: float = 0.0, cumulative: bool = False, max_neighbors: int | None = None, box: G.Box = G.BOX) -> DataFrame:
    """environments around pairs whose distance lies in each shell, borders included."""
    shells = rdf_shells(curve, peak_min_g=peak_min_g, smooth_sigma=smooth_sigma)
    return _around(shells, F.col("inner"), F.col("outer"), centers, targets, atoms, topo, frames, n_per_shell, stride, same, cumulative, max_neighbors, box)


def _around(shells, low, high, centers, targets, atoms, topo, frames, n_each, stride, same, cumulative, max_neighbors, box) -> DataFrame:
    at = frames.filter(F.col(FRAME) % stride == 0)
    near = pairs(centers, targets, at, box=box, carry=())
    near = near.filter("a_idx < b_idx" if same else "true")
    wanted = F.broadcast(shells.select("shell", low.alias("low"), high.alias("high")))
    hits = near.join(wanted, F.col("d").between(F.col("low"), F.col("high"))).select("shell", FRAME, F.col("a_idx").alias("center"), F.col("b_idx").alias("target"))
    return environments(hits, atoms, topo, targets, frames, shells, n_each=n_each, cumulative=cumulative, max_neighbors=max_neighbors, box=box)


def angles(atoms: DataFrame, topo: DataFrame, frames: DataFrame, center: str = "O", neighbors: str = "H", *, mols: DataFrame | None = None, formula: str | None = None, box: G.Box = G.BOX) -> DataFrame:
    """frame_id, center, j, k, angle: of all pairs j < k of neighbours in the centre's molecule."""
    own = atoms.join(topo, [FRAME, "atom_idx"])
    if formula is not None and mols is not None:
        own = own.join(mols.filter(F.col("formula") == formula).select(FRAME, "mol_id"), [FRAME, "mol_id"], "left_semi")
    key = [FRAME, "mol_id"]
    c = own.filter(F.col("element") == center).select(*key, F.col("atom_idx").alias("center"), *[F.col(a).alias(f"c_{a}") for a in "xyz"])
    n = own.filter(F.col("element") == neighbors)

    def side(p: str) -> DataFrame:
        return n.select(*key, F.col("atom_idx").alias(p), *[F.col(a).alias(f"{p}_{a}") for a in "xyz"])

    three = c.join(side("j"), key).join(side("k"), key).filter("j < k").join(frames.select(FRAME, *box.columns), FRAME)
    a, b = box.mic(G.minus(G.vector("j_"), G.vector("c_"))), box.mic(G.minus(G.vector("k_"), G.vector("c_")))
    return three.select(FRAME, "center", "j", "k", G.angle(a, b).alias("angle"))


def adf(found: DataFrame, bins: int = 90, low: float = 80.0, high: float = 140.0) -> DataFrame:
    """bin, angle (middle), density of the angles in range; no rows if there are none."""
    counts = found.select(G.bin_of(F.col("angle"), low, high, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    width = (high - low) / bins
    spine = found.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").crossJoin(F.broadcast(total)).filter("total is not null").select("bin", (low + (F.col("bin") + 0.5) * width).alias("angle"), (F.coalesce("c", F.lit(0)) / (F.col("total") * width)).alias("density"))


def tetrahedral_order(atoms: DataFrame, frames: DataFrame, element: str = "O", n_neighbors: int = 4, rcut: float = 3.7, *, box: G.Box = G.BOX) -> DataFrame:
    """frame_id, q: the mean over atoms whose n-th neighbour of the same element is within rcut; null if none has one."""
    own = atoms.filter(F.col("element") == element)
    # an atom counts if its n nearest lie within rcut, so farther ones need not be looked at
    near = pairs(own, own, frames, box=box, carry=(), cutoff=rcut).filter("a_idx <> b_idx")
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy(FRAME, "a_idx").orderBy("d", "b_idx"))).filter(F.col("k") <= n_neighbors)
    each = ranked.groupBy(FRAME, "a_idx").agg(F.sort_array(F.collect_list(F.struct("k", "dx", "dy", "dz", "d"))).alias("v"), F.max("d").alias("far")).filter((F.size("v") == n_neighbors) & (F.col("far") <= rcut))
    terms = []
    for i in range(n_neighbors):
        for j in range(i + 1, n_neighbors):
            a, b = F.col("v")[i], F.col("v")[j]
            cos = (a["dx"] * b["dx"] + a["dy"] * b["dy"] + a["dz"] * b["dz"]) / (a["d"] * b["d"])
            terms.append((cos + 1.0 / 3.0) * (cos + 1.0 / 3.0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    q = each.select(FRAME, (1.0 - 0.375 * total).alias("q")).groupBy(FRAME).agg(F.avg("q").alias("q"))
    return frames.select(FRAME).join(q, FRAME, "left")


def hbonds(atoms: DataFrame, topo: DataFrame, frames: DataFrame, r_ha: float = 2.4, *, box: G.Box = G.BOX) -> DataFrame:
    """frame_id, donor, h, acceptor: the donor is the first O of the H's molecule, acceptors are other O nearer than r_ha."""
    donors = atoms.filter("element = 'O'").join(topo, [FRAME, "atom_idx"]).groupBy(FRAME, "mol_id").agg(F.min("atom_idx").alias("donor"))
    h = atoms.filter("element = 'H'").join(topo, [FRAME, "atom_idx"]).join(donors, [FRAME, "mol_id"])
    near = pairs(h, atoms.filter("element = 'O'").withColumn("donor", F.lit(None).cast("int")), frames, box=box, carry=("donor",), cutoff=r_ha)
    return near.filter((F.col("d") < r_ha) & (F.col("a_donor") != F.col("b_idx"))).select(FRAME, F.col("a_donor").alias("donor"), F.col("a_idx").alias("h"), F.col("b_idx").alias("acceptor"))


def hbond_count(found: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id, n of all frames."""
    return frames.select(FRAME).join(found.groupBy(FRAME).agg(F.count("*").alias("n")), FRAME, "left").select(FRAME, F.coalesce("n", F.lit(0)).alias("n"))


# -- spatial densities

#: Projections, whether a second atom fixes the turn about the bond, and the axes that mirror onto their positive half.
SYMMETRIES: dict[str, tuple[Sequence[str], bool, str]] = {
    "Cinfv": (("cylindrical", "spherical"), False, ""),
    "Dinfh": (("cylindrical", "spherical"), False, "z"),
    "C2v": (("xz", "yz", "cylindrical"), True, "xy"),
    "C3v": (("xz", "cylindrical"), True, "x"),
    "Cs": (("xz", "yz", "xy"), True, "y"),
    "C1": (("xz", "yz", "xy"), True, ""),
    "Td": (("spherical",), True, ""),
    "Oh": (("spherical",), True, ""),
}


def aligned(centers: DataFrame, align: DataFrame, targets: DataFrame, topo: DataFrame, frames: DataFrame, *, second: DataFrame | None = None, half_space: str | None = None, offset: float = 0.0, folds: str = "", weight: str | None = None, box: G.Box = G.BOX) -> tuple[DataFrame, DataFrame]:
    """Targets around each centre, turned so that the bond from the centre to the first align atom of its molecule points along +z.

    Returns (frame_id, center, x, y, z, w) and one row (n_center, mean_bond_len). second: atoms of which the first in the molecule,
    other than the align atom, is turned to phi = 0. half_space: '+x' and so on, beyond the offset. folds: axes to mirror.
    """
    key = [FRAME, "mol_id"]
    size = frames.select(FRAME, *box.columns)

    def first_of(df: DataFrame, p: str) -> DataFrame:
        own = df.join(topo, [FRAME, "atom_idx"]).groupBy(*key).agg(F.min(F.struct("atom_idx", "x", "y", "z")).alias("m"))
        return own.select(*key, F.col("m.atom_idx").alias(f"{p}idx"), *[F.col(f"m.{a}").alias(f"{p}{a}") for a in "xyz"])

    c = centers.join(topo, [FRAME, "atom_idx"]).select(*key, F.col("atom_idx").alias("center"), *[F.col(a).alias(f"c_{a}") for a in "xyz"])
    own = c.join(first_of(align, "l_"), key).join(size, FRAME)
    b = box.mic(G.minus(G.vector("l_"), G.vector("c_")))
    own = G.once(own, {"b_x": b[0], "b_y": b[1], "b_z": b[2]})
    if second is not None:
        s = second.join(topo, [FRAME, "atom_idx"]).select(*key, F.col("atom_idx").alias("s_idx"), *[F.col(a).alias(f"s_{a}") for a in "xyz"])
        pick = own.select(*key, "center", "l_idx").join(s, key).filter("s_idx <> l_idx").groupBy(*key, "center").agg(F.min(F.struct("s_idx", "s_x", "s_y", "s_z")).alias("s"))
        own = own.join(pick, [*key, "center"], "left")
        sd = box.mic((F.col("s.s_x") - F.col("c_x"), F.col("s.s_y") - F.col("c_y"), F.col("s.s_z") - F.col("c_z")))
        turned = G.onto_z(G.vector("b_"), sd)
        own = own.withColumn("phi", F.coalesce(F.atan2(turned[1], turned[0]), F.lit(0.0))).drop("s")
    else:
        own = own.withColumn("phi", F.lit(0.0))
    with_targets = own.join(targets.select(FRAME).distinct(), FRAME, "left_semi")
    meta = with_targets.agg(F.count("*").alias("n_center"), F.coalesce(F.avg(G.norm(G.vector("b_"))), F.lit(0.0)).alias("mean_bond_len"))
    t = targets.select(FRAME, F.col("atom_idx").alias("t_idx"), *[F.col(a).alias(f"t_{a}") for a in "xyz"], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    both = own.join(t, FRAME).filter("t_idx <> center and t_idx <> l_idx")
    both = G.once(both, dict(zip(("m_x", "m_y", "m_z"), box.mic(G.minus(G.vector("t_"), G.vector("c_"))))))
    both = G.once(both, dict(zip(("x0", "y0", "z0"), G.onto_z(G.vector("b_"), G.vector("m_")))))
    if second is not None:
        both = G.once(both, dict(zip(("x0", "y0", "z0"), G.about_z((F.col("x0"), F.col("y0"), F.col("z0")), F.col("phi")))))
    both = both.select(FRAME, "center", *[F.col(f"{a}0").alias(a) for a in "xyz"], "w")
    if half_space is not None:
        axis = F.col(half_space[-1])
        both = both.filter(axis < -offset if half_space[0] == "-" else axis > offset)
    for a in folds:
        both = both.withColumn(a, F.abs(F.col(a)))
    return both, meta


def project(points: DataFrame, projection: str, *, rmax: float = 5.0, bins: int = 150, folds: str = "") -> DataFrame:
    """b0, b1, w: sums of weights in cells of a plane (two axes), of the cylinder (z, distance from the axis) or of the sphere (r, theta)."""
    low = {a: 0.0 if a in folds else -rmax for a in "xyz"}
    if projection in ("xz", "yz", "xy"):
        a, b = projection
        cells = G.bin_of(F.col(a), low[a], rmax, bins), G.bin_of(F.col(b), low[b], rmax, bins)
    elif projection == "cylindrical":
        cells = G.bin_of(F.col("z"), low["z"], rmax, bins), G.bin_of(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 0.0, rmax, bins)
    elif projection == "spherical":
        r = G.norm(G.vector(""))
        theta = F.when(r < 1e-10, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / r))))
        cells = G.bin_of(r, 0.0, rmax, bins), G.bin_of(theta, 0.0, math.pi / 2 if "z" in folds else math.pi, bins)
    else:
        raise ValueError(f"not a projection: {projection!r}")
    return points.select(cells[0].alias("b0"), cells[1].alias("b1"), "w").filter("b0 is not null and b1 is not null").groupBy("b0", "b1").agg(F.sum("w").alias("w"))


def spatial_density(centers: DataFrame, align: DataFrame, targets: DataFrame, topo: DataFrame, frames: DataFrame, projection: str = "xz", *, rmax: float = 5.0, bins: int = 150, stride: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """b0, b1, w and one row of meta for one projection."""
    at = frames if stride == 1 else frames.filter(F.col(FRAME) % stride == 0)
    points, meta = aligned(centers, align, targets, topo, at, **options)
    return project(points, projection, rmax=rmax, bins=bins), meta


def spatial_densities(centers: DataFrame, align: DataFrame, targets: DataFrame, topo: DataFrame, frames: DataFrame, symmetry: str, *, second: DataFrame | None = None, rmax: float = 5.0, bins: int = 150, stride: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """projection, b0, b1, w for all projections of a point group, with its mirrors, and one row of meta."""
    if symmetry not in SYMMETRIES:
        raise ValueError(f"not a symmetry: {symmetry!r}")
    projections, needs, folds = SYMMETRIES[symmetry]
    if needs and second is None:
        raise ValueError(f"{symmetry} needs a second atom")
    at = frames if stride == 1 else frames.filter(F.col(FRAME) % stride == 0)
    points, meta = aligned(centers, align, targets, topo, at, second=second if needs else None, folds=folds, **options)
    out = None
    for p in projections:
        part = project(points, p, rmax=rmax, bins=bins, folds=folds).select(F.lit(p).alias("projection"), "b0", "b1", "w")
        out = part if out is None else out.unionByName(part)
    return out, meta


def density_normalized(cells: DataFrame, projection: str, n_center: int, *, rmax: float = 5.0, bins: int = 150, folds: str = "", mode: str = "density") -> DataFrame:
    """cells with w per centre and per area or volume of the cell, or with mode 'max' divided by the largest."""
    if mode == "max":
        top = F.max("w").over(W.partitionBy())
        return cells.withColumn("w", F.col("w") / F.when(top > 0, top).otherwise(1.0))
    low0 = 0.0 if projection == "spherical" or (projection in ("cylindrical",) and "z" in folds) or (len(projection) == 2 and projection[0] in folds) else -rmax
    w0 = (rmax - low0) / bins
    if projection == "cylindrical":
        w1 = rmax / bins
        measure = 2.0 * math.pi * ((F.col("b1") + 0.5) * w1) * w1 * w0
    elif projection == "spherical":
        w1 = (math.pi / 2 if "z" in folds else math.pi) / bins
        r, theta = (F.col("b0") + 0.5) * w0, (F.col("b1") + 0.5) * w1
        measure = 2.0 * math.pi * r * r * F.greatest(F.abs(F.sin(theta)), F.lit(1e-6)) * w0 * w1
    else:
        w1 = (rmax - (0.0 if projection[1] in folds else -rmax)) / bins
        measure = F.lit(w0 * w1)
    return cells.withColumn("w", F.col("w") / (float(max(n_center, 1)) * measure))


def molecule_overlay(center: str, align: str, bond_len: float, projection: str = "xz") -> dict:
    """Two atoms in the aligned frame, for drawing over a density."""
    return {"symbols": [center, align], "positions": [(0.0, 0.0, 0.0), (0.0, 0.0, bond_len)], "projection": projection}


def principal_projection(clusters: DataFrame, group: list[str]) -> DataFrame:
    """group, atom_idx, u, v: each cluster on its two main axes, by singular values; a cluster fits one task. Signs are such that each axis' largest coordinate is positive."""
    import numpy as np
    import pandas as pd

    def one(key, pdf):
        p = pdf[["x", "y", "z"]].to_numpy(dtype=float)
        p = p - p.mean(0)
        axes = np.linalg.svd(p, full_matrices=False)[2][:2]
        uv = np.zeros((len(p), 2))
        uv[:, : len(axes)] = p @ axes.T
        for k in range(2):
            if len(uv) and uv[np.abs(uv[:, k]).argmax(), k] < 0:
                uv[:, k] *= -1
        return pd.DataFrame({**dict(zip(group, key)), "atom_idx": pdf["atom_idx"], "u": uv[:, 0], "v": uv[:, 1]})

    kinds = ", ".join(f"{g} {clusters.schema[g].dataType.simpleString()}" for g in group)
    return clusters.groupBy(*group).applyInPandas(one, f"{kinds}, atom_idx int, u double, v double")
