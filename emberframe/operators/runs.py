"""Runs, segments, states and transitions over frames, as windows.

Everything here partitions by one entity (a formula, an atom, a bond) and orders by time; the windows of one operator share that
partitioning, so they cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.operators.perception import pairs
from emberframe.operators.selectors import FRAME


def lifetime_segments(mols: DataFrame) -> DataFrame:
    """formula, segment (from 0), start, stop: maximal runs of frames with the formula; stop is exclusive."""
    seen = mols.select("formula", FRAME).distinct()
    by = W.partitionBy("formula").orderBy(FRAME)
    runs = seen.withColumn("g", F.col(FRAME) - F.row_number().over(by)).groupBy("formula", "g").agg(F.min(FRAME).alias("start"), (F.max(FRAME) + 1).alias("stop"))
    return runs.withColumn("segment", (F.row_number().over(W.partitionBy("formula").orderBy("start")) - 1).cast("int")).select("formula", "segment", "start", "stop")


def presence_fraction(segments: DataFrame, n_frames: int) -> DataFrame:
    """formula, fraction of frames with it."""
    return segments.groupBy("formula").agg((F.sum(F.col("stop") - F.col("start")) / F.lit(float(n_frames))).alias("fraction"))


def segment(segments: DataFrame, formula: str, number: int) -> tuple[int, int]:
    """start and stop of one segment; a negative number counts from the end."""
    own = segments.filter(F.col("formula") == formula)
    n = own.count()
    if n == 0:
        raise ValueError(f"no frame has {formula}")
    if not -n <= number < n:
        raise IndexError(f"{formula} has {n} segments")
    row = own.filter(F.col("segment") == number % n).first()
    return row["start"], row["stop"]


def segment_frames(frames: DataFrame, segments: DataFrame, formula: str, number: int, *, missing: str = "error") -> DataFrame:
    """The frames of one segment; where there is no such segment an error, or with missing="empty" no frames."""
    if missing not in ("error", "empty"):
        raise ValueError(f"neither error nor empty: {missing!r}")
    try:
        start, stop = segment(segments, formula, number)
    except (ValueError, IndexError):
        if missing == "error":
            raise
        return frames.limit(0)
    return frames.filter((F.col(FRAME) >= start) & (F.col(FRAME) < stop))


def reaction_windows(segments: DataFrame, n_frames: int, buffer: int = 10, event: str = "birth") -> DataFrame:
    """formula, segment, boundary, first, stop: frames around each segment's birth or death (or both)."""
    if event not in ("birth", "death", "both"):
        raise ValueError(f"not an event: {event!r}")
    first = F.col("stop") if event == "death" else F.col("start")
    last = F.col("start") if event == "birth" else F.col("stop")
    return segments.select("formula", "segment", first.alias("boundary"), F.greatest(F.lit(0), first - buffer).alias("first"), F.least(F.lit(n_frames), last + buffer).alias("stop"))


def reaction_kinetics(segments: DataFrame, n_frames: int, dt: float = 1.0, formulas: list[str] | None = None) -> DataFrame:
    """formula, n_events, mean_lifetime, median_lifetime, rate, of all formulas seen or of those named; one never seen has 0 events, rate 0 and lifetimes NaN."""
    life = (F.col("stop") - F.col("start")) * dt
    found = segments.groupBy("formula").agg(F.count("*").alias("n_events"), F.avg(life).alias("mean_lifetime"), F.median(life).alias("median_lifetime"), (F.count("*") / F.lit(n_frames * dt)).alias("rate"))
    if formulas is None:
        return found
    named = segments.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(formulas)], "formula string").join(found, "formula", "left")
    return named.select("formula", F.coalesce("n_events", F.lit(0)).alias("n_events"), *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("mean_lifetime", "median_lifetime")], F.coalesce("rate", F.lit(0.0)).alias("rate"))


def track(states: DataFrame, persistence: int = 1, *, entity: str = "entity", time: str = "t", state: str = "state") -> tuple[DataFrame, DataFrame]:
    """Transitions (entity, t, from_state, to_state) and residences (entity, residence) of a state per entity and time.

    The first state counts at once, another one after persistence times in a row; the transition is then. So kept runs are the first and
    those long enough, and a transition is where a kept run's state differs from the kept run's before. residence counts the times since
    the last transition, or the beginning, whose state is the current one. States may be null.
    """
    marked = states.select(F.col(entity).alias("entity"), F.col(time).alias("t"), F.col(state).alias("state"))
    by = W.partitionBy("entity").orderBy("t")
    first = F.row_number().over(by) == 1
    marked = marked.withColumn("n", F.row_number().over(by)).withColumn("new", F.when(first | ~F.col("state").eqNullSafe(F.lag("state").over(by)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    in_run = W.partitionBy("entity", "run").orderBy("t")
    marked = marked.withColumn("place", F.row_number().over(in_run)).withColumn("len", F.count("*").over(W.partitionBy("entity", "run")))
    kept = marked.filter((F.col("run") == 1) | (F.col("len") >= persistence)).filter((F.col("place") == F.when(F.col("run") == 1, 1).otherwise(persistence)))
    order = W.partitionBy("entity").orderBy("run")
    moves = kept.withColumn("before", F.lag(F.struct("state")).over(order)).filter(F.col("before").isNotNull() & ~F.col("before.state").eqNullSafe(F.col("state")))
    transitions = moves.select("entity", "t", F.col("before.state").alias("from_state"), F.col("state").alias("to_state"))
    start = marked.filter("n = 1").select("entity", F.col("t").alias("since"), F.col("state").alias("committed"))
    last = transitions.groupBy("entity").agg(F.max(F.struct("t", "to_state")).alias("m"))
    current = start.join(last, "entity", "left").select("entity", F.coalesce("m.t", "since").alias("since"), F.when(F.col("m").isNotNull(), F.col("m.to_state")).otherwise(F.col("committed")).alias("committed"))
    stays = marked.join(current, "entity").groupBy("entity").agg(F.sum(((F.col("t") > F.col("since")) & F.col("state").eqNullSafe(F.col("committed"))).cast("int")).cast("long").alias("residence"))
    return transitions, stays


def changes(states: DataFrame, *, entity: str = "entity", time: str = "t", state: str = "state") -> DataFrame:
    """entity, t, from_state, to_state wherever an entity's state differs from the one last seen; times without a row are skipped."""
    by = W.partitionBy(entity).orderBy(time)
    seen = states.withColumn("_before", F.lag(F.struct(F.col(state).alias("s"))).over(by)).filter(F.col("_before").isNotNull() & ~F.col("_before.s").eqNullSafe(F.col(state)))
    return seen.select(F.col(entity).alias("entity"), F.col(time).alias("t"), F.col("_before.s").alias("from_state"), F.col(state).alias("to_state"))


def last_stays(states: DataFrame, *, entity: str = "entity", time: str = "t", state: str = "state") -> DataFrame:
    """entity, residence: length of the last run of one state, in times seen."""
    by = W.partitionBy("entity").orderBy("t")
    own = states.select(F.col(entity).alias("entity"), F.col(time).alias("t"), F.col(state).alias("state"))
    own = own.withColumn("new", F.when(F.col("state").eqNullSafe(F.lag("state").over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return own.groupBy("entity", "run").agg(F.count("*").alias("residence")).groupBy("entity").agg(F.max(F.struct("run", "residence")).alias("m")).select("entity", F.col("m.residence").alias("residence"))


def ligand_exchange(mols: DataFrame, formulas: list[str] | None = None) -> DataFrame:
    """changes of the formula of each molecule number (which need not be one molecule for long); formulas restrict the frames in which it counts."""
    own = mols if formulas is None else mols.filter(F.col("formula").isin(formulas))
    return changes(own, entity="mol_id", time=FRAME, state="formula")


def coordination_states(atoms: DataFrame, topo: DataFrame, element: str = "O") -> DataFrame:
    """entity, t, state: the sorted elements of each such atom's molecule."""
    with_mol = atoms.select(FRAME, "atom_idx", "element").join(topo, [FRAME, "atom_idx"])
    kind = with_mol.groupBy(FRAME, "mol_id").agg(F.array_join(F.array_sort(F.collect_list("element")), ",").alias("state"))
    return with_mol.filter(F.col("element") == element).join(kind, [FRAME, "mol_id"]).select(F.col("atom_idx").alias("entity"), F.col(FRAME).alias("t"), "state")


def coordination_dynamics(atoms: DataFrame, topo: DataFrame, element: str = "O") -> DataFrame:
    return changes(coordination_states(atoms, topo, element))


def nearest_host(tracked: DataFrame, hosts: DataFrame, frames: DataFrame, cutoff: float, *, box: G.Box = G.BOX) -> DataFrame:
    """entity, t, state: the nearest host of each tracked atom below the cutoff, else null; ties go to the smallest index."""
    near = pairs(tracked, hosts, frames, box=box, carry=(), cutoff=cutoff).filter((F.col("a_idx") != F.col("b_idx")) & (F.col("d") < cutoff))
    best = near.groupBy(FRAME, F.col("a_idx").alias("atom_idx")).agg(F.min(F.struct("d", "b_idx")).alias("m")).select(FRAME, "atom_idx", F.col("m.b_idx").alias("state"))
    return tracked.select(FRAME, "atom_idx").join(best, [FRAME, "atom_idx"], "left").select(F.col("atom_idx").alias("entity"), F.col(FRAME).alias("t"), "state")


def atom_hop(atoms: DataFrame, frames: DataFrame, tracked: str = "H", host: str = "O", cutoff: float = 1.25, persistence: int = 1, *, box: G.Box = G.BOX) -> tuple[DataFrame, DataFrame]:
    """Transitions of tracked atoms between hosts, and residences. Atoms are those tracked in the first frame."""
    first = atoms.agg(F.min(FRAME).alias("first"))
    known = atoms.join(F.broadcast(first), F.col(FRAME) == F.col("first")).filter(F.col("element") == tracked).select("atom_idx")
    own = atoms.filter(F.col("element") == tracked).join(known, "atom_idx")
    return track(nearest_host(own, atoms.filter(F.col("element") == host), frames, cutoff, box=box), persistence)


def hop_species_distances(hops: DataFrame, atoms: DataFrame, mols: DataFrame, frames: DataFrame, formula: str = "HO", reference: str = "from", *, box: G.Box = G.BOX) -> DataFrame:
    """entity, t, distance: of each hop's site (its atom, or the host it left or reached) to the nearest centre of a molecule with the formula. Hops without such a molecule or host are left out."""
    site = {"H": "entity", "from": "from_state", "to": "to_state"}.get(reference)
    if site is None:
        raise ValueError(f"not a reference: {reference!r}")
    at = hops.filter(F.col(site).isNotNull()).select("entity", F.col("t").alias(FRAME), F.col(site).cast("int").alias("atom_idx")).join(atoms.select(FRAME, "atom_idx", "x", "y", "z"), [FRAME, "atom_idx"])
    both = at.join(mols.filter(F.col("formula") == formula).select(FRAME, "cx", "cy", "cz"), FRAME).join(frames.select(FRAME, *box.columns), FRAME)
    d = G.norm(box.mic(G.minus((F.col("cx"), F.col("cy"), F.col("cz")), (F.col("x"), F.col("y"), F.col("z")))))
    return both.withColumn("d", d).groupBy("entity", FRAME).agg(F.min("d").alias("distance")).withColumnRenamed(FRAME, "t")


def bond_events(bonds: DataFrame, frames: DataFrame, atoms: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """frame_id, event (formed or broken), i, j: changes from one sampled frame to the next, at the later one. With atoms, the elements of both."""
    # frames are numbered without gaps, so the sampled frame before or after is stride away
    at = frames.select(FRAME).filter(F.col(FRAME) % stride == 0)
    own = bonds.select(FRAME, "i", "j").join(at, FRAME, "left_semi").withColumn("before", F.col(FRAME) - stride).withColumn("next", F.col(FRAME) + stride)
    formed = own.join(at.select(F.col(FRAME).alias("before")), "before", "left_semi").join(bonds.select(F.col(FRAME).alias("before"), "i", "j"), ["before", "i", "j"], "left_anti").select(FRAME, F.lit("formed").alias("event"), "i", "j")
    broken = own.join(at.select(F.col(FRAME).alias("next")), "next", "left_semi").join(bonds.select(F.col(FRAME).alias("next"), "i", "j"), ["next", "i", "j"], "left_anti").select(F.col("next").alias(FRAME), F.lit("broken").alias("event"), "i", "j")
    out = formed.unionByName(broken)
    if atoms is None:
        return out
    kind = atoms.select(FRAME, F.col("atom_idx"), "element")
    return out.join(kind.select(FRAME, F.col("atom_idx").alias("i"), F.col("element").alias("element_i")), [FRAME, "i"]).join(kind.select(FRAME, F.col("atom_idx").alias("j"), F.col("element").alias("element_j")), [FRAME, "j"])


def hop_involvement(hops: DataFrame, k: int) -> DataFrame:
    """The k hosts that give or take most hops: host, n; ties by host."""
    both = hops.select(F.col("from_state").alias("host")).union(hops.select("to_state")).filter("host is not null")
    return both.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(k)


def hop_rate(hops: DataFrame, width: int) -> DataFrame:
    """bin, n: transitions per window of frames."""
    return hops.groupBy(F.floor(F.col("t") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))

