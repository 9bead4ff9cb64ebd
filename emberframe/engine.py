"""Trajectory: the tables of one trajectory and the operators on them, under one name."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.operators import correlation, distributions, perception, runs, selectors, tracks
from emberframe.operators.selectors import FRAME
from emberframe.sources import trajectory as sources


class Trajectory:
    """frames (frame_id and lx, ly, lz or cell) and atoms (frame_id, atom_idx, element, x, y, z), with topo given or perceived. Everything is lazy; box, if not given, is what the frames' cells need."""

    def __init__(self, frames: DataFrame, atoms: DataFrame, topo: DataFrame | None = None, *, mode: str = "molecular", covalent_scale: float = 1.0, coordination_scale: float = 1.3, sphere_cutoffs: dict | None = None, persistence: int = 1, max_frames: int | None = None, box: G.Box | None = None):
        self.frames, self.atoms = selectors.truncated(frames, max_frames), selectors.truncated(atoms, max_frames)
        self.given, self.mode, self.scales, self.persistence, self._box = topo, mode, (covalent_scale, coordination_scale), persistence, box
        self.cutoffs = selectors.parse_cutoffs(sphere_cutoffs) if sphere_cutoffs else None

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options) -> Trajectory:
        """Extended-XYZ files, or a folder of saved tables."""
        if path.endswith((".traj", ".h5", ".hdf5", ".nc", ".dcd", ".cif", ".pdb", ".vasp")):
            raise ValueError(f"not a format that is read here: {path!r}; write extended XYZ, or Parquet tables frames and atoms")
        if path.endswith(".xyz"):
            return cls(*sources.read_xyz(spark, path, options.get("max_frames")), **options)
        found = {name: spark.read.parquet(f"{path}/{name}") for name in ("frames", "atoms")}
        return cls(found["frames"], found["atoms"], **options)

    @classmethod
    def build(cls, spark: SparkSession, path: str, cache: str, **options) -> Trajectory:
        """read, perceived once: tables are saved below the cache under a key of path and options, and taken from there if present."""
        key = sources.cache_key(path, options.get("mode", "molecular"), options.get("covalent_scale", 1.0), options.get("coordination_scale", 1.3), options.get("max_frames"), selectors.parse_cutoffs(options.get("sphere_cutoffs") or {}), options.get("persistence", 1))
        try:
            found = sources.load(spark, cache, key)
        except Exception as e:  # nothing saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            own = cls.read(spark, path, **options)
            sources.save({"frames": own.frames, "atoms": own.atoms, "topo": own.topo, "mols": own.mols}, cache, key)
            found = sources.load(spark, cache, key)
        return cls(found["frames"], found["atoms"], found["topo"], **options)

    @cached_property
    def box(self) -> G.Box:
        return self._box or G.cell_of(self.frames)

    @cached_property
    def n_frames(self) -> int:
        return self.frames.count()

    @cached_property
    def sphere_cutoffs(self) -> dict[tuple[str, str], float]:
        """As given, else detected on a sample of frames."""
        if self.cutoffs:
            return self.cutoffs
        step = perception.sphere_samples(self.n_frames)
        some = selectors.strided(self.atoms, step)
        centers = [r["element"] for r in selectors.coordination_centers(some).collect()]
        found = perception.detect_sphere_cutoffs(some, selectors.strided(self.frames, step), centers, box=self.box)
        return {(r["center"], r["ligand"]): r["cutoff"] for r in found.collect()}

    @cached_property
    def topo(self) -> DataFrame:
        if self.given is not None:
            return self.given
        if self.mode == "sphere":
            found = perception.build_spheres(self.atoms, self.frames, self.sphere_cutoffs, bond_scale=self.scales[0], box=self.box)
        else:
            found = perception.build_molecules(self.atoms, self.frames, self.mode, bond_scale=self.scales[0], coordination_scale=self.scales[1], box=self.box)
        return perception.persistence_filter(found, self.persistence) if self.persistence > 1 else found

    @cached_property
    def mols(self) -> DataFrame:
        return perception.molecules(self.atoms, self.topo)

    def select(self, what) -> DataFrame:
        return selectors.select(self.atoms, what, self.topo, self.mols)

    def summary(self) -> DataFrame:
        return selectors.summary(self.mols)

    def lifetime_segments(self) -> DataFrame:
        return runs.lifetime_segments(self.mols)

    def segment_frames(self, formula: str, number: int) -> DataFrame:
        """The frames of one segment of a formula; negative numbers count from the last."""
        return runs.segment_frames(self.frames, self.lifetime_segments(), formula, number)

    def reaction_kinetics(self, formulas: list[str] | None = None, dt: float = 1.0) -> DataFrame:
        return runs.reaction_kinetics(self.lifetime_segments(), self.n_frames, dt, formulas)

    def reaction_window(self, formula: str, number: int, buffer: int = 10, event: str = "birth") -> tuple[DataFrame, int]:
        own = self.lifetime_segments().filter(F.col("formula") == formula)
        start, _ = runs.segment(own, formula, number)
        w = runs.reaction_windows(own.filter(F.col("start") == start), self.n_frames, buffer, event).first()
        return self.frames.filter((F.col(FRAME) >= w["first"]) & (F.col(FRAME) < w["stop"])), w["boundary"]

    def rdf(self, center, target, **options) -> DataFrame:
        return distributions.rdf(self.select(center), self.select(target), self.frames, box=self.box, **options)

    def frames_at_distance(self, center, target, r_min: float, r_max: float, stride: int = 1) -> DataFrame:
        return distributions.pairs_at_distance(self.select(center), self.select(target), self.frames, r_min, r_max, same=center == target, stride=stride, box=self.box)

    def rdf_peak_environments(self, center, target, curve: DataFrame, **options) -> DataFrame:
        return distributions.peak_environments(self.select(center), self.select(target), self.atoms, self.topo, self.frames, curve, same=center == target, box=self.box, **options)

    def rdf_shell_environments(self, center, target, curve: DataFrame, **options) -> DataFrame:
        return distributions.shell_environments(self.select(center), self.select(target), self.atoms, self.topo, self.frames, curve, same=center == target, box=self.box, **options)

    def bonds(self) -> DataFrame:
        return perception.bonds(self.atoms, self.frames, scale=self.scales[0], box=self.box)

    def bond_events(self, stride: int = 1) -> DataFrame:
        return runs.bond_events(self.bonds(), self.frames, self.atoms, stride)

    def atom_hop(self, tracked: str = "H", host: str = "O", cutoff: float = 1.25, persistence: int = 1) -> tuple[DataFrame, DataFrame]:
        return runs.atom_hop(self.atoms, self.frames, tracked, host, cutoff, persistence, box=self.box)

    def hop_species_distances(self, hops: DataFrame, formula: str = "HO", reference: str = "from") -> DataFrame:
        return runs.hop_species_distances(hops, self.atoms, self.mols, self.frames, formula, reference, box=self.box)

    def tracks(self, formula: str, **options) -> DataFrame:
        return tracks.greedy_tracks(self.mols, self.lifetime_segments(), self.frames, [formula], box=self.box, **options)

    def msd(self, formula: str, **options) -> DataFrame:
        segments = self.lifetime_segments().filter(F.col("formula") == formula)
        return correlation.msd(self.tracks(formula), segments, keys=("segment", "track"), **options)

    def van_hove(self, formula: str, *, stitch: bool = False, stitch_max_gap: int = 50, stitch_max_jump: float = 4.0, **options) -> DataFrame:
        own = self.tracks(formula)
        if stitch:
            chains, _ = tracks.stitch(own, self.mols, self.lifetime_segments(), self.frames, formula, max_gap=stitch_max_gap, max_jump=stitch_max_jump, box=self.box)
            return correlation.van_hove(chains, keys=("chain",), **options)
        return correlation.van_hove(own, keys=("segment", "track"), **options)

    def hbonds(self, r_ha: float = 2.4) -> DataFrame:
        return distributions.hbonds(self.atoms, self.topo, self.frames, r_ha, box=self.box)

    def extract_segments(self, formula: str, path: str, *, in_vacuum: bool = False, center: bool = False, center_instance: int = 0, center_on: list[int] | None = None) -> DataFrame:
        """Writes each segment of the formula; returns the segments."""
        segments = self.lifetime_segments().filter(F.col("formula") == formula)
        if segments.isEmpty():
            raise ValueError(f"no frame has {formula}")
        self._write(sources.segment_windows(segments, formula), path, in_vacuum, formula if center else None, center_instance, center_on)
        return segments

    def extract_transition(self, formula: str, number: int, path: str, buffer: int = 10, event: str = "birth", *, in_vacuum: bool = False, center: bool = False, center_instance: int = 0, center_on: list[int] | None = None) -> tuple[int, int]:
        """Writes the frames around one segment's birth or death (or both); returns the segment."""
        segments = self.lifetime_segments().filter(F.col("formula") == formula)
        start, stop = runs.segment(segments, formula, number)
        windows = runs.reaction_windows(segments.filter(F.col("start") == start), self.n_frames, buffer, event)
        self._write(sources.transition_windows(windows, event), path, in_vacuum, formula if center else None, center_instance, center_on)
        return start, stop

    def _write(self, windows: DataFrame, path: str, in_vacuum: bool, formula: str | None, instance: int, atoms: list[int] | None) -> None:
        if not in_vacuum and atoms is None:
            return sources.write_windows(self.atoms, windows, path, self.frames)
        if atoms is None and formula is None:
            return sources.write_windows(tracks.vacuum(self.atoms, self.topo, self.frames, box=self.box), windows, path)
        for w in windows.collect():  # a row per segment; each begins its own continuous picture
            inside = (F.col(FRAME) >= w["first"]) & (F.col(FRAME) < w["stop"])
            frames, own, topo = (df.filter(inside) for df in (self.frames, self.atoms, self.topo))
            found = tracks.cluster_around(own, topo, frames, center_atoms=atoms, center_formula=formula, center_instance=instance, mols=self.mols.filter(inside), box=self.box)
            sources.write_windows(found, windows.filter(F.col("name") == w["name"]), f"{path}/{w['name']}")
        return None
