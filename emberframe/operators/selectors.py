"""Selections of atoms and molecules.

A selection is an element symbol, or a dict of one formula to an element or None (any): its first item counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions.elements import COVALENT

FRAME = "frame_id"


def select(atoms: DataFrame, what: str | dict | None, topo: DataFrame | None = None, mols: DataFrame | None = None) -> DataFrame:
    """Atoms of an element, or those of molecules with a formula. atoms may carry mol_id and formula already."""
    if what is None:
        return atoms
    if isinstance(what, str):
        return atoms.filter(F.col("element") == what)
    if not isinstance(what, dict) or not what:
        raise ValueError(f"not a selection: {what!r}")
    formula, element = next(iter(what.items()))
    if "formula" not in atoms.columns:
        if topo is None or mols is None:
            raise ValueError("a formula needs topo and mols")
        own = mols.filter(F.col("formula") == formula).select(FRAME, "mol_id", "formula")
        with_mol = atoms if "mol_id" in atoms.columns else atoms.join(topo, [FRAME, "atom_idx"])
        atoms = with_mol.join(own, [FRAME, "mol_id"])
    found = atoms.filter(F.col("formula") == formula)
    return found if element is None else found.filter(F.col("element") == element)


def molecules(mols: DataFrame) -> DataFrame:
    return mols.select(FRAME, "mol_id")


def by_formula(mols: DataFrame, formulas: list[str] | None = None) -> DataFrame:
    """Molecules in the order of the list: a formula that is listed twice gives its molecules twice. place is the place in the list."""
    if formulas is None:
        return mols.withColumn("place", F.lit(0))
    listed = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(i).alias("i")) for i, f in enumerate(formulas)])
    return mols.filter(F.col("formula").isin(formulas)).withColumn("place", F.explode(F.transform(F.filter(listed, lambda x: x["f"] == F.col("formula")), lambda x: x["i"])))


def molecule_of(atoms: DataFrame, topo: DataFrame) -> DataFrame:
    """frame_id, atom_idx, mol_id of atoms; -1 for one in no molecule."""
    return atoms.select(FRAME, "atom_idx").join(topo, [FRAME, "atom_idx"], "left").withColumn("mol_id", F.coalesce("mol_id", F.lit(-1)))


def strided(df: DataFrame, stride: int) -> DataFrame:
    return df if stride == 1 else df.filter(F.col(FRAME) % stride == 0)


def truncated(df: DataFrame, max_frames: int | None) -> DataFrame:
    return df if max_frames is None else df.filter(F.col(FRAME) < max_frames)


def summary(mols: DataFrame) -> DataFrame:
    """formula, n: molecules over all frames."""
    return mols.groupBy("formula").agg(F.count("*").alias("n"))


def composition(mols: DataFrame) -> DataFrame:
    """frame_id, formula, n."""
    return mols.groupBy(FRAME, "formula").agg(F.count("*").alias("n"))


def parse_cutoffs(raw: dict) -> dict[tuple[str, str], float]:
    """{'Be-O': 2.5} or {('Be', 'O'): 2.5} as the latter; a key must have two parts."""
    out = {}
    for key, value in raw.items():
        parts = [p.strip() for p in key.split("-")] if isinstance(key, str) else list(key)
        if len(parts) != 2:
            raise ValueError(f"a cutoff's key must name two elements: {key!r}")
        out[parts[0], parts[1]] = float(value)
    return out


def coordination_centers(atoms: DataFrame) -> DataFrame:
    """element: those present that form no covalent molecules."""
    return atoms.select("element").distinct().filter(~F.col("element").isin(COVALENT))


def validate(atoms: DataFrame, topo: DataFrame) -> DataFrame:
    """Faults of a topology: molecules' atoms that are not there, and atoms in two molecules. Empty if all is well."""
    absent = topo.join(atoms.select(FRAME, "atom_idx"), [FRAME, "atom_idx"], "left_anti").select(FRAME, "atom_idx", F.lit("absent").alias("fault"))
    twice = topo.groupBy(FRAME, "atom_idx").agg(F.count("*").alias("n")).filter("n > 1").select(FRAME, "atom_idx", F.lit("twice").alias("fault"))
    return absent.unionByName(twice)
