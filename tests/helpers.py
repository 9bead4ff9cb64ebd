"""Small frames as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ATOMS = "frame_id int, atom_idx int, element string, x double, y double, z double"


def tables(spark: SparkSession, frames: list[tuple[list[str], list[tuple]]], cell: float = 30.0, molecules: list[list[list[int]]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(frames, atoms, topo) of (symbols, positions) per frame; molecules per frame, or the same for all."""
    rows = [(f, i, s, *map(float, p)) for f, (symbols, places) in enumerate(frames) for i, (s, p) in enumerate(zip(symbols, places))]
    atoms = spark.createDataFrame(rows, ATOMS)
    fr = spark.createDataFrame([(f, cell, cell, cell) for f in range(len(frames))], "frame_id int, lx double, ly double, lz double")
    topo = None
    if molecules is not None:
        every = molecules if len(molecules) == len(frames) else molecules * len(frames)
        topo = spark.createDataFrame([(f, a, m) for f, mols in enumerate(every) for m, mol in enumerate(mols) for a in mol], "frame_id int, atom_idx int, mol_id int")
    return fr, atoms, topo


def rows(df: DataFrame, *order: str) -> list[tuple]:
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


WATER = (["O", "H", "H"], [(0, 0, 0), (0.96, 0, 0), (0, 0.96, 0)])
