"""Reading and writing trajectories, built tables, per-step results and logs.

Tables are Parquet with ``frame_id`` first: frames (frame_id, lx, ly, lz or cell, pbc, info), atoms (frame_id, atom_idx, element, x, y, z
and extras), topo and mols. A filter on the frame reaches the scan.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.operators.selectors import FRAME

VERSION = 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share; on one machine without it, below a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="emberframe-")
    return f"{path.rstrip('/')}/emberframe/{name}-{uuid.uuid4().hex}"


_LATTICE = r'Lattice="([^"]*)"'


def parse_address(address: str) -> tuple[str, int | None]:
    """'path@12' as path and frame; no frame without a number after the last @."""
    path, at, number = address.rpartition("@")
    return (path, int(number)) if at and re.fullmatch(r"-?\d+", number) else (address, None)


#: Characters of a file in one row, about; a longer line is a row by itself.
PIECE = 1024


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def read_xyz(spark: SparkSession, path: str, max_frames: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of extended-XYZ files, frames numbered from 0 through each file in the order of names.

    A frame is a count, a line of key=value, and as many atom lines: symbol, position, further columns (kept as extras, null where they are
    no numbers). Frames have their whole lattice as cell; lx, ly, lz are its diagonal, which is all of it in a box only: geometry.cell_of
    tells. Blocks of files are read in parallel; each file's pieces, in order, stream through one task, which holds one frame.
    """

    def pack(batches):
        """Lines to pieces of a block, numbered in order: rows of PIECE characters, so that few rows carry the path."""
        block, number, lines, size = None, 0, [], 0
        for batch in batches:
            found = []
            for path, start, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (path, start) != block or size >= PIECE:
                    if lines:
                        found.append((*block, number, "\n".join(lines)))
                    number, lines, size = number + 1 if (path, start) == block else 0, [], 0
                    block = path, start
                lines.append(line)
                size += len(line) + 1
            yield _batch(found, pieces)
        if lines:
            yield _batch([(*block, number, "\n".join(lines))], pieces)

    def split(batches):
        """The sorted pieces of whole files to frames; what is held is the frame that pieces cut."""
        path, lines, number, over = None, [], 0, False

        def cut(end: bool):
            nonlocal number, over, lines
            at = 0
            while at < len(lines):
                if not lines[at].strip():
                    over = True
                    break
                n = int(lines[at])
                if at + 2 + n > len(lines) and not end:
                    break
                yield path, number, "".join(lines[at + 1 : at + 2]), "\n".join(lines[at + 2 : at + 2 + n])
                at, number = at + 2 + n, number + 1
            lines = [] if over or end else lines[at:]

        for batch in batches:
            found, size = [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if name != path:
                    found += cut(True)
                    path, lines, number, over = name, [], 0, False
                if over:
                    continue
                lines += text.split("\n")
                # a frame longer than a piece is looked at again when all its lines may be there
                if not lines[0].strip() or len(lines) >= int(lines[0]) + 2:
                    found += cut(False)
                size += len(text)
                if size > 1 << 22:
                    yield _batch(found, records)
                    found, size = [], 0
            yield _batch(found, records)
        yield _batch(list(cut(True)), records)

    pieces = "path string, block long, piece int, value string"
    records = "path string, number int, comment string, body string"
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    parts = lines.mapInArrow(pack, pieces).repartition("path").sortWithinPartitions("path", "block", "piece").mapInArrow(split, records)
    sizes = parts.groupBy("path").agg(F.count("*").alias("n"))
    # a row per file, whose frames before it are a running sum: few, as the driver lists the files
    offsets = sizes.select("path", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("before"))
    each = parts.join(F.broadcast(offsets), "path").withColumn(FRAME, F.col("number") + F.col("before"))
    if max_frames is not None:
        each = each.filter(F.col(FRAME) < max_frames)
    lattice = F.split(F.regexp_extract("comment", _LATTICE, 1), " ")
    has = F.regexp_extract("comment", _LATTICE, 1) != ""

    def cell(i: int) -> Column:
        return F.when(has, F.get(lattice, i).cast("double"))

    frames = each.select(FRAME, F.when(has, F.array(*[F.array(*[cell(3 * i + k) for k in range(3)]) for i in range(3)])).alias("cell"), cell(0).alias("lx"), cell(4).alias("ly"), cell(8).alias("lz"), F.regexp_extract("comment", r'pbc="([^"]*)"', 1).contains("T").alias("pbc"), F.expr(r"""str_to_map(array_join(regexp_extract_all(regexp_replace(comment, '"[^"]*"', ''), '(\\w+=[^ =]+)', 1), '\u0001'), '\u0001', '=')""").alias("info"))
    atoms = each.select(FRAME, F.posexplode(F.split("body", "\n")).alias("atom_idx", "line")).select(FRAME, "atom_idx", F.split(F.trim("line"), r"\s+").alias("f"))
    number = lambda i: F.get("f", i).cast("double")
    atoms = atoms.select(FRAME, "atom_idx", F.get("f", F.lit(0)).alias("element"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"), F.transform(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), lambda v: v.try_cast("double")).alias("extras"))
    return frames, atoms


def xyz_text(atoms: DataFrame, frames: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """group, frame_id, value: one extended-XYZ record for each frame; with frames, their cells are written."""
    keys = [*(group or []), FRAME]
    line = F.format_string("%-2s %16.8f %16.8f %16.8f", "element", "x", "y", "z")
    own = atoms.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("atom_idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    box = F.lit("")
    if frames is not None:
        kind = G.BOX if "cell" not in frames.columns else G.CELL
        own = own.join(frames.select(FRAME, kind.matrix().alias("cell")), FRAME)
        numbers = F.array_join(F.transform(F.flatten("cell"), lambda x: F.format_string("%.10f", x)), " ")
        box = F.when(F.col("cell").isNotNull(), F.concat(F.lit('Lattice="'), numbers, F.lit('" '))).otherwise("")
    head = F.concat(box, F.lit("Properties=species:S:1:pos:R:3 "), F.format_string("frame=%d ", FRAME), F.lit('pbc="T T T"' if frames is not None else 'pbc="F F F"'))
    return own.select(*keys, F.concat_ws("\n", F.col("n").cast("string"), head, "body").alias("value"))


def write_windows(atoms: DataFrame, windows: DataFrame, path: str, frames: DataFrame | None = None) -> None:
    """One folder name=<window> below path for each window (name, first, stop), its frames in order in one file of extended XYZ."""
    # each window's frames as rows: an equi-join on the frame, whatever the number of windows
    wanted = windows.filter("stop > first").select("name", F.explode(F.sequence("first", F.col("stop") - 1)).alias(FRAME))
    own = atoms.join(wanted, FRAME)
    text = xyz_text(own, frames, ["name"])
    text.repartition("name").sortWithinPartitions("name", FRAME).select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def segment_windows(segments: DataFrame, formula: str) -> DataFrame:
    """Windows named {formula}_{start}_{stop}."""
    return segments.filter(F.col("formula") == formula).select(F.concat_ws("_", "formula", "start", "stop").alias("name"), F.col("start").alias("first"), "stop")


def transition_windows(windows: DataFrame, event: str) -> DataFrame:
    """Windows of runs.reaction_windows named {formula}_seg{segment}_{event}."""
    return windows.select(F.concat(F.col("formula"), F.lit("_seg"), F.col("segment"), F.lit(f"_{event}")).alias("name"), "first", "stop")


def cache_key(path: str, mode: str, covalent_scale: float, coordination_scale: float, max_frames: int | None, sphere_cutoffs: dict | None = None, persistence: int = 1) -> str:
    """64 hex digits that name one way of building one trajectory; the order of cutoffs doesn't matter."""
    said = {"path": path, "mode": mode, "scales": [covalent_scale, coordination_scale], "max_frames": max_frames, "persistence": persistence, "version": VERSION, "cutoffs": {"-".join(k): v for k, v in (sphere_cutoffs or {}).items()}}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


TABLES = ("frames", "atoms", "topo", "mols")


def save(tables: dict[str, DataFrame], path: str, key: str) -> None:
    """Each table as Parquet below path/key, sorted by frame inside files so that frames are found by row groups."""
    for name, df in tables.items():
        df.sortWithinPartitions(FRAME).write.mode("overwrite").parquet(f"{path}/{key}/{name}")


def load(spark: SparkSession, path: str, key: str) -> dict[str, DataFrame]:
    """The tables saved under the key; an error if there are none."""
    return {name: spark.read.parquet(f"{path}/{key}/{name}") for name in TABLES}


def append_results(results: DataFrame, path: str) -> None:
    """Adds rows of per-step results (frame_id and values); steps carry their number, so a value that first comes late is not misplaced. Nothing is written for no rows."""
    if not results.isEmpty():
        results.write.mode("append").parquet(path)


def attach(frames: DataFrame, atoms: DataFrame, per_frame: DataFrame | None = None, per_atom: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """frames and atoms with the columns of per-frame (by frame_id) and per-atom results (and atom_idx); null where there are none."""
    if per_frame is not None:
        frames = frames.join(per_frame, FRAME, "left")
    if per_atom is not None:
        atoms = atoms.join(per_atom, [FRAME, "atom_idx"], "left")
    return frames, atoms


def read_log(spark: SparkSession, path: str, column: int = 8, skip_rows: int = 1) -> DataFrame:
    """i, v: one column of a log with blanks between columns, rows numbered from 0 after skip_rows. One file, whose lines are numbered in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).filter(F.trim("line") != "")
    return lines.filter(F.col("n") >= skip_rows).select((F.col("n") - skip_rows).alias("i"), F.get(F.split(F.trim("line"), r"\s+"), F.lit(column)).cast("double").alias("v"))


def box_frames(spark: SparkSession, n: int, length: float) -> DataFrame:
    """n frames with one cubic box."""
    return spark.range(n).select(F.col("id").cast("int").alias(FRAME), *[F.lit(length).alias(c) for c in G.BOX.columns])

