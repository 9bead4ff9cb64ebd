"""Deterministic trajectories made from the given tables, with the SQL that makes the same rows.

* A: each embedding is a frame of seven O and fourteen H atoms in a box whose length depends on the frame.
* M: A with other elements; T: A in slanted cells.
* B: three walkers, steps from embeddings, positions in thousandths of an angstrom.
* C: event types as species present in ten-minute frames, and users as entities whose state is the event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOLECULES, WALKERS, WALK_BOX = 7, 3, 12001
ORIGIN_US, FRAME_US, SERIES_FRAMES = 1704067200000000, 600000000, 4320


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (F.lit(12001) + 2 * (F.col("vec_id") % 7)).cast("double") / F.lit(1000.0)
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), *[length.alias(c) for c in ("lx", "ly", "lz")])


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dim(k, scale):
        return F.round(F.get("e", k).cast("double") * F.lit(float(scale))).cast("long")

    own = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(3 * MOLECULES - 1))).alias("atom_idx"))
    m, r = F.floor(F.col("atom_idx") / 3).cast("int"), F.col("atom_idx") % 3
    at = [(dim(9 * m + k, 80000) + F.when(r == 0, F.lit(0).cast("long")).otherwise(dim(9 * m + 3 * r + k, 4400))).cast("double") / F.lit(1000.0) for k in range(3)]
    return own.select("frame_id", "atom_idx", F.when(r == 0, "O").otherwise("H").alias("element"), *[x.alias(a) for a, x in zip("xyz", at)])


#: Elements of M, by the atom's number: metals, a metalloid, and elements of covalent molecules.
MIXED = ["O", "Fe", "H", "Zn", "C", "K", "Ge"]


def mixed_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).withColumn("element", F.get(F.lit(MIXED), (F.col("atom_idx") % len(MIXED)).cast("int")))


#: The vectors of T's cells, in lengths of A's.
SLANTED = [[1.0, 0.0, 0.0], [0.25, 0.9, 0.0], [0.1, 0.2, 0.95]]


def slanted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", F.array(*[F.array(*[F.col("lx") * x for x in row]) for row in SLANTED]).alias("cell"))


def topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each O with its two H."""
    return atoms(spark, sf_dir).select("frame_id", "atom_idx", F.floor(F.col("atom_idx") / 3).cast("int").alias("mol_id"))


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, idx, x, y, z (unwrapped) and wx, wy, wz (in the box)."""
    own = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(WALKERS - 1))).alias("track"))
    by = W.partitionBy("track").orderBy("vec_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = own.select("track", "vec_id", *[F.round(F.get("e", 3 * F.col("track") + k).cast("double") * F.lit(2000.0)).cast("long").alias(f"s{k}") for k in range(3)])
    sums = steps.select("track", F.col("vec_id").alias("idx"), *[F.sum(f"s{k}").over(by).alias(a) for k, a in enumerate("xyz")])
    return sums.select("track", "idx", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[F.pmod(F.col(a), F.lit(WALK_BOX).cast("long")).cast("double").alias(f"w{a}") for a in "xyz"])


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, formula, n."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(F.floor((us - ORIGIN_US) / FRAME_US).cast("int").alias("frame_id"), F.col("event_type").alias("formula")).groupBy("frame_id", "formula").agg(F.count("*").alias("n"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, t (from 1), state."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("t"), F.col("event_type").alias("state"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, v: events of each of the first 720 hours."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = _table(spark, sf_dir, "events").select(F.floor((us - ORIGIN_US) / (6 * FRAME_US)).cast("int").alias("i")).filter("i >= 0 and i < 720").groupBy("i").agg(F.count("*").alias("v"))
    return spark.range(720).select(F.col("id").cast("int").alias("i")).join(own, "i", "left").select("i", F.coalesce("v", F.lit(0)).cast("double").alias("v"))


def _dim(k: str, scale: int) -> str:
    return f"CAST(round(CAST(embedding[{k}] AS DOUBLE) * {scale}) AS BIGINT)"


def _xyz(k: int) -> str:
    return f"CAST({_dim(f'9 * (a // 3) + {k + 1}', 80000)} + CASE WHEN a % 3 = 0 THEN 0 ELSE {_dim(f'9 * (a // 3) + 3 * (a % 3) + {k + 1}', 4400)} END AS DOUBLE) / 1000e0 AS {'xyz'[k]}"


SQL_A = f"""fr AS (SELECT vec_id AS frame_id, CAST(12001 + 2 * (vec_id % 7) AS DOUBLE) / 1000e0 AS l FROM embeddings),
va AS (SELECT vec_id AS frame_id, CAST(a AS INTEGER) AS atom_idx, CAST(a // 3 AS INTEGER) AS mol_id, CASE WHEN a % 3 = 0 THEN 'O' ELSE 'H' END AS element, CASE WHEN a % 3 = 0 THEN 66e-2 ELSE 31e-2 END AS radius, {_xyz(0)}, {_xyz(1)}, {_xyz(2)} FROM embeddings, UNNEST(range({3 * MOLECULES})) AS t(a))"""


def sql_mixed() -> str:
    """fr and va of M."""
    from emberframe.functions.elements import RADII

    names, radii = ", ".join(f"'{e}'" for e in MIXED), ", ".join(f"{RADII[e]!r}e0" for e in MIXED)
    at = f"atom_idx % {len(MIXED)} + 1"
    return f"{SQL_A.replace('va AS (', 'v0 AS (')}, va AS (SELECT frame_id, atom_idx, mol_id, list_extract([{names}], {at}) AS element, list_extract([{radii}], {at}) AS radius, x, y, z FROM v0)"


def sql_slanted_pairs(name: str, on: str) -> str:
    """A table name(frame_id, i, j, ri, rj, d) of pairs of va in T's cells: the nearest of 27 images around the rounded one."""
    (ax, _, _), (bx, by, _), (cx, cy, cz) = [[f"{x!r}e0 * l" for x in row] for row in SLANTED]
    image = "(VALUES (-1), (0), (1))"
    return f"""{name}_d AS (SELECT frame_id, a.atom_idx AS i, b.atom_idx AS j, a.radius AS ri, b.radius AS rj, l, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM va a JOIN va b USING (frame_id) JOIN fr USING (frame_id) WHERE {on}),
{name}_c AS (SELECT *, dz / ({cz}) AS fc FROM {name}_d), {name}_b AS (SELECT *, (dy - fc * {cy}) / ({by}) AS fb FROM {name}_c), {name}_a AS (SELECT *, (dx - fb * {bx} - fc * {cx}) / ({ax}) AS fa FROM {name}_b),
{name}_f AS (SELECT *, fa - round_even(fa, 0) + u AS ga, fb - round_even(fb, 0) + v AS gb, fc - round_even(fc, 0) + w AS gc FROM {name}_a, {image} AS t1(u), {image} AS t2(v), {image} AS t3(w)),
{name} AS (SELECT frame_id, i, j, ri, rj, sqrt(min(power(ga * {ax} + gb * {bx} + gc * {cx}, 2) + power(gb * {by} + gc * {cy}, 2) + power(gc * {cz}, 2))) AS d FROM {name}_f GROUP BY ALL)"""


def sql_pairs(name: str, a: str = "true", b: str = "true", on: str = "true") -> str:
    """A table name(frame_id, i, j, ei, ej, ri, rj, mi, mj, dx, dy, dz, d) of pairs of va."""
    d = ", ".join(f"(b.{c} - a.{c}) - l * round_even((b.{c} - a.{c}) / l, 0) AS d{c}" for c in "xyz")
    return f"{name} AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM (SELECT frame_id, a.atom_idx AS i, b.atom_idx AS j, a.element AS ei, b.element AS ej, a.radius AS ri, b.radius AS rj, a.mol_id AS mi, b.mol_id AS mj, {d} FROM va a JOIN va b USING (frame_id) JOIN fr USING (frame_id) WHERE ({a}) AND ({b}) AND ({on})))"


SQL_BONDS = f"""{SQL_A}, {sql_pairs('pb', on='a.atom_idx < b.atom_idx')}, bonds AS (SELECT frame_id, i, j, d FROM pb WHERE d < 1e0 * (ri + rj) + 6e-1)"""


def sql_molecules(bonds: str = SQL_BONDS) -> str:
    """Tables tp(frame_id, atom_idx, mol_id) and mols(frame_id, mol_id, formula, n_atoms, cx, cy, cz). Begins a WITH RECURSIVE."""
    return f"""{bonds}, both_ways AS (SELECT frame_id, i AS s, j AS t FROM bonds UNION SELECT frame_id, j, i FROM bonds),
reach AS (SELECT frame_id, atom_idx AS s, atom_idx AS t FROM va UNION SELECT reach.frame_id, reach.s, b.t FROM reach JOIN both_ways b ON b.frame_id = reach.frame_id AND b.s = reach.t),
lab AS (SELECT frame_id, s AS atom_idx, min(t) AS label FROM reach GROUP BY ALL),
tp AS (SELECT frame_id, atom_idx, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY label) - 1 AS INTEGER) AS mol_id FROM lab),
ma AS (SELECT va.frame_id, va.atom_idx, tp.mol_id, element, x, y, z FROM va JOIN tp ON tp.frame_id = va.frame_id AND tp.atom_idx = va.atom_idx),
fo AS (SELECT frame_id, mol_id, string_agg(element || CASE WHEN c > 1 THEN CAST(c AS VARCHAR) ELSE '' END, '' ORDER BY element) AS formula FROM (SELECT frame_id, mol_id, element, count(*) AS c FROM ma GROUP BY ALL) GROUP BY ALL),
mols AS (SELECT frame_id, mol_id, any_value(formula) AS formula, CAST(count(*) AS INTEGER) AS n_atoms, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ma JOIN fo USING (frame_id, mol_id) GROUP BY ALL)"""


SQL_WALK = f"""ws AS (SELECT vec_id AS idx, CAST(m AS INTEGER) AS track, {", ".join(f"{_dim(f'3 * m + {k + 1}', 2000)} AS s{k}" for k in range(3))} FROM embeddings, UNNEST(range({WALKERS})) AS t(m)),
wk AS (SELECT track, idx, {", ".join(f"CAST(sum(s{k}) OVER (PARTITION BY track ORDER BY idx) AS BIGINT) AS {a}" for k, a in enumerate("xyz"))} FROM ws)"""

SQL_PRESENCE = f"""pr AS (SELECT CAST(floor((epoch_us(ts) - {ORIGIN_US}) / {FRAME_US}.0) AS INTEGER) AS frame_id, event_type AS formula, count(*) AS n FROM events GROUP BY ALL),
isl AS (SELECT formula, frame_id, frame_id - row_number() OVER (PARTITION BY formula ORDER BY frame_id) AS g FROM (SELECT DISTINCT formula, frame_id FROM pr)),
sg AS (SELECT formula, min(frame_id) AS start, max(frame_id) + 1 AS stop FROM isl GROUP BY formula, g),
seg AS (SELECT formula, CAST(row_number() OVER (PARTITION BY formula ORDER BY start) - 1 AS INTEGER) AS segment, start, stop FROM sg)"""

SQL_STATES = "st AS (SELECT user_id AS entity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS t, event_type AS state FROM events)"


def sql_track(states: str, persistence: int) -> str:
    """Tables ms (rows with run, len, place) and tr (entity, t, from_state, to_state) of the table named st."""
    return f"""{states}, m1 AS (SELECT *, row_number() OVER w AS n, CASE WHEN row_number() OVER w = 1 OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS fresh FROM st WINDOW w AS (PARTITION BY entity ORDER BY t)),
m2 AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY t) AS run FROM m1),
ms AS (SELECT *, row_number() OVER (PARTITION BY entity, run ORDER BY t) AS place, count(*) OVER (PARTITION BY entity, run) AS len FROM m2),
kept AS (SELECT * FROM ms WHERE (run = 1 AND place = 1) OR (run > 1 AND len >= {persistence} AND place = {persistence})),
k2 AS (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY run) AS before, lag(run) OVER (PARTITION BY entity ORDER BY run) AS run_before FROM kept),
tr AS (SELECT entity, t, before AS from_state, state AS to_state FROM k2 WHERE run_before IS NOT NULL AND state IS DISTINCT FROM before)"""
