"""One query per operator over the virtual trajectories, and DuckDB SQL for the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.functions.elements import COLORS, COVALENT, OTHER_COLOR, RADII, element_table
from emberframe.operators import correlation as C
from emberframe.operators import distributions as D
from emberframe.operators import perception as P
from emberframe.operators import runs as R
from emberframe.operators import selectors as S
from emberframe.operators import stats as B
from emberframe.operators import tracks as K
from emberframe.plans import virtual as V
from emberframe.sources import trajectory as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


class _A:
    """Trajectory A, with known or perceived molecules."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.frames, self.atoms, self.known = V.frames(spark, sf_dir), V.atoms(spark, sf_dir), V.topo(spark, sf_dir)

    def of(self, element: str) -> DataFrame:
        return self.atoms.filter(F.col("element") == element)

    @property
    def topo(self) -> DataFrame:
        return P.build_molecules(self.atoms, self.frames)

    @property
    def mols(self) -> DataFrame:
        return P.molecules(self.atoms, self.topo)


MOLECULES = V.sql_molecules()
RECURSIVE = f"WITH RECURSIVE {MOLECULES} "

# -- perception and selections


@query(RECURSIVE + "SELECT formula, count(*) AS n FROM mols GROUP BY formula")
def species_summary(spark, sf_dir):
    return S.summary(_A(spark, sf_dir).mols)


@query(RECURSIVE + "SELECT frame_id, formula, count(*) AS n FROM mols GROUP BY ALL")
def composition_per_frame(spark, sf_dir):
    return S.composition(_A(spark, sf_dir).mols)


@query(RECURSIVE + "SELECT frame_id, mol_id, formula, n_atoms, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM mols")
def molecule_formulas(spark, sf_dir):
    return _A(spark, sf_dir).mols.select("frame_id", "mol_id", "formula", "n_atoms", *[_r(c).alias(c) for c in ("cx", "cy", "cz")])


@query(RECURSIVE + "SELECT frame_id, atom_idx, mol_id FROM tp")
def molecules_components(spark, sf_dir):
    return _A(spark, sf_dir).topo


@query(RECURSIVE + "SELECT ma.frame_id, atom_idx, ma.mol_id, element, formula FROM ma JOIN mols USING (frame_id, mol_id) WHERE formula = 'HO' AND element = 'O'")
def select_atoms(spark, sf_dir):
    t = _A(spark, sf_dir)
    return S.select(t.atoms, {"HO": "O"}, t.topo, t.mols).select("frame_id", "atom_idx", "mol_id", "element", "formula")


@query(RECURSIVE + "SELECT frame_id, mol_id, formula, CAST(place AS INTEGER) AS place FROM mols JOIN (VALUES ('HO', 0), ('H2O', 1), ('HO', 2)) AS v(formula, place) USING (formula)")
def select_formulas(spark, sf_dir):
    return S.by_formula(_A(spark, sf_dir).mols, ["HO", "H2O", "HO"]).select("frame_id", "mol_id", "formula", F.col("place").cast("int").alias("place"))


@query(f"WITH {V.SQL_BONDS} SELECT frame_id, i, j, round(d, 6) AS d FROM bonds")
def bond_list(spark, sf_dir):
    t = _A(spark, sf_dir)
    return P.bonds(t.atoms, t.frames).select("frame_id", "i", "j", _r("d").alias("d"))


@query(f"WITH {V.SQL_A}, {V.sql_pairs('pc', on='a.atom_idx <> b.atom_idx')} SELECT frame_id, i, j, round(d, 6) AS d FROM pc WHERE d < 2.5e0")
def neighbour_cells(spark, sf_dir):
    t = _A(spark, sf_dir)
    return P.pairs_within(t.atoms, t.atoms, t.frames, 2.5).filter("a_idx <> b_idx").select("frame_id", F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), _r("d").alias("d"))


@query(
    f"WITH {V.SQL_BONDS}, f2 AS (SELECT frame_id, lag(frame_id) OVER w AS before, lead(frame_id) OVER w AS nxt FROM fr WINDOW w AS (ORDER BY frame_id)), own AS (SELECT * FROM bonds JOIN f2 USING (frame_id)) "
    "SELECT frame_id, 'formed' AS event, i, j FROM own WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bonds b WHERE b.frame_id = own.before AND b.i = own.i AND b.j = own.j) "
    "UNION ALL SELECT nxt, 'broken', i, j FROM own WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bonds b WHERE b.frame_id = own.nxt AND b.i = own.i AND b.j = own.j)"
)
def bond_events(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.bond_events(P.bonds(t.atoms, t.frames), t.frames)


_SPHERE = {("O", "H"): 1.9}


@query(
    "WITH RECURSIVE "
    + V.sql_molecules(f"{V.SQL_A}, {V.sql_pairs('pb', on='a.atom_idx < b.atom_idx')}, bonds AS (SELECT frame_id, i, j, d FROM pb WHERE (ei <> ej AND d < 19e-1) OR d < 1e0 * (CASE WHEN ei = 'O' THEN 0e0 ELSE ri END + CASE WHEN ej = 'O' THEN 0e0 ELSE rj END) + 2e0 * 1e-1)")
    + "SELECT frame_id, atom_idx, mol_id FROM tp"
)
def molecules_sphere(spark, sf_dir):
    t = _A(spark, sf_dir)
    return P.build_spheres(t.atoms, t.frames, _SPHERE)


_SPHERE_BINS = len(G.edges(5.0, 0.05)) - 1


@query(
    f"""WITH {V.SQL_A}, {V.sql_pairs('pb', "a.element = 'O'", 'true', 'a.atom_idx <> b.atom_idx')},
hc AS (SELECT ej AS ligand, least(CAST(floor(d / ({_SPHERE_BINS * 0.05!r}e0 / {_SPHERE_BINS})) AS INTEGER), {_SPHERE_BINS - 1}) AS bin, count(*) AS c FROM pb WHERE d > 3e-1 AND d <= {_SPHERE_BINS * 0.05!r}e0 GROUP BY ALL),
sp AS (SELECT l.ligand, CAST(b AS INTEGER) AS bin, coalesce(c, 0) AS c FROM (SELECT DISTINCT ligand FROM hc) AS l CROSS JOIN range({_SPHERE_BINS}) AS t(b) LEFT JOIN hc ON hc.ligand = l.ligand AND hc.bin = t.b),
sm AS (SELECT ligand, bin, sum(c) OVER (PARTITION BY ligand ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5e0 AS g FROM sp),
nb AS (SELECT *, lag(g) OVER w AS lo, lead(g) OVER w AS hi FROM sm WINDOW w AS (PARTITION BY ligand ORDER BY bin)),
pk AS (SELECT ligand, bin AS peak FROM (SELECT *, row_number() OVER (PARTITION BY ligand ORDER BY g DESC, bin) AS k FROM nb WHERE bin >= 1 AND bin < {int(0.55 * 5.0 / 0.05)}) AS q WHERE k = 1 AND g >= 1)
SELECT 'O' AS center, nb.ligand, round((min(bin) + 0.5e0) * 5e-2, 6) AS cutoff, round((min(peak) + 0.5e0) * 5e-2, 6) AS peak FROM nb JOIN pk ON pk.ligand = nb.ligand WHERE bin > peak AND g <= lo AND g <= hi GROUP BY nb.ligand"""
)
def sphere_cutoffs(spark, sf_dir):
    t = _A(spark, sf_dir)
    return P.detect_sphere_cutoffs(t.atoms, t.frames, ["O"], ligands=["H", "O"]).select("center", "ligand", _r("cutoff").alias("cutoff"), _r("peak").alias("peak"))


_RUNS_T7 = """s1 AS (SELECT frame_id, mol_id, string_agg(lpad(CAST(atom_idx AS VARCHAR), 9, '0'), ',' ORDER BY atom_idx) AS s FROM tp GROUP BY ALL),
e1 AS (SELECT tp.frame_id, atom_idx, s FROM tp JOIN s1 ON s1.frame_id = tp.frame_id AND s1.mol_id = tp.mol_id),
e2 AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY atom_idx ORDER BY frame_id) THEN 1 ELSE 0 END AS fresh FROM e1),
e3 AS (SELECT *, sum(fresh) OVER (PARTITION BY atom_idx ORDER BY frame_id) AS run FROM e2),
r1 AS (SELECT atom_idx, run, any_value(s) AS own, count(*) AS len FROM e3 GROUP BY ALL),
r2 AS (SELECT *, lag(own) OVER w AS before, lead(own) OVER w AS after FROM r1 WINDOW w AS (PARTITION BY atom_idx ORDER BY run)),
k1 AS (SELECT frame_id, e3.atom_idx, CASE WHEN len < 3 AND before = after THEN before ELSE own END AS kept FROM e3 JOIN r2 ON r2.atom_idx = e3.atom_idx AND r2.run = e3.run),
k2 AS (SELECT frame_id, kept, min(atom_idx) AS least FROM k1 GROUP BY ALL),
k3 AS (SELECT frame_id, kept, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY least, kept) - 1 AS INTEGER) AS mol_id FROM k2)
SELECT k1.frame_id, atom_idx, mol_id FROM k1 JOIN k3 ON k3.frame_id = k1.frame_id AND k3.kept = k1.kept"""


@query(RECURSIVE + ", " + _RUNS_T7)
def persistence_filter(spark, sf_dir):
    return P.persistence_filter(_A(spark, sf_dir).topo, 3)


@query(f"WITH {V.sql_mixed()} SELECT DISTINCT element FROM va WHERE element NOT IN ({', '.join(repr(e) for e in COVALENT)})")
def coordination_centers(spark, sf_dir):
    return S.coordination_centers(V.mixed_atoms(spark, sf_dir))


@query(f"WITH {V.sql_mixed()}, {V.sql_pairs('pb', on='a.atom_idx < b.atom_idx')} SELECT frame_id, i, j, ei, ej, round(d, 6) AS d FROM pb WHERE d < 1e0 * (ri + rj) + 6e-1")
def bond_list_mixed(spark, sf_dir):
    atoms = V.mixed_atoms(spark, sf_dir)
    names = [atoms.select("frame_id", F.col("atom_idx").alias(c), F.col("element").alias(f"e{c}")) for c in "ij"]
    return P.bonds(atoms, V.frames(spark, sf_dir)).join(names[0], ["frame_id", "i"]).join(names[1], ["frame_id", "j"]).select("frame_id", "i", "j", "ei", "ej", _r("d").alias("d"))


@query(f"WITH {V.SQL_A}, {V.sql_slanted_pairs('pb', 'a.atom_idx < b.atom_idx')} SELECT frame_id, i, j, round(d, 6) AS d FROM pb WHERE d < 1e0 * (ri + rj) + 6e-1")
def bond_list_slanted(spark, sf_dir):
    frames = V.slanted_frames(spark, sf_dir)
    return P.bonds(V.atoms(spark, sf_dir), frames, box=G.cell_of(frames)).select("frame_id", "i", "j", _r("d").alias("d"))


@query(f"WITH {V.SQL_A} SELECT frame_id, atom_idx, CASE WHEN mol_id < 3 THEN mol_id ELSE -1 END AS mol_id FROM va")
def molecule_of_atom(spark, sf_dir):
    t = _A(spark, sf_dir)
    return S.molecule_of(t.atoms, t.known.filter("mol_id < 3"))


@query(" UNION ALL ".join(f"SELECT '{e}' AS element, {r!r}e0 AS radius, '{COLORS.get(e, OTHER_COLOR)}' AS color" for e, r in RADII.items()))
def element_data(spark, sf_dir):
    return element_table(spark)


# -- sources: written below the shared folder and read again


@query(f"WITH {V.SQL_A} SELECT CAST(dense_rank() OVER (ORDER BY frame_id) - 1 AS INTEGER) AS frame_id, atom_idx, element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(l, 6) AS lx FROM va JOIN fr USING (frame_id)")
def xyz_round_trip(spark, sf_dir):
    t, path = _A(spark, sf_dir), sources.scratch(spark, "xyz")
    sources.xyz_text(t.atoms, t.frames).repartitionByRange(4, "frame_id").sortWithinPartitions("frame_id").select("value").write.text(path)
    frames, atoms = sources.read_xyz(spark, path)
    return atoms.join(frames, "frame_id").select("frame_id", "atom_idx", "element", *[_r(a).alias(a) for a in "xyz"], _r("lx").alias("lx"))


@query(f"WITH {V.SQL_A} SELECT frame_id, atom_idx, element, mol_id, round(x, 6) AS x, round(l, 6) AS lx FROM va JOIN fr USING (frame_id)")
def saved_tables(spark, sf_dir):
    t, path = _A(spark, sf_dir), sources.scratch(spark, "saved")
    key = sources.cache_key(sf_dir, "molecular", 1.0, 1.3, None)
    sources.save({"frames": t.frames, "atoms": t.atoms, "topo": t.known, "mols": P.molecules(t.atoms, t.known)}, path, key)
    found = sources.load(spark, path, key)
    return found["atoms"].join(found["topo"], ["frame_id", "atom_idx"]).join(found["frames"], "frame_id").select("frame_id", "atom_idx", "element", "mol_id", _r("x").alias("x"), _r("lx").alias("lx"))


@query(f"WITH {V.SQL_A}, wn(name, first, stop) AS (VALUES ('w0', 0, 12), ('w1', 7, 30), ('w2', 100, 100)) SELECT name, frame_id, CAST(count(*) AS BIGINT) AS n, round(sum(x), 3) AS sx FROM va JOIN wn ON frame_id >= first AND frame_id < stop GROUP BY ALL")
def written_windows(spark, sf_dir):
    t, path = _A(spark, sf_dir), sources.scratch(spark, "windows")
    windows = spark.createDataFrame([("w0", 0, 12), ("w1", 7, 30), ("w2", 100, 100)], "name string, first long, stop long")
    sources.write_windows(t.atoms, windows, path, t.frames)
    # a frame's number is in its second line, its atoms in those after
    text = spark.read.text(path, wholetext=True).select("name", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(frame=\d+ .*?)(?=Lattice|\z)"), F.lit(1))).alias("t"))
    each = text.select("name", F.regexp_extract("t", r"frame=(\d+)", 1).cast("long").alias("frame_id"), F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^[A-Z][a-z]? +(-?[0-9.]+) "), F.lit(1))).alias("x"))
    return each.groupBy("name", "frame_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 3).alias("sx"))


# -- pair, angular and spatial distributions


def _rdf_sql(a: str, b: str, rmax: float, dr: float, integrate: bool, source: str = V.SQL_A) -> str:
    n = len(G.edges(rmax, dr)) - 1
    width, top = f"{(n * dr - 0.0) / n!r}e0", f"{n * dr!r}e0"
    extra = f", round((rho / k) * sum(gg * shell) OVER (ORDER BY bin), 6) AS n" if integrate else ""
    return f"""WITH {source}, {V.sql_pairs('pp', f"a.element = '{a}'", f"b.element = '{b}'", "a.atom_idx <> b.atom_idx")},
h AS (SELECT least(CAST(floor(d / {width}) AS INTEGER), {n - 1}) AS bin, count(*) AS hits FROM pp WHERE d <= {top} GROUP BY 1),
per AS (SELECT frame_id, count(*) FILTER (element = '{a}') AS nc, count(*) FILTER (element = '{b}') / any_value(l * l * l) AS rho FROM va JOIN fr USING (frame_id) GROUP BY frame_id),
tot AS (SELECT sum(nc * rho) AS norm, sum(rho) AS rho, count(*) AS k FROM per),
cv AS (SELECT CAST(b AS INTEGER) AS bin, (b + 0.5e0) * {dr!r}e0 AS r, 4e0 * {math.pi!r}e0 * ((b + 0.5e0) * {dr!r}e0) * ((b + 0.5e0) * {dr!r}e0) * {dr!r}e0 AS shell, coalesce(hits, 0) AS hits, norm, rho, k FROM range({n}) AS t(b) LEFT JOIN h ON h.bin = t.b CROSS JOIN tot),
cg AS (SELECT *, hits / (norm * shell) AS gg FROM cv)
SELECT bin, round(r, 6) AS r, round(gg, 6) AS g{extra} FROM cg"""


@query(_rdf_sql("O", "H", 5.0, 0.1, False))
def rdf_oh(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.rdf(t.of("O"), t.of("H"), t.frames, rmax=5.0, dr=0.1).select("bin", _r("r").alias("r"), _r("g").alias("g"))


@query(_rdf_sql("O", "O", 6.0, 0.05, True))
def rdf_oo_coordination(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.rdf(t.of("O"), t.of("O"), t.frames, rmax=6.0, dr=0.05, integrate=True).select("bin", *[_r(c).alias(c) for c in ("r", "g", "n")])


@query(
    RECURSIVE
    + f""", {V.sql_pairs('pp', "a.element = 'O'", "b.element = 'O'", 'a.atom_idx <> b.atom_idx')},
co AS (SELECT frame_id, atom_idx AS i FROM ma JOIN mols USING (frame_id, mol_id) WHERE formula = 'HO' AND element = 'O'),
nb AS (SELECT pp.frame_id, pp.d FROM pp JOIN co ON co.frame_id = pp.frame_id AND co.i = pp.i),
h AS (SELECT least(CAST(floor(d / 25e-2) AS INTEGER), 19) AS bin, count(*) AS hits FROM nb WHERE d <= 5e0 GROUP BY 1),
per AS (SELECT frame_id, nc, 7 / (l * l * l) AS rho FROM (SELECT frame_id, count(*) AS nc FROM co GROUP BY 1) JOIN fr USING (frame_id)),
tot AS (SELECT sum(nc * rho) AS norm FROM per)
SELECT CAST(b AS INTEGER) AS bin, round((b + 0.5e0) * 25e-2, 6) AS r, round(coalesce(hits, 0) / (norm * (4e0 * {math.pi!r}e0 * ((b + 0.5e0) * 25e-2) * ((b + 0.5e0) * 25e-2) * 25e-2)), 6) AS g FROM range(20) AS t(b) LEFT JOIN h ON h.bin = t.b CROSS JOIN tot"""
)
def rdf_selector(spark, sf_dir):
    t = _A(spark, sf_dir)
    centers = S.select(t.atoms, {"HO": "O"}, t.topo, t.mols)
    return D.rdf(centers, t.of("O"), t.frames, rmax=5.0, dr=0.25).select("bin", _r("r").alias("r"), _r("g").alias("g"))


@query(
    f"""WITH {V.SQL_A}, {V.sql_pairs('pp', "a.element = 'O'", "b.element = 'H'", 'a.atom_idx <> b.atom_idx')},
h AS (SELECT CAST(floor(frame_id / 100.0) AS INTEGER) AS block, least(CAST(floor(d / 25e-2) AS INTEGER), 19) AS bin, count(*) AS hits FROM pp WHERE d <= 5e0 GROUP BY ALL),
nm AS (SELECT CAST(floor(frame_id / 100.0) AS INTEGER) AS block, sum(7 * 14 / (l * l * l)) AS norm FROM fr GROUP BY 1),
gg AS (SELECT nm.block, CAST(b AS INTEGER) AS bin, coalesce(hits, 0) / (norm * (4e0 * {math.pi!r}e0 * ((b + 0.5e0) * 25e-2) * ((b + 0.5e0) * 25e-2) * 25e-2)) AS g FROM nm CROSS JOIN range(20) AS t(b) LEFT JOIN h ON h.block = nm.block AND h.bin = t.b)
SELECT bin, round((bin + 0.5e0) * 25e-2, 6) AS r, round(avg(g), 6) AS g, round(stddev_samp(g) / sqrt(count(*)), 6) AS stderr, count(*) AS n_blocks FROM gg GROUP BY bin"""
)
def rdf_block_errors(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.rdf_blocks(t.of("O"), t.of("H"), t.frames, 100, rmax=5.0, dr=0.25).select("bin", *[_r(c).alias(c) for c in ("r", "g", "stderr")], "n_blocks")


_CURVE = _rdf_sql("O", "H", 5.0, 0.1, True)


def _oh_curve(t: _A) -> DataFrame:
    found = D.rdf(t.of("O"), t.of("H"), t.frames, rmax=5.0, dr=0.1, integrate=True)
    return found.select("bin", *[_r(c).alias(c) for c in ("r", "g", "n")])


@query(
    f"""WITH c AS ({_CURVE}), far AS (SELECT *, lag(g) OVER w AS lo, lead(g) OVER w AS hi FROM c WHERE r > 0.5 WINDOW w AS (ORDER BY bin)),
pk AS (SELECT bin, r AS peak, CAST(row_number() OVER (ORDER BY bin) - 1 AS INTEGER) AS shell, lead(r) OVER (ORDER BY bin) AS nxt FROM far WHERE g > lo AND g > hi AND g > 0.5),
lw AS (SELECT shell, count(*) AS k, any_value(0.5e0 * (peak + nxt)) AS middle, first(r ORDER BY g, r) AS rr FROM pk JOIN c ON c.r >= peak AND c.r <= nxt GROUP BY shell),
sh AS (SELECT shell, peak, coalesce(CASE WHEN k < 3 THEN middle ELSE rr END, (SELECT max(r) FROM c)) AS outer_r FROM pk LEFT JOIN lw USING (shell)),
s2 AS (SELECT *, coalesce(lag(outer_r) OVER (ORDER BY shell), 0e0) AS inner_r FROM sh),
st AS (SELECT *, lead(r) OVER w AS r2, lead(n) OVER w AS n2 FROM c WINDOW w AS (ORDER BY bin))
SELECT shell, round(peak, 6) AS peak, round(inner_r, 6) AS inner, round(outer_r, 6) AS outer, round(CASE WHEN r2 IS NULL OR outer_r = r THEN n ELSE n + (n2 - n) * (outer_r - r) / (r2 - r) END, 6) AS cn FROM s2 JOIN st ON outer_r >= r AND (outer_r < r2 OR r2 IS NULL)""".replace(" AS inner,", ' AS "inner",').replace(" AS outer,", ' AS "outer",')
)
def rdf_shell_table(spark, sf_dir):
    return D.rdf_shells(_oh_curve(_A(spark, sf_dir))).select("shell", *[_r(c).alias(c) for c in ("peak", "inner", "outer", "cn")])


@query(f"WITH {V.SQL_A}, {V.sql_pairs('pp', chr(97) + '.element = ' + repr('O'), 'b.element = ' + repr('O'), 'a.atom_idx < b.atom_idx')} SELECT frame_id, i AS center, j AS target, round(d, 6) AS d FROM pp WHERE d BETWEEN 25e-1 AND 32e-1")
def pairs_at_distance(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.pairs_at_distance(t.of("O"), t.of("O"), t.frames, 2.5, 3.2, same=True).select("frame_id", "center", "target", _r("d").alias("d"))


@query()
def peak_environments(spark, sf_dir):
    t = _A(spark, sf_dir)
    found = D.peak_environments(t.of("O"), t.of("H"), t.atoms, t.known, t.frames, _oh_curve(t), stride=1, max_neighbors=4)
    return found.withColumns({a: _r(a) for a in "xyz"})


@query()
def shell_environments(spark, sf_dir):
    t = _A(spark, sf_dir)
    found = D.shell_environments(t.of("O"), t.of("H"), t.atoms, t.known, t.frames, _oh_curve(t), stride=1, cumulative=True)
    return found.withColumns({a: _r(a) for a in "xyz"})


@query()
def cluster_projection(spark, sf_dir):
    t = _A(spark, sf_dir)
    found = D.peak_environments(t.of("O"), t.of("H"), t.atoms, t.known, t.frames, _oh_curve(t), stride=1, max_neighbors=4)
    return D.principal_projection(found, ["shell", "cluster"])


_DEG = f"{180.0 / math.pi!r}e0"
_ANGLES = f"""{V.SQL_A}, {V.sql_pairs('pp', "a.element = 'O'", "b.element = 'H'", 'a.mol_id = b.mol_id')},
an AS (SELECT p.frame_id, p.i, acos(greatest(-1e0, least(1e0, (p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / ((p.d + 1e-10) * (q.d + 1e-10))))) AS rad FROM pp p JOIN pp q ON q.frame_id = p.frame_id AND q.i = p.i AND p.j < q.j)"""


@query(f"WITH {_ANGLES} SELECT frame_id, i AS center, round(degrees(rad), 5) AS angle FROM an")
def angles_hoh(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.angles(t.atoms, t.known, t.frames).select("frame_id", "center", _r("angle", 5).alias("angle"))


@query(
    f"""WITH {_ANGLES}, a5 AS (SELECT round(degrees(rad), 5) AS angle FROM an),
h AS (SELECT least(CAST(floor((angle - 0e0) / 2e0) AS INTEGER), 89) AS bin, count(*) AS c FROM a5 WHERE angle >= 0 AND angle <= 180 GROUP BY 1), t AS (SELECT sum(c) AS total FROM h)
SELECT CAST(b AS INTEGER) AS bin, round(0e0 + (b + 0.5e0) * 2e0, 6) AS angle, round(coalesce(c, 0) / (total * 2e0), 6) AS density FROM range(90) AS x(b) LEFT JOIN h ON h.bin = x.b CROSS JOIN t"""
)
def adf_hoh(spark, sf_dir):
    t = _A(spark, sf_dir)
    found = D.angles(t.atoms, t.known, t.frames).withColumn("angle", _r("angle", 5))
    return D.adf(found, 90, 0.0, 180.0).select("bin", _r("angle").alias("angle"), _r("density").alias("density"))


@query(
    f"""WITH {V.SQL_A}, {V.sql_pairs('pp', "a.element = 'O'", "b.element = 'O'", 'a.atom_idx <> b.atom_idx')},
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, i ORDER BY d, j) AS k FROM pp), four AS (SELECT * FROM rk WHERE k <= 4),
ok AS (SELECT frame_id, i FROM four GROUP BY ALL HAVING count(*) = 4 AND max(d) <= 65e-1),
q AS (SELECT a.frame_id, a.i, 1e0 - 375e-3 * sum(((a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (a.d * b.d) + 1e0 / 3e0) ** 2) AS q FROM four a JOIN four b ON b.frame_id = a.frame_id AND b.i = a.i AND a.k < b.k JOIN ok ON ok.frame_id = a.frame_id AND ok.i = a.i GROUP BY ALL)
SELECT fr.frame_id, round(avg(q.q), 6) AS q FROM fr LEFT JOIN q ON q.frame_id = fr.frame_id GROUP BY ALL"""
)
def tetrahedral_order(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.tetrahedral_order(t.atoms, t.frames, rcut=6.5).select("frame_id", _r("q").alias("q"))


_HBONDS = f"""{V.SQL_A}, {V.sql_pairs('pp', "a.element = 'H'", "b.element = 'O'", 'a.mol_id <> b.mol_id')}, hb AS (SELECT frame_id, CAST(3 * mi AS INTEGER) AS donor, i AS h, j AS acceptor FROM pp WHERE d < 24e-1)"""


@query(f"WITH {_HBONDS} SELECT frame_id, donor, h, acceptor FROM hb")
def hbond_list(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.hbonds(t.atoms, t.known, t.frames)


@query(f"WITH {_HBONDS} SELECT fr.frame_id, count(hb.h) AS n FROM fr LEFT JOIN hb ON hb.frame_id = fr.frame_id GROUP BY ALL")
def hbond_count(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.hbond_count(D.hbonds(t.atoms, t.known, t.frames), t.frames)


@query(
    f"""WITH {_HBONDS}, nt AS (SELECT frame_id, count(*) AS n FROM hb GROUP BY 1), f AS (SELECT count(*) AS k FROM fr), lg AS (SELECT CAST(g AS INTEGER) AS lag FROM range(1, 21) AS t(g)),
ov AS (SELECT a.frame_id, lag, count(*) AS o FROM hb a CROSS JOIN lg JOIN hb b ON b.frame_id = a.frame_id + lag AND b.donor = a.donor AND b.h = a.h AND b.acceptor = a.acceptor GROUP BY ALL)
SELECT lag, round(coalesce(sum(coalesce(o, 0) * 1e0 / n) / count(*), 0), 6) AS c FROM lg JOIN nt ON nt.frame_id + lag < (SELECT k FROM f) LEFT JOIN ov USING (lag, frame_id) GROUP BY lag"""
)
def hbond_acf(spark, sf_dir):
    t = _A(spark, sf_dir)
    return C.hbond_acf(D.hbonds(t.atoms, t.known, t.frames), t.frames.count(), 20).select("lag", _r("c").alias("c"))


_ALIGNED = f"""{V.SQL_A}, {V.sql_pairs('pb', "a.element = 'O'", 'b.atom_idx = a.atom_idx + 1')}, {V.sql_pairs('pt', "a.element = 'O'", "b.element = 'H'", 'b.atom_idx <> a.atom_idx + 1')},
u AS (SELECT frame_id, i, dx / d AS ux, dy / d AS uy, dz / d AS uz FROM pb),
al AS (SELECT ux, uy, uz, dx, dy, dz, (uy * dx + (-ux) * dy) / (1e0 + uz) AS k FROM pt JOIN u USING (frame_id, i)),
po AS (SELECT round(dx * uz + (-ux) * dz + uy * k, 7) AS x, round(dy * uz - uy * dz + (-ux) * k, 7) AS y, round(dz * uz + uy * dy - (-ux) * dx, 7) AS z FROM al)"""


def _points(t: _A) -> DataFrame:
    found, _ = D.aligned(t.of("O"), t.of("H"), t.of("H"), t.known, t.frames)
    return found.withColumns({a: _r(a, 7) for a in "xyz"})


def _cell_sql(b0: str, b1: str, where: str) -> str:
    return f"WITH {_ALIGNED} SELECT {b0} AS b0, {b1} AS b1, CAST(count(*) AS DOUBLE) AS w FROM po WHERE {where} GROUP BY ALL"


def _bin_sql(value: str, low: float, high: float, bins: int) -> str:
    return f"least(CAST(floor(({value} - {low!r}e0) / {(high - low) / bins!r}e0) AS INTEGER), {bins - 1})"


@query(_cell_sql(_bin_sql("x", -5.0, 5.0, 20), _bin_sql("z", -5.0, 5.0, 20), "x BETWEEN -5 AND 5 AND z BETWEEN -5 AND 5"))
def sdf_planar(spark, sf_dir):
    return D.project(_points(_A(spark, sf_dir)), "xz", bins=20)


@query(_cell_sql(_bin_sql("z", -5.0, 5.0, 20), _bin_sql("sqrt(x * x + y * y)", 0.0, 5.0, 20), "z BETWEEN -5 AND 5 AND sqrt(x * x + y * y) <= 5"))
def sdf_cylindrical(spark, sf_dir):
    return D.project(_points(_A(spark, sf_dir)), "cylindrical", bins=20)


_RR = "sqrt(x * x + y * y + z * z)"


@query(_cell_sql(_bin_sql(_RR, 0.0, 5.0, 20), _bin_sql(f"acos(greatest(-1e0, least(1e0, z / {_RR})))", 0.0, math.pi, 20), f"{_RR} <= 5"))
def sdf_spherical(spark, sf_dir):
    return D.project(_points(_A(spark, sf_dir)), "spherical", bins=20)


@query()
def sdf_symmetry(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.spatial_densities(t.of("O"), t.of("H"), t.of("O"), t.known, t.frames, "C2v", second=t.of("H"), bins=20)[0]


@query(f"WITH {V.SQL_A}, {V.sql_pairs('pb', chr(97) + '.element = ' + repr('O'), 'b.atom_idx = a.atom_idx + 1')} SELECT count(*) AS n_center, round(avg(d), 6) AS mean_bond_len FROM pb")
def sdf_meta(spark, sf_dir):
    t = _A(spark, sf_dir)
    return D.aligned(t.of("O"), t.of("H"), t.of("H"), t.known, t.frames)[1].select("n_center", _r("mean_bond_len").alias("mean_bond_len"))


@query(
    f"WITH {_ALIGNED}, h AS (SELECT {_bin_sql('z', -5.0, 5.0, 20)} AS b0, {_bin_sql('sqrt(x * x + y * y)', 0.0, 5.0, 20)} AS b1, count(*) AS c FROM po WHERE z BETWEEN -5 AND 5 AND sqrt(x * x + y * y) <= 5 GROUP BY ALL) "
    f"SELECT b0, b1, round(c / (100e0 * (2e0 * {math.pi!r}e0 * ((b1 + 0.5e0) * 25e-2) * 25e-2 * 5e-1)), 6) AS w FROM h"
)
def sdf_normalized(spark, sf_dir):
    cells = D.project(_points(_A(spark, sf_dir)), "cylindrical", bins=20)
    return D.density_normalized(cells, "cylindrical", 100, bins=20).select("b0", "b1", _r("w").alias("w"))


# -- states of atoms

_HOST = f"""{V.SQL_A}, {V.sql_pairs('pp', "a.element = 'H'", "b.element = 'O'")}, nr AS (SELECT frame_id, i, j, row_number() OVER (PARTITION BY frame_id, i ORDER BY d, j) AS k FROM pp WHERE d < 125e-2),
st AS (SELECT va.atom_idx AS entity, va.frame_id AS t, nr.j AS state FROM va LEFT JOIN nr ON nr.frame_id = va.frame_id AND nr.i = va.atom_idx AND nr.k = 1 WHERE va.element = 'H')"""


@query(f"WITH {_HOST} SELECT entity, t, state FROM st")
def nearest_host_state(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.nearest_host(t.of("H"), t.of("O"), t.frames, 1.25)


@query(f"WITH {V.sql_track(_HOST, 1)} SELECT entity, t, from_state, to_state FROM tr")
def atom_hop(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.atom_hop(t.atoms, t.frames)[0]


@query(f"WITH {V.sql_track(_HOST, 2)} SELECT entity, t, from_state, to_state FROM tr")
def atom_hop_persist2(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.atom_hop(t.atoms, t.frames, persistence=2)[0]


@query(
    RECURSIVE
    + ", "
    + V.sql_track(_HOST.replace(V.SQL_A + ", ", "", 1), 1)
    + """, hs AS (SELECT tr.entity, tr.t, va.x, va.y, va.z FROM tr JOIN va ON va.frame_id = tr.t AND va.atom_idx = tr.from_state),
dd AS (SELECT entity, t, (cx - x) - l * round_even((cx - x) / l, 0) AS ex, (cy - y) - l * round_even((cy - y) / l, 0) AS ey, (cz - z) - l * round_even((cz - z) / l, 0) AS ez FROM hs JOIN mols ON mols.frame_id = hs.t AND formula = 'HO' JOIN fr ON fr.frame_id = hs.t)
SELECT entity, t, round(min(sqrt(ex * ex + ey * ey + ez * ez)), 6) AS distance FROM dd GROUP BY ALL"""
)
def hop_species_distance(spark, sf_dir):
    t = _A(spark, sf_dir)
    hops = R.atom_hop(t.atoms, t.frames)[0]
    return R.hop_species_distances(hops, t.atoms, t.mols, t.frames).select("entity", "t", _r("distance").alias("distance"))


@query(f"WITH {V.sql_track(_HOST, 1)} SELECT host, count(*) AS n FROM (SELECT from_state AS host FROM tr UNION ALL SELECT to_state FROM tr) WHERE host IS NOT NULL GROUP BY host ORDER BY n DESC, host LIMIT 5")
def hop_involvement_topk(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.hop_involvement(R.atom_hop(t.atoms, t.frames)[0], 5)


@query(f"WITH {V.sql_track(_HOST, 1)} SELECT CAST(floor(t / 50.0) AS INTEGER) AS bin, count(*) AS n FROM tr GROUP BY 1")
def hop_rate_hist(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.hop_rate(R.atom_hop(t.atoms, t.frames)[0], 50)


@query(RECURSIVE + ", c AS (SELECT mol_id AS entity, frame_id AS t, formula AS to_state, lag(formula) OVER (PARTITION BY mol_id ORDER BY frame_id) AS from_state FROM mols) SELECT entity, t, from_state, to_state FROM c WHERE from_state IS NOT NULL AND from_state <> to_state")
def ligand_exchange(spark, sf_dir):
    return R.ligand_exchange(_A(spark, sf_dir).mols)


@query(
    RECURSIVE
    + ", sx AS (SELECT frame_id, mol_id, string_agg(element, ',' ORDER BY element) AS s FROM ma GROUP BY ALL), c AS (SELECT atom_idx AS entity, ma.frame_id AS t, s AS to_state, lag(s) OVER (PARTITION BY atom_idx ORDER BY ma.frame_id) AS from_state FROM ma JOIN sx ON sx.frame_id = ma.frame_id AND sx.mol_id = ma.mol_id WHERE element = 'O') SELECT entity, t, from_state, to_state FROM c WHERE from_state IS NOT NULL AND from_state <> to_state"
)
def coordination_dynamics(spark, sf_dir):
    t = _A(spark, sf_dir)
    return R.coordination_dynamics(t.atoms, t.topo)


# -- presence, states and block statistics over events

_SEG = f"WITH {V.SQL_PRESENCE} "


def _segments(spark, sf_dir) -> DataFrame:
    return R.lifetime_segments(V.presence(spark, sf_dir))


@query(_SEG + "SELECT formula, segment, start, stop FROM seg")
def lifetime_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(_SEG + f"SELECT formula, round(sum(stop - start) / {float(V.SERIES_FRAMES)}e0, 6) AS fraction FROM seg GROUP BY 1")
def presence_fraction(spark, sf_dir):
    return R.presence_fraction(_segments(spark, sf_dir), V.SERIES_FRAMES).select("formula", _r("fraction").alias("fraction"))


@query(_SEG + f"SELECT formula, count(*) AS n_events, round(avg((stop - start) * 5e-1), 6) AS mean_lifetime, round(median((stop - start) * 5e-1), 6) AS median_lifetime, round(count(*) / {V.SERIES_FRAMES * 0.5}e0, 6) AS rate FROM seg GROUP BY 1")
def reaction_kinetics(spark, sf_dir):
    found = R.reaction_kinetics(_segments(spark, sf_dir), V.SERIES_FRAMES, 0.5)
    return found.select("formula", "n_events", *[_r(c).alias(c) for c in ("mean_lifetime", "median_lifetime", "rate")])


@query(_SEG + f"SELECT formula, segment, stop AS boundary, greatest(0, stop - 10) AS first, least({V.SERIES_FRAMES}, stop + 10) AS stop FROM seg")
def reaction_window(spark, sf_dir):
    return R.reaction_windows(_segments(spark, sf_dir), V.SERIES_FRAMES, 10, "death")


@query(_SEG + "SELECT DISTINCT CAST(f AS INTEGER) AS frame_id FROM seg, range(4320) AS t(f) WHERE formula = (SELECT min(formula) FROM seg) AND segment = 3 AND f >= start AND f < stop")
def segment_frames(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    first = segments.agg(F.min("formula")).first()[0]
    frames = spark.range(V.SERIES_FRAMES).select(F.col("id").cast("int").alias("frame_id"))
    return R.segment_frames(frames, segments, first, 3, missing="empty")


@query(f"WITH {V.sql_track(V.SQL_STATES, 1)} SELECT entity, t, from_state, to_state FROM tr")
def state_transitions(spark, sf_dir):
    return R.changes(V.states(spark, sf_dir))


@query(f"WITH {V.sql_track(V.SQL_STATES, 2)} SELECT entity, t, from_state, to_state FROM tr")
def tracker_persistence(spark, sf_dir):
    return R.track(V.states(spark, sf_dir), 2)[0]


@query(
    f"WITH {V.sql_track(V.SQL_STATES, 2)}, cu AS (SELECT entity, max(t) AS since, arg_max(to_state, t) AS now FROM tr GROUP BY 1), fi AS (SELECT entity, t, state FROM ms WHERE n = 1), "
    "bo AS (SELECT fi.entity, coalesce(since, fi.t) AS since, coalesce(now, state) AS now FROM fi LEFT JOIN cu USING (entity)) SELECT ms.entity, count(*) FILTER (ms.t > since AND ms.state = now) AS residence FROM ms JOIN bo USING (entity) GROUP BY 1"
)
def residence_times(spark, sf_dir):
    return R.track(V.states(spark, sf_dir), 2)[1]


@query(f"WITH {V.sql_track(V.SQL_STATES, 1)}, l AS (SELECT entity, max(run) AS run FROM ms GROUP BY 1) SELECT ms.entity, count(*) AS residence FROM ms JOIN l ON l.entity = ms.entity AND l.run = ms.run GROUP BY 1")
def last_stays(spark, sf_dir):
    return R.last_stays(V.states(spark, sf_dir))


_HOURLY = f"hr AS (SELECT CAST(floor((epoch_us(ts) - {V.ORIGIN_US}) / {6 * V.FRAME_US}.0) AS INTEGER) AS i, count(*) AS c FROM events GROUP BY 1), se AS (SELECT CAST(b AS INTEGER) AS i, CAST(coalesce(c, 0) AS DOUBLE) AS v FROM range(720) AS t(b) LEFT JOIN hr ON hr.i = t.b)"


@query(
    f"WITH {_HOURLY}, m AS (SELECT i // 24 AS b, avg(v) AS m FROM se GROUP BY 1), c AS (SELECT CAST(b * 24 AS INTEGER) AS start, m, lag(m) OVER (ORDER BY b) AS p, b FROM m), k AS (SELECT start FROM c WHERE b = 0 OR abs(m - p) > 0.5) "
    "SELECT CAST(row_number() OVER (ORDER BY start) - 1 AS INTEGER) AS segment, start, CAST(coalesce(lead(start) OVER (ORDER BY start), 720) AS INTEGER) AS stop FROM k"
)
def count_segments(spark, sf_dir):
    return B.count_segments(V.hourly(spark, sf_dir), 720, 24, 0.5, place="i", value="v")


@query(f"WITH {_HOURLY}, m AS (SELECT i // 24 AS b, avg(v) AS m FROM se GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS stderr, count(*) AS n_blocks FROM m")
def block_average(spark, sf_dir):
    return B.block_average(V.hourly(spark, sf_dir), 24).select(_r("mean").alias("mean"), _r("stderr").alias("stderr"), "n_blocks")


@query(f"WITH {_HOURLY}, m AS (SELECT CAST(s AS INTEGER) AS size, i // s AS b, avg(v) AS m, count(*) AS c FROM se, UNNEST([6, 12, 24, 48, 100]) AS t(s) GROUP BY ALL) SELECT size, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS stderr, count(*) AS n_blocks FROM m WHERE c = size GROUP BY size")
def block_convergence(spark, sf_dir):
    return B.block_convergence(V.hourly(spark, sf_dir), [6, 12, 24, 48, 100]).select("size", _r("mean").alias("mean"), _r("stderr").alias("stderr"), "n_blocks")


def _conv_sql(kernel: list[float], source: str, n: int, mirror: bool) -> str:
    half = len(kernel) // 2
    ws = ", ".join(f"({k - half}, {w!r}e0)" if "e" not in repr(w) else f"({k - half}, {w!r})" for k, w in enumerate(kernel))
    place = f"CASE WHEN (((i + o) % {2 * n} + {2 * n}) % {2 * n}) < {n} THEN ((i + o) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - ((i + o) % {2 * n} + {2 * n}) % {2 * n} END"
    return f"{source}, kn(o, w) AS (VALUES {ws}), sp AS (SELECT i, w, {place} AS q FROM se CROSS JOIN kn), sm AS (SELECT sp.i, sum(w * v) AS s FROM sp JOIN se ON se.i = sp.q GROUP BY sp.i)"


@query(f"WITH {_conv_sql(B.gaussian(5.0), _HOURLY, 720, True)} SELECT i, round(s, 6) AS s FROM sm")
def gaussian_smooth(spark, sf_dir):
    return B.smooth(V.hourly(spark, sf_dir), 720, 5.0).select("i", _r("s").alias("s"))


_SPECTRUM = f"""{_HOURLY}, hn AS (SELECT i, v * (0.5e0 - 0.5e0 * cos(2e0 * {math.pi!r}e0 * i / 719e0)) AS w FROM se), ph AS (SELECT k, w, 2e0 * {math.pi!r}e0 * ((CAST(i AS BIGINT) * k) % 720) / 720e0 AS p FROM hn CROSS JOIN range(361) AS t(k)),
ft AS (SELECT CAST(k AS INTEGER) AS k, sum(w * cos(p)) AS re, sum(w * sin(p)) AS im FROM ph GROUP BY k)"""


@query(f"WITH {_SPECTRUM} SELECT k, round(k / 360e0 / 2998e-8, 4) AS wavenumber, round(re * re + im * im, 3) AS power FROM ft")
def vdos_spectrum(spark, sf_dir):
    return B.spectrum(V.hourly(spark, sf_dir), 720).select("k", _r("wavenumber", 4).alias("wavenumber"), _r("power", 3).alias("power"))


@query(f"WITH {_HOURLY} SELECT i, v FROM se")
def log_round_trip(spark, sf_dir):
    path = sources.scratch(spark, "log")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: F.concat_ws("  ", r["i"], *[F.lit("0.0")] * 7, r["v"]))
    V.hourly(spark, sf_dir).agg(F.concat(F.lit("# a line of names\n"), F.array_join(rows, "\n")).alias("value")).coalesce(1).write.text(path)
    return sources.read_log(spark, path)


@query(f"WITH {_SPECTRUM}, pw AS (SELECT k, re * re + im * im AS power FROM ft), t AS (SELECT max(power) AS top FROM pw WHERE k >= 5) SELECT k, round(power / top, 6) AS power FROM pw CROSS JOIN t")
def vdos_normalized(spark, sf_dir):
    return B.normalized_to_max(B.spectrum(V.hourly(spark, sf_dir), 720), "power", within=F.col("k") >= 5).select("k", _r("power").alias("power"))


@query(f"WITH {_SPECTRUM} SELECT 0 AS series, CAST(k AS BIGINT) AS k, round(k / 360e0 / 2998e-8, 4) AS wavenumber, round(re * re + im * im, 3) AS power FROM ft")
def vdos_fft(spark, sf_dir):
    found = B.spectrum_fft(V.hourly(spark, sf_dir).withColumn("series", F.lit(0)))
    return found.select("series", "k", _r("wavenumber", 4).alias("wavenumber"), _r("power", 3).alias("power"))


# -- walkers

_LAGS = list(range(1, 11))
_DISP = f"{V.SQL_WALK}, lg AS (SELECT CAST(g AS INTEGER) AS lag FROM range(1, 11) AS t(g)), dp AS (SELECT a.track, a.idx, lag, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM wk a CROSS JOIN lg JOIN wk b ON b.track = a.track AND b.idx = a.idx + lag)"


def _tracks(spark, sf_dir) -> DataFrame:
    return V.walk(spark, sf_dir).select("track", "idx", "x", "y", "z")


@query(f"WITH {_DISP} SELECT lag, round(avg(d2) / 1e6, 6) AS msd, count(*) AS n FROM dp GROUP BY lag")
def msd(spark, sf_dir):
    return C.pooled_msd(_tracks(spark, sf_dir), 10).select("lag", _r(F.col("msd") / 1e6).alias("msd"), "n")


@query(f"WITH {_DISP} SELECT track, lag, round(avg(d2) / 1e6, 6) AS msd, count(*) AS n FROM dp GROUP BY ALL")
def msd_per_track(spark, sf_dir):
    return C.track_msd(_tracks(spark, sf_dir), 10).select("track", "lag", _r(F.col("msd") / 1e6).alias("msd"), "n")


@query(
    f"WITH {_DISP}, ln AS (SELECT track, count(*) // 50 * 50 AS full_len FROM wk GROUP BY 1), bl AS (SELECT track, idx // 50 AS b, lag, avg(d2) AS m FROM dp JOIN ln USING (track) WHERE idx + lag < full_len AND idx // 50 = (idx + lag) // 50 GROUP BY ALL) "
    "SELECT lag, round(avg(m) / 1e6, 6) AS msd, count(*) AS n, round(stddev_samp(m) / sqrt(count(*)) / 1e6, 6) AS stderr FROM bl GROUP BY lag"
)
def msd_block_stderr(spark, sf_dir):
    return C.block_msd(_tracks(spark, sf_dir), 10, 50).select("lag", _r(F.col("msd") / 1e6).alias("msd"), "n", _r(F.col("stderr") / 1e6).alias("stderr"))


@query(f"WITH {_DISP}, m AS (SELECT lag, avg(d2) / 1e6 AS msd FROM dp GROUP BY lag) SELECT round(regr_slope(msd, CAST(lag AS DOUBLE)) / 6e0, 6) AS diffusion FROM m WHERE lag >= 2")
def diffusion_coefficient(spark, sf_dir):
    curve = C.pooled_msd(_tracks(spark, sf_dir), 10).withColumn("msd", F.col("msd") / 1e6)
    return B.slope_over_six(curve, low=2).select(_r("diffusion").alias("diffusion"))


@query(f"WITH {_DISP}, m AS (SELECT track, lag, avg(d2) AS msd FROM dp GROUP BY ALL) SELECT track, round(regr_slope(msd, CAST(lag AS DOUBLE)) / 6e0, 3) AS diffusion FROM m GROUP BY track")
def diffusion_per_track(spark, sf_dir):
    return C.diffusion_per_track(_tracks(spark, sf_dir), 10).select("track", _r("diffusion", 3).alias("diffusion"))


@query(
    f"WITH {_DISP}, m AS (SELECT lag, avg(d2) / 1e6 AS msd, row_number() OVER (ORDER BY lag) - 1 AS k FROM dp GROUP BY lag), w AS (SELECT s, regr_slope(ln(msd), ln(CAST(lag AS DOUBLE))) AS alpha, regr_r2(ln(msd), ln(CAST(lag AS DOUBLE))) AS r2, min(lag) AS first, max(lag) AS last FROM m JOIN range(7) AS t(s) ON k >= s AND k < s + 4 GROUP BY s) "
    "SELECT first, last, first AS onset, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM w ORDER BY abs(alpha - 1) / greatest(r2, 1e-6), s LIMIT 1"
)
def diffusive_window(spark, sf_dir):
    curve = C.pooled_msd(_tracks(spark, sf_dir), 10).withColumn("msd", F.col("msd") / 1e6)
    return C.diffusive_window(curve).select("first", "last", "onset", _r("alpha").alias("alpha"), _r("r2").alias("r2"))


_VH = f"""{_DISP}, bn AS (SELECT lag, least(CAST(floor(sqrt(d2) / 100e0) AS INTEGER), 29) AS bin, count(*) AS c FROM dp WHERE lag IN (1, 5, 10) AND sqrt(d2) <= 3000 GROUP BY ALL), tn AS (SELECT lag, CAST(sum(c) AS BIGINT) AS n FROM bn GROUP BY 1),
vh AS (SELECT lag, CAST(b AS INTEGER) AS bin, (b + 0.5e0) * 100e0 AS r, coalesce(c, 0) / (n * 100e0) AS p, n FROM tn CROSS JOIN range(30) AS t(b) LEFT JOIN bn ON bn.lag = tn.lag AND bn.bin = t.b)"""
_VH = _VH.replace("SELECT lag, CAST(b", "SELECT tn.lag, CAST(b")


def _van_hove(spark, sf_dir) -> DataFrame:
    return C.van_hove(_tracks(spark, sf_dir), (1, 5, 10), rmax=3000.0, dr=100.0)


@query(f"WITH {_VH} SELECT lag, bin, r, round(p, 9) AS p, n FROM vh")
def van_hove(spark, sf_dir):
    return _van_hove(spark, sf_dir).select("lag", "bin", "r", _r("p", 9).alias("p"), "n")


def _vh_conv(weights: str) -> str:
    """sm(lag, bin, s): the curves convolved, mirrored at the ends, with kn(lag, o, w) as weights gives it."""
    place = "((bin + o) % 60 + 60) % 60"
    return f"""WITH {_VH}, kn AS ({weights}), sp AS (SELECT vh.lag, bin, w, CASE WHEN {place} < 30 THEN {place} ELSE 59 - {place} END AS q FROM vh JOIN kn ON kn.lag = vh.lag),
sm AS (SELECT sp.lag, sp.bin, sum(w * p) AS s FROM sp JOIN vh ON vh.lag = sp.lag AND vh.bin = sp.q GROUP BY ALL)"""


def _fixed(kernel: list[float]) -> str:
    half = len(kernel) // 2
    return f"SELECT lag, o, w FROM tn, (VALUES {', '.join(f'({k - half}, CAST({w!r} AS DOUBLE))' for k, w in enumerate(kernel))}) AS v(o, w)"


_SCOTT = """SELECT lag, o, exp(-5e-1 * power(o / sg, 2)) / sum(exp(-5e-1 * power(o / sg, 2))) OVER (PARTITION BY lag) AS w
FROM (SELECT lag, greatest(1.06e0 * stddev_pop(sqrt(d2)) * power(count(*), -0.2e0) / 100e0, 5e-1) AS sg FROM dp WHERE lag IN (1, 5, 10) GROUP BY lag) AS q, range(-4000, 4001) AS t(o) WHERE abs(o) <= CAST(floor(4e0 * sg + 5e-1) AS BIGINT)"""


@query(f"{_vh_conv(_SCOTT)} SELECT sm.lag, sm.bin, r, round(s / (sum(s) OVER (PARTITION BY sm.lag) * 100e0), 9) AS p, n FROM sm JOIN vh ON vh.lag = sm.lag AND vh.bin = sm.bin")
def van_hove_kde(spark, sf_dir):
    return C.van_hove_kde(_van_hove(spark, sf_dir), _tracks(spark, sf_dir), 100.0).select("lag", "bin", "r", _r("p", 9).alias("p"), "n")


@query(
    f"{_vh_conv(_fixed(B.gaussian(2.0)))}, nb AS (SELECT lag, bin, s, lag(s) OVER w AS lo, lead(s) OVER w AS hi, row_number() OVER (PARTITION BY lag ORDER BY s DESC, bin) AS k FROM sm WINDOW w AS (PARTITION BY lag ORDER BY bin)) "
    "SELECT lag, round((bin + 0.5e0) * 100e0 + CASE WHEN lo IS NULL OR hi IS NULL OR lo - 2 * s + hi = 0 THEN 0e0 ELSE 0.5e0 * (lo - hi) / (lo - 2 * s + hi) END * 100e0, 4) AS peak FROM nb WHERE k = 1"
)
def van_hove_peaks(spark, sf_dir):
    return C.van_hove_peaks(_van_hove(spark, sf_dir), 100.0).select("lag", _r("peak", 4).alias("peak"))


@query(
    f"{_vh_conv(_fixed(B.savgol_second(9, 3, 100.0)))}, tp AS (SELECT lag, max(p) AS top FROM vh GROUP BY lag) "
    "SELECT vh.lag, vh.bin, r, round(p / top, 9) AS p, round(CASE WHEN p >= 5e-2 * top THEN s END * 1e6, 6) AS d2 FROM vh JOIN sm ON sm.lag = vh.lag AND sm.bin = vh.bin JOIN tp ON tp.lag = vh.lag"
)
def van_hove_map(spark, sf_dir):
    found = C.van_hove_map(_van_hove(spark, sf_dir), 100.0)
    return found.select("lag", "bin", "r", _r("p", 9).alias("p"), _r(F.col("d2") * 1e6).alias("d2"))


def _walk_frames(spark, sf_dir) -> DataFrame:
    length = float(V.WALK_BOX)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), *[F.lit(length).alias(c) for c in ("lx", "ly", "lz")])


def _wrapped(spark, sf_dir) -> DataFrame:
    return V.walk(spark, sf_dir).select(F.col("track").alias("atom_idx"), F.col("idx").alias("frame_id"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))


_UNWRAPPED = f"""{V.SQL_WALK}, f0 AS (SELECT track, x AS x0, y AS y0, z AS z0 FROM wk WHERE idx = (SELECT min(idx) FROM wk)),
un AS (SELECT track AS atom_idx, idx AS frame_id, {", ".join(f"CAST({a} - {a}0 + (({a}0 % {V.WALK_BOX}) + {V.WALK_BOX}) % {V.WALK_BOX} AS DOUBLE) AS {a}" for a in "xyz")} FROM wk JOIN f0 USING (track))"""


@query(f"WITH {_UNWRAPPED} SELECT atom_idx, frame_id, x, y, z FROM un")
def unwrap_positions(spark, sf_dir):
    return K.unwrap(_wrapped(spark, sf_dir), _walk_frames(spark, sf_dir))


@query(f"WITH {_UNWRAPPED} SELECT atom_idx, frame_id, x, y, z FROM un")
def unwrap_in_order(spark, sf_dir):
    return K.unwrap_in_order(_wrapped(spark, sf_dir), _walk_frames(spark, sf_dir))


@query(f"WITH {_UNWRAPPED}, rf AS (SELECT frame_id, {', '.join(f'{a} AS r{a}' for a in 'xyz')} FROM un WHERE atom_idx = 0) SELECT frame_id, atom_idx, {', '.join(f'round({a} + ({V.WALK_BOX / 2!r}e0 - r{a}), 6) AS {a}' for a in 'xyz')} FROM un JOIN rf USING (frame_id)")
def recenter(spark, sf_dir):
    own = _wrapped(spark, sf_dir).withColumn("element", F.lit("O"))
    return K.recenter(own, _walk_frames(spark, sf_dir), center_atoms=[0]).select("frame_id", "atom_idx", *[_r(a).alias(a) for a in "xyz"])


_NEAR = ", ".join(f"round(CASE WHEN b.atom_idx % 3 = 0 THEN b.{a} ELSE a.{a} + ((b.{a} - a.{a}) - l * round_even((b.{a} - a.{a}) / l, 0)) END, 6) AS {a}" for a in "xyz")


@query(f"WITH {V.SQL_A} SELECT frame_id, b.atom_idx, b.element, b.mol_id, {_NEAR} FROM va b JOIN va a USING (frame_id, mol_id) JOIN fr USING (frame_id) WHERE a.atom_idx % 3 = 0")
def make_whole(spark, sf_dir):
    t = _A(spark, sf_dir)
    return K.make_whole(t.atoms, t.known, t.frames).select("frame_id", "atom_idx", "element", "mol_id", *[_r(a).alias(a) for a in "xyz"])


_WHOLE = ", ".join(f"CASE WHEN b.atom_idx % 3 = 0 THEN b.{a} ELSE a.{a} + ((b.{a} - a.{a}) - l * round_even((b.{a} - a.{a}) / l, 0)) END AS {a}" for a in "xyz")


@query(
    f"WITH {V.SQL_A}, wh AS (SELECT frame_id, b.atom_idx, b.element, b.mol_id, {_WHOLE} FROM va b JOIN va a USING (frame_id, mol_id) JOIN fr USING (frame_id) WHERE a.atom_idx % 3 = 0), "
    f"ce AS (SELECT frame_id, {', '.join(f'avg({a}) AS c{a}' for a in 'xyz')} FROM wh WHERE atom_idx IN (0, 1, 2) GROUP BY 1) SELECT frame_id, atom_idx, element, mol_id, {', '.join(f'round({a} - c{a}, 6) AS {a}' for a in 'xyz')} FROM wh JOIN ce USING (frame_id)"
)
def vacuum_clusters(spark, sf_dir):
    t = _A(spark, sf_dir)
    return K.vacuum(t.atoms, t.known, t.frames, center_atoms=[0, 1, 2]).select("frame_id", "atom_idx", "element", "mol_id", *[_r(a).alias(a) for a in "xyz"])


@query()
def cluster_around(spark, sf_dir):
    t = _A(spark, sf_dir)
    return K.cluster_around(t.atoms, t.known, t.frames, center_atoms=[0])


def _walk_mols(spark, sf_dir) -> DataFrame:
    return _wrapped(spark, sf_dir).select("frame_id", F.col("atom_idx").alias("mol_id"), F.lit("W").alias("formula"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))


@query()
def tracks_greedy(spark, sf_dir):
    mols = _walk_mols(spark, sf_dir)
    return K.greedy_tracks(mols, R.lifetime_segments(mols), _walk_frames(spark, sf_dir))


@query()
def stitch_tracks(spark, sf_dir):
    mols = _walk_mols(spark, sf_dir).filter("frame_id % 40 < 37")
    segments, frames = R.lifetime_segments(mols), _walk_frames(spark, sf_dir)
    return K.stitch(K.greedy_tracks(mols, segments, frames), mols, segments, frames, "W", max_gap=5, max_jump=3000.0)[1]
