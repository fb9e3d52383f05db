"""Cases of the third round's findings."""

import duckdb
import numpy as np
import pytest
from oracle_check import compare, connect

from foldframe import constants as K
from foldframe.catalog import load
from foldframe.operators import checks as C
from foldframe.operators import potential as P
from foldframe.operators import secondary as SS
from foldframe.plans.fixtures import keeping_sign
from foldframe.sources import structures as S
from foldframe.sources import writers as WR

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", ["summary_json", "summary_report", "level_summary"])
def test_summaries_match_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]).startswith("ok")


def test_zero_keeps_its_sign(spark):
    """Coordinates that round to zero from below are written as -0.000, as the SQL twin of write_cleaned_structure does."""
    text = "select round(v, 3) as v, round(round(v, 3) + 0.3e0, 3) as w from (select -0.0004e0 as v union all select 0.0004e0 union all select -1.2345e0) t"
    got = sorted(map(repr, map(tuple, spark.sql(keeping_sign(text)).collect())))
    assert got == sorted(map(repr, duckdb.sql(text).fetchall()))
    assert "(-0.0, 0.3)" in got


@pytest.mark.parametrize("name", ["scan_manifest", "header_metadata"])
def test_structures_beyond_three_digits(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"""copy (select 16 * k + vec_id as vec_id, embedding, label from '{SF}/embeddings.parquet', (select unnest([0, 7, 74, 748, 749, 1000, 7480, 7490, 7491, 12347]) as k)
        where vec_id < 16) to '{tmp_path}/embeddings.parquet'""")
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]).startswith("ok")


def test_accessibility_across_blocks(spark):
    """Areas found block by block equal those over all atoms at once, and no pair of atoms becomes a row."""
    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(-90, 90, (1500, 3)), 3)
    xyz[700:] = np.round(xyz[rng.integers(0, 700, 800)] + rng.uniform(-4, 4, (800, 3)), 3)
    atoms = spark.createDataFrame([("s", 1, "s_1_A", i // 3, ("N", "CA", "CB")[i % 3], "C", i, *map(float, p)) for i, p in enumerate(xyz)],
                                  "structure_id string, model int, ck string, res_num int, atom_name string, element string, serial int, x double, y double, z double")
    found = C.solvent_accessibility(atoms)
    rad = np.array([K.RADII.get(("N", "CA", "CB")[i % 3], K.RADIUS_SIDE) + K.RADIUS_WATER for i in range(len(xyz))])
    points, want = np.array(C.sphere_points()), {}
    for i, p in enumerate(xyz):
        gap = xyz - p
        d2 = (gap ** 2).sum(axis=1)
        met = (d2 > 1e-6) & (d2 < (rad[i] + rad) ** 2)
        hidden = (points[:, :3] @ gap[met].T > (rad[i] ** 2 - rad[met] ** 2 + d2[met]) / (2 * rad[i])).any(axis=1)
        want[i // 3] = want.get(i // 3, 0.0) + points[~hidden, 3].sum() * rad[i] ** 2
    assert {r.res_num: r.area for r in found.collect()} == {k: int(v + 0.5) for k, v in want.items()}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_met_once(spark):
    """Frequencies need the pairs once, and no condition on the pair key is copied into the join of cells."""
    atoms = spark.createDataFrame([("s", "A", "s_A", i, "GCA" if i % 2 else "ACA", 1.7 * i, 0.0, 0.0) for i in range(40)],
                                  "structure_id string, chain string, ck string, res_num int, atom_type string, x double, y double, z double")
    pairs = P.pair_distances(atoms)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = P.pair_frequencies(P.distance_histogram(pairs))
    assert plan(found).count("Join") == 1
    joins = [line for line in plan(P.missing_pairs(pairs)).split("\n") if "Join Inner" in line]
    assert len(joins) == 1 and "CASE" not in joins[0]
    rows = [(r.pair, r.bin, r.n) for r in found.where("n > 0").collect()]
    assert sum(n for *_, n in rows) == pairs.count() and {r.pair for r in found.collect()} == {"ACAACA", "ACAGCA", "GCAGCA"}
    assert found.count() == 450


def test_neighbours_join_holds_cells_only(spark):
    """Only the centres' atoms are repeated into neighbouring cells, and the test on CA distances stays out of the join of cells."""
    rng = np.random.default_rng(5)
    xyz = np.round(rng.uniform(-9, 9, (240, 3)), 3)
    rows = [("s", f"s_{i % 2}", i // 4, ("N", "CA")[i // 2 % 2], *map(float, p)) for i, p in enumerate(xyz)]
    atoms = spark.createDataFrame(rows, "structure_id string, ck string, res_num int, atom_name string, x double, y double, z double")
    found = C.neighbours_around(atoms, atoms.where("res_num % 5 = 0").select("ck", "res_num"), 4.0, 6.0)
    ca = {(r[1], r[2]): xyz[i] for i, r in enumerate(rows) if r[3] == "CA"}
    at = [(r[1], r[2]) for r in rows]
    want = {(*at[i], *at[j]) for i in range(240) for j in range(240) if at[i][1] % 5 == 0 and at[i] != at[j] and np.linalg.norm(xyz[i] - xyz[j]) <= 4.0
            and np.linalg.norm(ca[at[i]] - ca[at[j]]) <= 6.0}
    got = [(r.centre_ck, r.centre, r.ck, r.res_num) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    cells = [line for line in plan if "Join Inner" in line and "_gx" in line]
    assert len(cells) == 1 and "6.0" not in cells[0]
    assert sum("Generate explode" in line for line in plan) == 4  # three steps of the cells and one above the join


def test_sheets_of_long_chains_of_ladders(spark):
    """A sheet of many ladders, each touching the next only, is found without a round per ladder; heads link ladders that share no residue."""
    rows = [("a", k, "A", 10 * k, 10 * k + 3, 10 * k + 10, 10 * k + 13, k) for k in range(40)]
    rows += [("b", 0, "P", 0, 2, 50, 52, 0), ("b", 1, "P", 100, 102, 150, 152, 1), ("b", 2, "P", 4, 5, 54, 55, 0)]
    linked = spark.createDataFrame(rows, "ck string, ladder int, kind string, ib int, ie int, jb int, je int, head int")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sheets", "sheets")
    found = SS.sheets(linked)
    assert not jobs.getJobIdsForGroup("sheets")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.ck, r.ladder): (r.sheet, r.strand) for r in found.collect()}
    assert {v[0] for k, v in got.items() if k[0] == "a"} == {"A"} and len({v[1] for k, v in got.items() if k[0] == "a"}) == 40
    assert [got["b", k] for k in range(3)] == [("A", "a"), ("B", "b"), ("A", "a")]


def test_bond_energy_fits_compiled_methods(spark):
    """Bond distances and energies are staged by generators, and equal the formula."""
    rng = np.random.default_rng(11)
    xyz = np.round(rng.uniform(0, 9, (30, 4, 3)), 3)
    point = lambda p: tuple(map(float, p))
    kind = "struct<x:double,y:double,z:double>"
    res = spark.createDataFrame([("a", i, "P" if i % 7 == 3 else "G", *map(point, p), 0) for i, p in enumerate(xyz)], f"ck string, idx int, aa string, n {kind}, ca {kind}, c {kind}, o {kind}, frag int")
    found = SS.hbond_energy(res)
    want, gap = {}, lambda p, q: float(np.sqrt(((p - q) ** 2).sum()))
    for i in range(30):
        co = xyz[i - 1, 2] - xyz[i - 1, 3]
        h = xyz[i, 0] + co / np.sqrt((co ** 2).sum()) if i and i % 7 != 3 else xyz[i, 0]
        for j in range(30):
            if j in (i, i + 1) and j == i or j == i - 1 or i % 7 == 3 or gap(xyz[i, 1], xyz[j, 1]) >= K.HB_CA_DIST:
                continue
            ho, hc, nc, no = gap(h, xyz[j, 3]), gap(h, xyz[j, 2]), gap(xyz[i, 0], xyz[j, 2]), gap(xyz[i, 0], xyz[j, 3])
            e = K.HB_LOW if min(ho, hc, nc, no) < K.HB_MIN_DIST else max(K.HB_LOW, int(np.floor(K.HB_Q / ho - K.HB_Q / hc + K.HB_Q / nc - K.HB_Q / no + 0.5)))
            if e < 0:
                want.setdefault(i, []).append((e, j))
    assert {(r.donor, r.rk): (r.e, r.acceptor) for r in found.collect()} == {(i, k + 1): v for i, vs in want.items() for k, v in enumerate(sorted(vs)[:2])}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") >= 5


def test_model_number_is_read_once_a_model(spark, tmp_path):
    """The number of a model and the mark of a report are found below the generator that deals out lines, not beside each line."""
    (tmp_path / "s.pdb").write_text("HEADER\nMODEL        3\nATOM one\nATOM two\nENDMDL\nMODEL        7\nATOM three\nENDMDL\nEND\n")
    found = S.structure_lines(spark, str(tmp_path))
    assert sorted((r.model, r.line) for r in found.where("line like 'ATOM%'").collect()) == [(3, "ATOM one"), (3, "ATOM two"), (7, "ATOM three")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text("A-index = ++\n2 |30 |1-30;61-90 31-60|0.5|***|\nALTERNATIVES\n1 |90 |1-90|0.25|n/a|\n")
    told = S.scan_assignments(spark, str(tmp_path / "r"))
    assert sorted((r.structure_id, r.ambiguity, r.n, r.quality) for r in told.collect()) == [("a", 2, 1, None), ("a", 2, 2, 3)]
    for frame, text in ((found, "MODEL"), (told, "A-index")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString().split("\n")
        lines = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
        assert [i > lines for i, line in enumerate(plan) if text in line] == [True]


def test_mmcif_lines_sort_by_number(spark):
    """Lines of an mmCIF file are in order of a number, head first and end last, whatever the size of model and serial."""
    cols = "structure_id string, model int, serial int, record string, element string, atom_name string, alt_loc string, res_name string, chain string, res_num int, icode string, x double, y double, z double, occ double, bfac double"
    rows = [("s", m, k, "ATOM", "C", "CA", " ", "GLY", "A", 1, " ", 0.0, 0.0, 0.0, 1.0, 0.0) for m, k in ((10, 5), (2, 1000000000), (2, 999999999), (1000000, 1))]
    text = WR.mmcif_text(spark.createDataFrame(rows, cols))
    assert dict(text.dtypes)["pos"] == "bigint"
    got = "\n".join(r.value for r in text.orderBy("pos").collect()).split("\n")
    got = [v for k, v in enumerate(got) if k == 0 or v == "#" and k > 1 or v.startswith("ATOM")]
    assert got[0].startswith("data_s") and got[-1] == "#"
    assert [(int(v.split()[-1]), int(v.split()[1])) for v in got[1:-1]] == [(2, 999999999), (2, 1000000000), (10, 5), (1000000, 1)]
