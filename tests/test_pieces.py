"""Pair joins, potentials, secondary structure and cleaning on planted inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.functions.spatial import near_self_pairs, tiled_pairs
from foldframe.operators import chain as CH
from foldframe.operators import checks as CK
from foldframe.operators import clean as C
from foldframe.operators import potential as P
from foldframe.operators import secondary as SS


def test_tiles_give_every_pair_once(spark):
    rows = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(4)], "ck string, idx int")
    got = sorted((r.ck, r.l.idx, r.r.idx) for r in tiled_pairs(rows, ["ck"], "idx", tile=5).collect())
    assert got == sorted([("a", i, j) for i in range(23) for j in range(i, 23)] + [("b", i, j) for i in range(4) for j in range(i, 4)])


def test_grid_pairs_match_brute_force(spark):
    xyz = np.random.default_rng(0).uniform(-20, 20, (150, 3))
    rows = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(xyz)], "ck string, idx int, x double, y double, z double")
    got = {(r.l.idx, r.r.idx) for r in near_self_pairs(rows, ["ck"], ["idx"], 7.0, F.lit(True)).collect()}
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] < 7}


def loop_corrections(e, cap=10.0):
    e = list(e)
    n = len(e)
    for i in range(1, n - 1):
        if e[i] == cap and e[i - 1] != cap:
            if e[i + 1] != cap:
                e[i] = (e[i - 1] + e[i + 1]) / 2
            else:
                e[i - 1] = cap
    for i in range(1, n):
        if e[i] == cap and e[i - 1] != cap:
            e[i] = 0.0
    return e


def test_energy_corrections(spark):
    rng = np.random.default_rng(5)
    cases = [[10, 10, 1, 10, 2, 10, 10, 3]] + [[float(v) for v in rng.choice([10, 10, 1, 2, 3], 8)] for _ in range(40)]
    rows = [(f"p{k:02d}", b, 0.0 if e == 10 else float(np.exp(-e))) for k, c in enumerate(cases) for b, e in enumerate(c)]
    freq = spark.createDataFrame(rows, "pair string, bin int, f double")
    ref = spark.createDataFrame([(b, 1.0) for b in range(8)], "bin int, f double")
    got = P.pseudo_energy(freq, ref).orderBy("pair", "bin").toPandas()
    for k, c in enumerate(cases):
        assert got[got.pair == f"p{k:02d}"].e.to_list() == pytest.approx(loop_corrections(c)), c
    assert loop_corrections(cases[0]) == [10, 10, 1, 1.5, 0, 0, 0, 3]


def test_spline_hits_knots_and_is_smooth(spark):
    x = (np.arange(12) + 0.5) * 0.1
    y = np.sin(x * 5)
    pot = spark.createDataFrame([("AB", i, float(v)) for i, v in enumerate(y)], "pair string, bin int, e double")
    at = np.concatenate([x, x[:-1] + 0.05, [0.01, 1.19]])
    d = spark.createDataFrame([("AB", float(v)) for v in at], "pair string, d double")
    got = {round(r.d, 6): r.e for r in P.cubic_energy(d, pot, bins=12).collect()}
    for a, b in zip(x, y, strict=True):
        assert got[round(a, 6)] == pytest.approx(b, abs=1e-9)
    for a in x[1:-2] + 0.05:
        assert got[round(a, 6)] == pytest.approx(np.sin(a * 5), abs=5e-3)
    lin = {round(r.d, 6): r.e for r in P.linear_energy(d, pot, bins=12).collect()}
    assert lin[0.01] == pytest.approx(y[0]) and lin[1.19] == pytest.approx(y[-1])
    assert lin[round(x[3] + 0.05, 6)] == pytest.approx((y[3] + y[4]) / 2)


@pytest.mark.parametrize("kind", list("gertbco"))
def test_kernels_have_unit_mass_and_given_spread(spark, kind):
    u = np.linspace(-3, 3, 6001)
    df = spark.createDataFrame([(float(v),) for v in u], "u double").select("u", P.kernel_value(kind, F.col("u"), F.lit(0.4)).alias("k")).toPandas()
    w = df.k.to_numpy() * (u[1] - u[0])
    assert w.sum() == pytest.approx(1, abs=1e-3) and (w * u ** 2).sum() == pytest.approx(0.16, abs=1e-3)


def helix(n):
    """Ideal alpha helix: backbone atoms on their usual radii, rises and phases."""
    atoms = {"n": (1.55, -0.87, -27.5), "ca": (2.29, 0.0, 0.0), "c": (1.66, 1.02, 26.3), "o": (2.00, 2.23, 22.0)}
    rows = []
    for i in range(n):
        pts = {k: (float(r * np.cos(np.radians(100 * i + a))), float(r * np.sin(np.radians(100 * i + a))), 1.5 * i + z) for k, (r, z, a) in atoms.items()}
        rows.append(("h", i, i + 1, "A", pts["n"], pts["ca"], pts["c"], pts["o"]))
    return rows


PT = "struct<x:double,y:double,z:double>"


def test_ideal_helix_is_helical(spark):
    res = spark.createDataFrame(helix(20), f"ck string, idx int, auth_num int, aa string, n {PT}, ca {PT}, c {PT}, o {PT}")
    ss = "".join(r.ss for r in SS.assign_ss(CH.with_fragments(res, max_cn=2.5)).orderBy("idx").collect())
    assert ss[1:18] == "H" * 17, ss


def test_linking_and_sheets(spark):
    lad = spark.createDataFrame([("c", 0, "A", 5, 8, 20, 23), ("c", 1, "A", 10, 12, 16, 18), ("c", 2, "A", 21, 22, 40, 41), ("c", 3, "P", 60, 61, 70, 71)], SS.LADDER)
    res = spark.createDataFrame([("c", i, 0) for i in range(90)], "ck string, idx int, frag int")
    linked = SS.link_ladders(lad, res)
    assert {r.ladder: r["head"] for r in linked.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    sheet = {r.ladder: (r.sheet, r.strand) for r in SS.sheets(linked).collect()}
    assert sheet[0][0] == sheet[1][0] == sheet[2][0] == "A" and sheet[3] == ("B", "c")
    codes = {r.idx: r.code for r in SS.strand_codes(linked).collect()}
    assert codes[9] == "E" and codes[19] == "E" and 30 not in codes


def test_sphere_and_lone_atom_area(spark):
    pts = np.array(CK.sphere_points())
    assert len(pts) == 320 and pts[:, 3].sum() == pytest.approx(4 * np.pi) and np.allclose(np.linalg.norm(pts[:, :3], axis=1), 1)
    cols = "ck string, res_num int, serial int, atom_name string, element string, x double, y double, z double"
    atoms = spark.createDataFrame([("a", 1, 1, "CA", "C", 0.0, 0.0, 0.0), ("a", 2, 2, "CA", "C", 50.0, 0.0, 0.0), ("a", 3, 3, "CA", "C", 53.0, 0.0, 0.0)], cols)
    area = {r.res_num: r.area for r in CK.solvent_accessibility(atoms).collect()}
    free = 4 * np.pi * 3.27 ** 2
    assert area[1] == round(free) and area[2] < free * 0.8


def test_stale_start_keeps_the_earlier_start(spark):
    ss = "    HHHHHEEEEEE   HHH   "
    res = spark.createDataFrame([("c", i, s) for i, s in enumerate(ss)], "ck string, idx int, ss string")
    closed = lambda df: {r.idx for r in df.where("not cuttable").collect()}
    assert closed(CH.cut_mask(res)) == set(range(4, 8)) | set(range(9, 14)) | {18, 19}
    assert closed(CH.cut_mask(res, stale_start=True)) == set(range(4, 8)) | {18, 19}


def test_alignment_mask_and_missing_chains(spark):
    al = spark.createDataFrame([("c", "AC-DEF", "A-GD-F")], "ck string, first string, second string")
    assert sorted(r.idx for r in C.alignment_mask(al).collect()) == [0, 2, 4]
    atoms = spark.createDataFrame([("s", "A"), ("s", "B")], "structure_id string, chain string")
    want = spark.createDataFrame([("s", "A"), ("s", "Z")], "structure_id string, chain string")
    assert [r.chain for r in C.missing_chains(atoms, want).collect()] == ["Z"]
