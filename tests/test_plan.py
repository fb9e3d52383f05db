"""The whole job from coordinate text to reports, and readers and checks on awkward files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe import session
from foldframe.functions import codes
from foldframe.operators import checks as C
from foldframe.operators import clean as CL
from foldframe.operators import potential as P
from foldframe.plans import decompose as D
from foldframe.sources import structures as S


def atom(serial, name, res, num, x, y, z, chain="A", kind="ATOM"):
    return f"{kind:<6}{serial:5d} {name:<4} {res:>3} {chain}{num:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00 10.00"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def blobs(seed, n=60):
    """Two compact coils far apart, joined by a linker; N, CA, C and O of each residue."""
    rng, lines, t = np.random.default_rng(seed), [], 0
    for k in range(2 * n + 5):
        part = 0 if k < n else 2 if k >= n + 5 else 1
        a = k * 1.7
        centre = np.array([0.0, 0, 0]) if part == 0 else np.array([60.0, 0, 0]) if part == 2 else np.array([12.0 + 9 * (k - n + 1), 0, 0])
        ca = centre + (np.array([8 * np.cos(a), 8 * np.sin(a), ((k % n) - n / 2) * 0.3]) if part != 1 else 0) + rng.normal(0, 0.05, 3)
        for name, shift in ((" N", (-0.9, -0.9, 0)), (" CA", (0, 0, 0)), (" C", (0.9, 0.9, 0.2)), (" O", (1.6, 0.4, 1.0))):
            t += 1
            lines.append(atom(t, name, ["ALA", "GLY", "LEU", "SER", "VAL"][k % 5], k + 11, *(ca + shift)))
    return "\n".join(lines)


def test_text_to_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        put(tmp_path / "in", f"x{k}.pdb", f"MODEL        1\n{blobs(k)}\nENDMDL\nMODEL        2\n{blobs(k + 5)}\nENDMDL\nEND\n")
    atoms = S.scan_structures(spark, str(tmp_path / "in"))
    assert {r.model for r in atoms.select("model").distinct().collect()} == {1, 2}
    res = D.residue_table(atoms)
    ca = res.select(F.col("ck").alias("structure_id"), F.lit("A").alias("chain"), "ck", F.col("idx").alias("res_num"), F.concat("aa", F.lit("CA")).alias("atom_type"), "ca.x", "ca.y", "ca.z")
    potential = P.train(P.pair_distances(ca, inter=False), width=0.5)
    run = D.decompose(res, potential, decoys=50, width=0.5)
    got = {r.ck: r for r in D.summaries(run).collect()}
    assert set(got) == {"x0_1_A", "x1_1_A"}
    for r in got.values():
        doc = json.loads(r.json)
        best = doc["Optimal partition"]
        assert doc["Ambiguity index"].strip("*") == "" and best["Nb. domains"] == len(best["Domains"]) == 2
        bounds = [u for d in best["Domains"].values() for u in d["PUs"]]
        assert int(bounds[0].split("-")[0]) == 11 and int(bounds[-1].split("-")[1]) == 135  # author numbers
        assert all(v["Z-score"] == "n/a" or isinstance(v["Z-score"], float) for d in best["Domains"].values() for v in [d, *d["PUs"].values()])
        assert r.text.startswith("Ambiguity index: ") and "\nDomain:1       AUL=" in r.text
    junctions, domains = D.consistency(run)
    assert domains.where("n > 0").count() > 0 and junctions.where("raw > 0").count() >= 1
    assert not run.assignments.where("limited").count()
    tight = D.decompose(res, unit_limit=1)
    assert tight.energies is None and tight.assignments.where("limited").count() > 0
    bare = {r.ck: r for r in D.summaries(tight).collect()}
    assert set(bare) == set(got)
    for r in bare.values():
        doc = json.loads(r.json)["Optimal partition"]
        assert doc["Domains"] and all(set(d) == {"PUs"} and d["PUs"] and all(u == {} for u in d["PUs"].values()) for d in doc["Domains"].values())
        assert "\nDomain:1\n    PU:" in r.text and "AUL" not in r.text
    assert D.domain_scores(tight).where("z is null and aul is null").count() == D.domain_scores(tight).count() > 0


def test_starting_partition_is_always_listed(spark):
    matrix = spark.createDataFrame([("k", 3, [5.0, 1.0, 0.1, 1.0, 5.0, 0.1, 0.1, 0.1, 5.0], [0, 10, 20], [9, 19, 29])], "ck string, npu int, sums array<double>, starts array<int>, ends array<int>")
    residues = spark.createDataFrame([("k", i) for i in range(30)], "ck string, idx int")
    assert D.assign(matrix, residues).agg(F.max("n")).first()[0] == 3


def test_lines_after_the_last_model_have_none(spark, tmp_path):
    text = f"MODEL        3\n{atom(1, ' CA', 'ALA', 1, 0, 0, 0)}\nENDMDL\nREMARK ENDMDL inside a line\n{atom(2, ' O', 'HOH', 2, 1, 0, 0, kind='HETATM')}\n"
    got = [(r.model, r.atom_name) for r in S.scan_structures(spark, put(tmp_path, "a.pdb", text)).orderBy("serial").collect()]
    assert got == [(3, "CA"), (None, "O")]


def test_calcium_is_not_carbon(spark, tmp_path):
    text = "\n".join([atom(1, " CA", "ALA", 1, 0, 0, 0), atom(2, "CA", "CA", 2, 1, 0, 0, kind="HETATM"), atom(3, "HG11", "VAL", 3, 1, 0, 0), atom(4, "1HB", "VAL", 3, 1, 0, 0), atom(5, "ZN", "ZN", 4, 1, 0, 0, kind="HETATM")])
    got = [r.element for r in S.scan_structures(spark, put(tmp_path, "a.pdb", text)).orderBy("serial").collect()]
    assert got == ["C", "CA", "H", "H", "ZN"]


def test_models_do_not_meet(spark):
    rows = [("s", m, "A", f"s_{m}_A", 10 * k + m, "CYS", "SG", 1.0 * k, 0.0, 0.0) for m in (1, 2) for k in (0, 1)]
    atoms = spark.createDataFrame(rows, "structure_id string, model int, chain string, ck string, res_num int, res_name string, atom_name string, x double, y double, z double")
    assert [(r.model, r.resl, r.resr) for r in C.disulfides(atoms).orderBy("model").collect()] == [(1, "1A", "11A"), (2, "2A", "12A")]
    typed = atoms.withColumn("atom_type", F.lit("CCA"))
    assert P.pair_distances(typed, smin=0).count() == 2
    ca = atoms.withColumn("atom_name", F.lit("CA"))
    near = C.neighbours_around(ca, ca.where("res_num in (1, 2)"), 3.0)
    assert sorted((r.centre, r.res_num) for r in near.collect()) == [(1, 11), (2, 12)]


def test_accessibility_sees_other_chains(spark):
    row = lambda chain, serial, x: ("s", 1, chain, f"s_1_{chain}", serial, serial, "CA", "C", x, 0.0, 0.0)
    schema = "structure_id string, model int, chain string, ck string, serial int, res_num int, atom_name string, element string, x double, y double, z double"
    area = lambda rows: {r.ck: r.area for r in C.solvent_accessibility(spark.createDataFrame(rows, schema)).collect()}
    assert area([row("A", 1, 0.0), row("B", 2, 2.0)])["s_1_A"] < area([row("A", 1, 0.0), row("B", 2, 50.0)])["s_1_A"]


def test_potential_folder_with_other_files(spark, tmp_path):
    put(tmp_path, "ACALCA.nrg", "1.0\n2.0\n")
    put(tmp_path, "xvector.dat", "0.05\n0.15\n")
    put(tmp_path, "parameters.log", "DISTMAX=15\nREPRES=CA\n")
    got = S.scan_potentials(spark, str(tmp_path), bins=2).orderBy("bin").collect()
    assert [(r.pair, r.bin, r.e) for r in got] == [("ACALCA", 0, 1.0), ("ACALCA", 1, 2.0)]


def test_decoys_take_bins_and_atom_from_the_potential(spark):
    rows = [("ACBLCB", k, float(k)) for k in range(7)]
    cube = P.energy_cube(spark.createDataFrame(rows, "pair string, bin int, e double"))
    assert cube.shape == (21, 21, 7) and cube[0, 9].tolist() == [0, 1, 2, 3, 4, 5, 6] == cube[9, 0].tolist()
    for bad in ("ACALCB", "AXBY", "ZCALCA"):
        with pytest.raises(ValueError, match="one atom per residue"):
            P.energy_cube(spark.createDataFrame([*rows, (bad, 0, 1.0)], "pair string, bin int, e double"))


def test_labels_never_repeat(spark):
    got = [r.c for r in spark.range(1, 200).select(codes.chain_letter(F.col("id")).alias("c")).collect()]
    assert got[:3] == ["A", "B", "C"] and got[25:28] == ["Z", "A1", "B1"] and len(set(got)) == 199


def test_files_name_their_modified_residues(spark, tmp_path):
    text = "\n".join(["MODRES 1ABC XYZ A    2  MET  SOME NAME", atom(1, " CA", "ALA", 1, 0, 0, 0), atom(2, " CA", "XYZ", 2, 1, 0, 0), atom(3, " CA", "MSE", 3, 2, 0, 0), atom(4, " CA", "QQQ", 4, 3, 0, 0)])
    folder = put(tmp_path, "a.pdb", text)
    told = S.modified_residues(S.structure_lines(spark, folder))
    assert [tuple(r) for r in told.collect()] == [("a", "XYZ", "MET")]
    got = CL.standardise_residues(S.scan_structures(spark, folder), told=told).orderBy("serial").collect()
    assert [r.res_name for r in got] == ["ALA", "MET", "MET", "UNK"]


def test_machine_local_folders():
    assert all(session.machine_local(p) for p in ("/tmp", "/tmp/x", "file:/tmp/x", "file:///tmp/x"))
    assert not any(session.machine_local(p) for p in ("hdfs://host/tmp/x", "s3a://b/tmp", "/shared/tmp", "file:///mnt/shared"))


def test_intermediate_tables_can_be_discarded(spark):
    from pathlib import Path

    before = session.scratch_path(spark, "kept")
    session.written(spark.range(3), "thrown-away")
    made = [p for p in session._made[spark.sparkContext.applicationId] if "thrown-away" in p]
    assert Path(made[-1].removeprefix("file:")).exists()
    assert session.discard(spark) >= 2 and not Path(made[-1].removeprefix("file:")).exists() and not Path(before).exists()


CIF = """data_x
_struct.title
;A title with
ATOM   9 fake line in a text block
_atom_site.not_a_tag
;
loop_
_note.id
_note.text
1 'ATOM is a word' 2 "it's quoted"
# a comment _atom_site.x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.details
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . ALA A 5 ? 1.0 2.0 3.0 1.0 10.0 'two words' 1
ATOM 2 C "CA" A ALA A 5 ? 1.5 2.5 3.5 0.5 11.0
;several
 lines # no comment
; 1
HETATM 3 O "O5'" . NAG A 6 B 4.0 5.0 6.0
 1.0 12.0 . 1 ATOM 4 N N . GLY 'A' 7 . 7.0 8.0 9.0 1.0 13.0 'it's one' 1
loop_
_other.id
ATOM
"""


def test_mmcif_tokens(spark, tmp_path):
    """Quoted blanks, text blocks, inner quotes, rows over and within lines: the same atoms as the fixed-width form."""
    path = put(tmp_path, "x.cif", CIF)
    got = S.scan_mmcif(spark, path).orderBy("line_no").collect()
    assert [(r.record, r.serial, r.atom_name, r.alt_loc, r.res_name, r.chain, r.res_num, r.icode, r.x, r.occ, r.bfac, r.element, r.model, r.ck) for r in got] == [
        ("ATOM", 1, "N", " ", "ALA", "A", 5, " ", 1.0, 1.0, 10.0, "N", 1, "x_1_A"), ("ATOM", 2, "CA", "A", "ALA", "A", 5, " ", 1.5, 0.5, 11.0, "C", 1, "x_1_A"),
        ("HETATM", 3, "O5'", " ", "NAG", "A", 6, "B", 4.0, 1.0, 12.0, "O", 1, "x_1_A"), ("ATOM", 4, "N", " ", "GLY", "A", 7, " ", 7.0, 1.0, 13.0, "N", 1, "x_1_A")]
    (tmp_path / "more").mkdir()
    more = put(tmp_path / "more", "y.cif", CIF.split("loop_\n_atom_site")[0])
    put(tmp_path / "more", "z.cif", "data_z\nloop_\n_atom_site.group_PDB\n_atom_site.id\n" + "ATOM 1\n" * 3 + "ATOM")
    put(tmp_path / "more", "e.cif", "")
    assert sorted((r.structure_id, r.serial) for r in S.scan_mmcif(spark, more).collect()) == [("z", 1)] * 3
    long = "data_l\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.details\n" + "".join(f"ATOM {k} '{'long text ' * 40}'\n" for k in range(20_000))
    (tmp_path / "long").mkdir()
    assert S.scan_mmcif(spark, put(tmp_path / "long", "l.cif", long)).agg(F.sum("serial")).first()[0] == sum(range(20_000))
