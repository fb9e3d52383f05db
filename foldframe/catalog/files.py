"""Queries of the readers and writers: text is written from the derived views to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe.catalog.base import Input, query, r, rs
from foldframe.catalog.along import residues
from foldframe.catalog.domains import assigned, matrix, partitions
from foldframe.catalog.potential import pairs, trained
from foldframe.functions import codes
from foldframe.operators import chain as CH
from foldframe.operators import clean as C
from foldframe.operators import contacts as CT
from foldframe.operators import merge as M
from foldframe.operators import potential as P
from foldframe.operators import quality as QU
from foldframe.operators import report as R
from foldframe.plans.fixtures import THREE, register_view
from foldframe.session import scratch_path
from foldframe.sources import structures as S
from foldframe.sources import writers as WR

BY = r"{}=([^/]+)/"
ATOM_COLS = ["structure_id", "model", "chain", "ck", "record", "serial", "atom_name", "alt_loc", "res_name", "res_num", "icode", "x", "y", "z", "occ", "bfac", "element"]


@query("scan_structures", "fx_dirty", f"select {', '.join(ATOM_COLS)} from fx_dirty")
def _(q: Input):
    path = scratch_path(q.spark, "coordinates")
    WR.write_cleaned_structure(q.fx_dirty, path)
    return S.scan_structures(q.spark, path, BY.format("structure_id")).select(*ATOM_COLS)


@query("scan_compressed", "fx_atoms", f"select {', '.join(ATOM_COLS)} from fx_atoms")
def _(q: Input):
    path = scratch_path(q.spark, "compressed")
    WR.write_cleaned_structure(q.fx_atoms, path, compression="gzip")
    return S.scan_structures(q.spark, path, BY.format("structure_id")).select(*ATOM_COLS)


@query("scan_mmcif", "fx_dirty", f"select {', '.join(ATOM_COLS)} from fx_dirty")
def _(q: Input):
    path = scratch_path(q.spark, "mmcif")
    WR.write_lines(WR.mmcif_text(q.fx_dirty), path, "structure_id", ["pos"])
    return S.scan_mmcif(q.spark, path, BY.format("structure_id")).select(*ATOM_COLS)


CODE = "'p' || lpad(substr(structure_id, 2), 3, '0')"


@query("scan_manifest", "fx_res", f"""with s as (select structure_id, {CODE} as code, cast(substr(structure_id, 2) as int) as k, chain as use_chain from fx_res group by structure_id, chain)
  select code, case when k % 2 = 0 then 'B' else 'Z' end as chain, case when k % 3 = 0 then code || '.pdb' else 'pdb' || code || '.ent' end as name, use_chain from s t
  where k % 2 = 1 or use_chain = 'B' or not exists (select 1 from s u where u.k = t.k and u.use_chain = 'B')""")
def _(q: Input):
    part = F.expr("'f' || substr(structure_id, 5)")  # a code holds three digits: structures that share one lie in different folders
    known = q.fx_res.select("structure_id", "chain", F.expr(CODE).alias("code"), F.expr("cast(substr(structure_id, 2) as int)").alias("k"), part.alias("folder")).distinct()
    path = scratch_path(q.spark, "manifest")
    want = F.when(F.col("k") % 2 == 0, "B").otherwise("Z")
    known.select("folder", "code", "k").distinct().select("folder", F.concat("code", want).alias("value")).write.partitionBy("folder").text(path)
    name = F.when(F.col("k") % 3 == 0, F.concat("code", F.lit(".pdb"))).otherwise(F.concat(F.lit("pdb"), "code", F.lit(".ent")))
    late = known.where("k % 6 = 0").select("folder", F.concat(F.lit("pdb"), "code", F.lit(".ent")).alias("name"), "chain")
    files = known.select("folder", name.alias("name"), "chain").unionByName(late)
    return S.resolve_manifest(S.scan_manifest(q.spark, path, BY.format("folder")), files, files).drop("folder")


@query("scan_potentials", "fx_pot", f"select pair, bin, round((bin + 0.5e0) * 0.1e0, 4) as x, {rs('e')} as e from fx_pot")
def _(q: Input):
    path = scratch_path(q.spark, "potential")
    WR.write_potential_set(trained(q), path, diffmin=3, diffmax=5100, distmax=15, distmin=0, repres="CA")
    x = S.scan_pair_files(q.spark, f"{path}/xvector", "x").select("bin", "x")
    return S.scan_potentials(q.spark, f"{path}/energies", BY.format("pair"), 150, "part-*").join(x, "bin").select("pair", "bin", "x", r("e").alias("e"))


@query("write_potential_set", "fx_pot", """select pair, count(*) as n_bins, round(min(e), 6) as lowest, '3' as diffmin, '5100' as diffmax, '15' as distmax, '0' as distmin, 'CA' as repres
  from fx_pot group by pair""")
def _(q: Input):
    path = scratch_path(q.spark, "potential")
    WR.write_potential_set(trained(q), path, diffmin=3, diffmax=5100, distmax=15, distmin=0, repres="CA")
    rows = S.scan_potentials(q.spark, f"{path}/energies", BY.format("pair"), names="part-*").groupBy("pair").agg(F.count(F.lit(1)).alias("n_bins"), F.round(F.min("e"), 6).alias("lowest"))
    named = S.scan_parameters(q.spark, f"{path}/parameters").withColumn("one", F.lit(1))
    return rows.withColumn("one", F.lit(1)).join(named, "one").drop("one")


@query("scan_frequencies", "fx_freq", "select pair, cast(bin as int) as bin, round(f, 6) as f from fx_freq")
def _(q: Input):
    path = scratch_path(q.spark, "frequencies")
    f = P.pair_frequencies(P.distance_histogram(pairs(q)))
    WR.write_lines(f.select("pair", "bin", F.col("f").cast("string").alias("value")), path, "pair", ["bin"])
    return S.scan_frequencies(q.spark, path, BY.format("pair"), names="part-*").select("pair", "bin", F.round("f", 6).alias("f"))


@query("scan_dssp", "fx_res", "select ck, res_num, chain, aa, ss from fx_res")
def _(q: Input):
    row = F.format_string("%5d%5d %1s %1s  %1s             0   0", F.col("idx") + 1, "res_num", "chain", "aa", "ss")
    gap = F.format_string("%5d        !*             0   0", F.col("idx") + 1)
    body = q.fx_res.select("ck", (F.col("idx") * 2).alias("pos"), row.alias("value")).unionByName(
        q.fx_res.where("idx % 50 = 25").select("ck", (F.col("idx") * 2 + 1).alias("pos"), gap.alias("value")))
    head = q.fx_res.select("ck").distinct().select("ck", F.lit(-1).alias("pos"), F.lit("==== Secondary Structure ====\n  #  RESIDUE AA STRUCTURE BP1 BP2  ACC").alias("value"))
    path = scratch_path(q.spark, "ss-table")
    WR.write_lines(head.unionByName(body), path, "ck", ["pos"])
    return S.scan_dssp(q.spark, path, BY.format("ck")).select(F.col("structure_id").alias("ck"), "res_num", "chain", "aa", "ss")


register_view("fx_txt", ("fx_dom", "fx_assign"), """select a.ck, a.m, a.n, a.min_size, a.kappa, a.min_density, a.max_cr, cast(a.quality as int) as quality, d.txt, g.ambiguity
  from fx_assign a join (select ck, m, string_agg(cast(s as string) || '-' || cast(e as string), ' ' order by s) as txt from fx_dom group by ck, m) d on d.ck = a.ck and d.m = a.m
  join (select ck, cast(least(5, max(least(quality, k))) as int) as ambiguity from (select ck, quality, row_number() over (partition by ck order by quality desc) as k
    from fx_assign where quality is not null) t group by ck) g on g.ck = a.ck""")


def assignments(q: Input):
    rows = M.domain_fragments(assigned(q), matrix(q)).withColumn("alt_id", F.col("m"))
    return rows.join(QU.ambiguity_index(rows), "ck")


@query("scan_assignments", "fx_txt", f"select ck, ambiguity, n, min_size, txt as domains, {rs('kappa')} as kappa, quality from fx_txt")
def _(q: Input):
    path = scratch_path(q.spark, "reports")
    WR.write_lines(R.summary_text(assignments(q)).withColumn("pos", F.lit(0)), path, "ck", ["pos"])
    got = S.scan_assignments(q.spark, path, BY.format("ck"))
    return got.select(F.col("structure_id").alias("ck"), "ambiguity", "n", "min_size", R.fragments_text(F.col("domains")).alias("domains"), r("kappa").alias("kappa"), "quality")


@query("summary_text", "fx_txt", """select ck, 'A-index = ' || repeat('+', any_value(ambiguity)) || chr(10) || string_agg(line, chr(10) order by m) as value from
  (select ck, m, ambiguity, case when m = 0 then line || chr(10) || 'ALTERNATIVES' else line end as line from (select ck, m, ambiguity,
    printf('%-2d|%-3d|%60s|%12.6f|%10s|', n, min_size, txt, kappa, coalesce(repeat('*', quality), 'n/a')) as line from fx_txt) a) b group by ck""")
def _(q: Input):
    return R.summary_text(assignments(q))


def levels_of_parts(q: Input):
    """The contiguous groupings written as if they were levels."""
    rows = M.domain_fragments(assigned(q), matrix(q)).select("ck", F.col("m").alias("level"), "max_cr", "min_density", F.col("kappa").alias("ci"),
                                                             F.col("distance").alias("r"), F.explode(F.flatten("domains")).alias("s"))
    return rows.select("ck", "level", "max_cr", "min_density", "ci", "r", "s.start", "s.end")


@query("scan_peeling_levels", "fx_dom fx_assign fx_res", f"""select d.ck, a.n, cast(row_number() over (partition by d.ck, d.m order by d.s) - 1 as int) as ord, x.res_num as "start",
   y.res_num as "end", {rs('a.kappa')} as ci, {rs('a.dist')} as r from fx_dom d join fx_assign a on a.ck = d.ck and a.m = d.m
   join fx_res x on x.ck = d.ck and x.idx = d.s join fx_res y on y.ck = d.ck and y.idx = d.e""")
def _(q: Input):
    path = scratch_path(q.spark, "levels")
    WR.write_lines(R.level_text(levels_of_parts(q)), path, "ck", ["level"])
    numbers = q.fx_res.select(F.col("ck").alias("structure_id"), "idx", F.col("res_num").alias("auth_num"))
    got = S.scan_peeling_levels(q.spark, path, numbers, BY.format("ck"))
    return got.select(F.col("structure_id").alias("ck"), "n", "ord", "start", "end", r("ci").alias("ci"), r("r").alias("r"))


def header_text(q: Input):
    ids = q.fx_res.select("structure_id", F.expr("cast(substr(structure_id, 2) as int)").alias("k")).distinct()
    code = F.concat(F.lit("X"), F.lpad(F.col("k").cast("string"), 3, "0"))
    rows = [F.format_string("HEADER    %-40s%9s   %4s", F.lit("SYNTHETIC FOLD"), F.format_string("%02d-JAN-%02d", F.col("k") % 28 + 1, F.col("k") % 90 + 10), code),
            F.format_string("TITLE     CHAIN PAIR %d", "k"), F.lit("TITLE    2 OF A RANDOM WALK"), F.format_string("COMPND    MOLECULE %d", "k"),
            F.lit("SOURCE    SYNTHETIC"), F.lit("KEYWDS    WALK, TEST"), F.lit("EXPDTA    X-RAY DIFFRACTION"), F.lit("AUTHOR    NOBODY"),
            F.format_string("REMARK   2 RESOLUTION.    %.2f ANGSTROMS.", F.col("k") / 10 + 1),
            F.format_string("REMARK   3   R VALUE            (WORKING SET) : %.3f", F.col("k") / 1000 + 0.125),
            F.format_string("REMARK   3   FREE R VALUE                     : %.3f", F.col("k") / 1000 + 0.25)]
    return ids.select("structure_id", F.posexplode(F.array(*rows)).alias("pos", "value"))


@query("header_metadata", "fx_res", """select structure_id, 'X' || lpad(cast(k as string), 3, '0') as id, lpad(cast(k % 28 + 1 as string), 2, '0') || '-JAN-' || cast(k % 90 + 10 as string) as date,
   'CHAIN PAIR ' || cast(k as string) || ' OF A RANDOM WALK' as title, 'MOLECULE ' || cast(k as string) as compnd, 'SYNTHETIC' as source, 'NOBODY' as author, 'WALK, TEST' as keywds,
   'X-RAY DIFFRACTION' as method, cast(printf('%.2f', k / 10e0 + 1) as double) as resolution, cast(printf('%.3f', k / 1000e0 + 0.125e0) as double) as r_value,
   cast(printf('%.3f', k / 1000e0 + 0.25e0) as double) as free_r
  from (select distinct structure_id, cast(substr(structure_id, 2) as int) as k from fx_res) t""")
def _(q: Input):
    path = scratch_path(q.spark, "headers")
    WR.write_lines(header_text(q), path, "structure_id", ["pos"])
    return S.header_metadata(S.structure_lines(q.spark, path, BY.format("structure_id")))


@query("seqres_sequence", "fx_res", "select structure_id, chain, string_agg(case when aa = 'M' then 'X' else aa end, '' order by idx) as seq from fx_res group by structure_id, chain")
def _(q: Input):
    three = F.when(F.col("aa") == "M", "MSE").otherwise(codes.three_letter(F.col("aa")))
    part = q.fx_res.withColumn("k", F.floor(F.col("idx") / 13).cast("int")).groupBy("structure_id", "chain", "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", three.alias("n")))), lambda s: s["n"]), " ").alias("names"))
    line = F.format_string("SEQRES %3d %1s %4d  %s", F.col("k") + 1, "chain", F.lit(168), "names")
    path = scratch_path(q.spark, "seqres")
    WR.write_lines(part.select("structure_id", "chain", "k", line.alias("value")), path, "structure_id", ["chain", "k"])
    return S.seqres_sequence(S.structure_lines(q.spark, path, BY.format("structure_id")))


@query("write_cleaned_structure", "fx_clean", """select ck, printf('%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', record, cast(row_number() over (partition by ck order by serial) as int),
    case when length(atom_name) < 4 then ' ' || atom_name else atom_name end, ' ', res_name, chain, cast(dense_rank() over (partition by ck order by res_num) as int), icode, x, y, z, occ, bfac, element) as value
  from fx_clean""")
def _(q: Input):
    atoms = C.renumber_residues(C.clean(q.fx_dirty)).withColumn("res_num", F.col("idx") + 1)
    atoms = atoms.withColumn("serial", F.row_number().over(W.partitionBy("ck").orderBy("serial")))
    path = scratch_path(q.spark, "cleaned")
    WR.write_cleaned_structure(atoms.withColumn("structure_id", F.col("ck")), path)
    lines = S.structure_lines(q.spark, path, BY.format("structure_id")).where("line not like 'MODEL%'")
    return lines.select(F.col("structure_id").alias("ck"), F.col("line").alias("value"))


@query("write_contact_matrix", "fx_con", "select ck, i, string_agg(printf('%7.5f', p), ' ' order by j) as value from fx_con group by ck, i")
def _(q: Input):
    path = scratch_path(q.spark, "contact-matrix")
    WR.write_contact_matrix(CT.contact_probability(residues(q), blocks=True), path, symmetric=True)
    lines = S.structure_lines(q.spark, path, BY.format("ck"))
    return lines.select(F.col("structure_id").alias("ck"), F.col("line_no").alias("i"), F.col("line").alias("value"))


register_view("fx_unit", ("fx_dom", "fx_txt"), """select d.ck, d.m, d.dom + 1 as dom, cast(d.s as string) || '-' || cast(d.e as string) as pu, case when d.size >= 30 then -(d.inn / d.size) end as z,
  t.n, t.quality, t.ambiguity, case when d.m = 0 then 'Optimal partition' else 'Alternative partition ' || cast(d.m as string) end as name
  from fx_dom d join fx_txt t on t.ck = d.ck and t.m = d.m""")
AUL = "case when abs(z) >= 1 then cast(trunc((1 - 1 / (z * z)) * 100) as int) else 0 end"
Z1 = "coalesce(cast(nullif(round(z, 1), 0) as string), {0})"


def summary_input(q: Input):
    """Assignments and their fragments; minus the density stands in for the Z-score, and fragments below thirty residues have none."""
    mat = matrix(q)
    rows = assigned(q)
    frags = M.domain_fragments(rows, mat).select("ck", F.col("m").alias("alt_id"), F.posexplode("domains").alias("k", "d"))
    info = M.condensed(partitions(mat), mat).select("ck", F.col("m").alias("alt_id"), F.posexplode(F.arrays_zip("inn", "size")).alias("k", "i"))
    z = F.when(F.col("i.size") >= 30, -(F.col("i.inn") / F.col("i.size")))
    units = frags.join(info, ["ck", "alt_id", "k"]).select("ck", "alt_id", (F.col("k") + 1).alias("dom"), z.alias("z_dom"), F.posexplode("d").alias("pos", "f"))
    units = units.select("ck", "alt_id", "dom", "z_dom", "pos", F.concat_ws("-", F.col("f.start").cast("string"), F.col("f.end").cast("string")).alias("pu"), F.col("z_dom").alias("z_pu"))
    with_amb = rows.join(QU.ambiguity_index(rows), "ck").select("ck", F.col("m").alias("alt_id"), "n", "quality", "ambiguity")
    return with_amb, units


@query("summary_json", "fx_unit", f"""with d as (select ck, m, any_value(name) as name, any_value(n) as n, any_value(quality) as quality, any_value(ambiguity) as ambiguity,
    string_agg('"Domain ' || cast(dom as string) || '":{{"AUL":' || cast({AUL} as string) || ',"Z-score":' || {Z1.format("'" + '"n/a"' + "'")} || ',"PUs":{{"' || pu || '":{{"AUL":' || cast({AUL} as string)
      || ',"Z-score":' || {Z1.format("'" + '"n/a"' + "'")} || '}}}}}}', ',' order by dom) as doms from fx_unit group by ck, m)
  select ck, '{{"Ambiguity index":"' || repeat('*', any_value(ambiguity)) || '",' || string_agg('"' || name || '":{{"Partition":"' || name || '","Quality":"' || repeat('*', coalesce(quality, 0))
    || '","Nb. domains":' || cast(n as string) || ',"Domains":{{' || doms || '}}}}', ',' order by m) || '}}' as value from d group by ck""")
def _(q: Input):
    path = scratch_path(q.spark, "summary")
    R.write_summary_json(R.summary_json(*summary_input(q)), path)
    return R.read_summary_json(q.spark, path)


@query("summary_report", "fx_unit", f"""with d as (select ck, m, any_value(name) as name, any_value(n) as n, any_value(quality) as quality, any_value(ambiguity) as ambiguity,
    string_agg('Domain:' || cast(dom as string) || '       AUL=' || printf('%3d', {AUL}) || '% Z-score=' || {Z1.format("'n/a'")} || chr(10)
      || '    PU:' || printf('%7s', pu) || ' AUL=' || printf('%3d', {AUL}) || '% Z-score=' || {Z1.format("'n/a'")}, chr(10) order by dom) as doms from fx_unit group by ck, m)
  select ck, 'Ambiguity index: ' || repeat('*', any_value(ambiguity)) || chr(10) || string_agg('-----------------------' || chr(10) || name || chr(10) || 'Quality: ' || repeat('*', coalesce(quality, 0))
    || chr(10) || 'Nb. domains: ' || cast(n as string) || chr(10) || doms, chr(10) order by m) as value from d group by ck""")
def _(q: Input):
    return R.run_text(*summary_input(q))


@query("level_summary", "fx_unit fx_assign fx_dom", f"""with u as (select u.*, a.kappa, cast(split_part(u.pu, '-', 1) as int) as s from fx_unit u join fx_assign a on a.ck = u.ck and a.m = u.m)
  select ck, cast(m as int) as level, 'Peeling level ' || cast(m as string) || chr(10) || '    Number of Protein Units: ' || cast(count(*) as string) || chr(10) || '    Compaction Index: ' || cast(round(any_value(kappa), 2) as string)
    || chr(10) || string_agg('    ' || printf('%7s', pu) || ': AUL=' || printf('%3d', {AUL}) || '% Z-score=' || coalesce(cast(round(z, 1) as string), 'n/a'), chr(10) order by s) as value from u group by ck, m""")
def _(q: Input):
    _, units = summary_input(q)
    kappa = assigned(q).select("ck", F.col("m").alias("alt_id"), F.col("kappa").alias("ci"))
    rows = units.join(kappa, ["ck", "alt_id"]).select("ck", F.col("alt_id").alias("level"), "ci", F.split("pu", "-")[0].cast("int").alias("start"), "pu", F.col("z_pu").alias("z"))
    return R.level_summary(rows)


@query("write_fasta", "fx_res", """select ck, '>' || ck || chr(10) || regexp_replace(regexp_replace(seq, '(.{80})', '\\1' || chr(10), 'g'), chr(10) || '$', '') as value
  from (select ck, string_agg(aa, '' order by idx) as seq from fx_res group by ck) t""")
def _(q: Input):
    path = scratch_path(q.spark, "fasta")
    WR.write_fasta(CH.chain_sequence(q.fx_res), path)
    return S.scan_fasta(q.spark, path)


@query("fragment_slices", "fx_pu fx_res fx_atoms", """select p.ck, 1 as level, cast(p.pu as int) as ord, p.s as "start", p.e as "end", string_agg(aa, '' order by idx) as seq, string_agg(ss, '' order by idx) as ss, any_value(a.n) as n_atoms
  from fx_pu p join fx_res r on r.ck = p.ck and r.idx between p.s and p.e
  join (select p.ck, p.pu, count(*) as n from fx_pu p join fx_atoms a on a.ck = p.ck and a.idx between p.s and p.e group by p.ck, p.pu) a on a.ck = p.ck and a.pu = p.pu
  group by p.ck, p.pu, p.s, p.e""")
def _(q: Input):
    levels = q.fx_pu.select("ck", F.lit(1).alias("level"), F.col("pu").cast("int").alias("ord"), F.col("s").alias("start"), F.col("e").alias("end"))
    atoms = WR.slice_atoms(q.fx_atoms, levels).groupBy("ck", "level", F.col("unit").alias("ord")).agg(F.count(F.lit(1)).alias("n_atoms"))
    return WR.fragment_slices(q.fx_res, levels).join(atoms, ["ck", "level", "ord"])


register_view("fx_runs8", ("fx_res",), """select ck, ss, min(idx) as s, max(idx) as e from (select *, sum(n) over (partition by ck order by idx) as g from
  (select *, case when lag(ss) over (partition by ck order by idx) <> ss then 1 else 0 end as n from fx_res) b) c group by ck, ss, g""")
NAME = THREE.replace("case aa", "case {}.aa")


@query("ss_records", "fx_runs8 fx_res", f"""with k as (select t.*, case when ss in ('H','G','I') then 'HELIX' else 'SHEET' end as kind from fx_runs8 t where ss in ('H','G','I','E')),
  n as (select *, cast(row_number() over (partition by ck, kind order by s) as int) as number from k),
  j as (select n.*, x.res_num as a1, y.res_num as a2, x.chain, {NAME.format('x')} as n1, {NAME.format('y')} as n2 from n join fx_res x on x.ck = n.ck and x.idx = n.s join fx_res y on y.ck = n.ck and y.idx = n.e)
  select ck, kind, number, case when kind = 'HELIX' then printf('HELIX  %3d %3d %3s %1s %4d  %3s %1s %4d %2d%36d', number, number, n1, chain, a1, n2, chain, a2,
      case ss when 'H' then 1 when 'G' then 5 else 3 end, e - s + 1)
    else printf('SHEET  %3d %3s%2d %3s %1s%4d  %3s %1s%4d  %2d', number, 'A', 1, n1, chain, a1, n2, chain, a2, 0) end as value from j""")
def _(q: Input):
    res = q.fx_res.select("ck", "idx", F.col("res_num").alias("auth_num"), "aa", "chain", "ss")
    return WR.ss_records(CH.ss_runs(res), res)
