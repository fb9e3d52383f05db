"""Queries of the filter and renumbering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.catalog.base import Input, query
from foldframe.operators import chain as CH
from foldframe.operators import clean as C
from foldframe.plans.fixtures import register_view

STD = "(" + ", ".join(f"'{c}'" for c in K.THREE_TO_ONE) + ")"
register_view("fx_std", ("fx_dirty",), f"""select * from fx_dirty d where model = 1 and record = 'ATOM' and res_name in {STD}""")
register_view("fx_clean", ("fx_std",), """select * from fx_std s where alt_loc in (' ', 'A') and not exists
  (select 1 from fx_std i where i.ck = s.ck and i.res_num = s.res_num and i.icode <> ' ')""")
ATOM = "ck, serial, atom_name, res_name, res_num, icode"


def atom_cols(df):
    return df.select("ck", "serial", "atom_name", "res_name", "res_num", "icode")


@query("select_model", "fx_dirty", f"select {ATOM} from fx_dirty where model = 1")
def _(q: Input):
    return atom_cols(C.select_model(q.fx_dirty, 1))


@query("select_chain", "fx_dirty", f"""select {ATOM} from fx_dirty d where chain =
  (select min(chain) from fx_dirty e where e.structure_id = d.structure_id)""")
def _(q: Input):
    return atom_cols(C.select_chain(q.fx_dirty))


@query("keep_standard_protein", "fx_dirty", f"select {ATOM} from fx_dirty where record = 'ATOM' and res_name in {STD}")
def _(q: Input):
    return atom_cols(C.keep_standard_protein(q.fx_dirty))


@query("drop_insertion_residues", "fx_dirty", f"""select {ATOM} from fx_dirty anti join
  (select distinct ck, res_num from fx_dirty where icode <> ' ') i using (ck, res_num)""")
def _(q: Input):
    return atom_cols(C.drop_insertion_residues(q.fx_dirty))


@query("resolve_altloc", "fx_dirty", """select ck, serial, atom_name, ' ' as alt_loc, true as blank_or_a, rn = 1 as first_listed from
  (select *, row_number() over (partition by ck, res_num, icode, res_name, atom_name order by serial) as rn from fx_dirty) t
  where alt_loc in (' ', 'A')""")
def _(q: Input):
    key = ["ck", "serial", "atom_name", "alt_loc"]
    first = C.resolve_altloc(q.fx_dirty, "first").select(*key, F.lit(True).alias("f"))
    return (C.resolve_altloc(q.fx_dirty).join(first, key, "left")
            .select(*key, F.lit(True).alias("blank_or_a"), F.coalesce("f", F.lit(False)).alias("first_listed")))


def near(a: str, lim: str) -> str:
    d = " + ".join(f"({a}{k} - lag({a}{k}) over w) * ({a}{k} - lag({a}{k}) over w)" for k in "xyz")
    return f"coalesce(sqrt({d}) < {lim}, false)"


def pivot(a: str) -> str:
    return ", ".join(f"max(case when atom_name = '{a.upper()}' then {k} end) as {a}{k}" for k in "xyz")


@query("drop_superposed_residues", "fx_std", f"""with res as (
  select ck, res_num, icode, min(serial) as fs, {pivot('n')}, {pivot('ca')}, {pivot('c')}, {pivot('o')}
  from fx_std where alt_loc in (' ', 'A') group by ck, res_num, icode),
 hit as (select *, {near('n', '1')} and {near('ca', '1')} and {near('c', '1')} and {near('o', '1')} as h from res window w as (partition by ck order by fs)),
 drp as (select *, (h and (icode <> ' ' or lag(icode) over w = ' ')) or (coalesce(lead(h) over w, false) and icode <> ' ' and lead(icode) over w = ' ') as d
  from hit window w as (partition by ck order by fs))
 select ck, res_num, icode from drp where not coalesce(d, false)""")
def _(q: Input):
    atoms = C.resolve_altloc(C.keep_standard_protein(C.select_model(q.fx_dirty)))
    return C.drop_superposed_residues(atoms).select("ck", "res_num", "icode").distinct()


MAPPED = ("case when res_name in " + STD + " then res_name " + " ".join(f"when res_name = '{a}' then '{b}'" for a, b in K.MODIFIED.items())
          + " else 'UNK' end")


@query("standardise_residues", "fx_dirty", f"""with r as (select *, sum(c) over (partition by ck order by serial) as run from
   (select *, case when lag(record) over (partition by ck order by serial) <> record then 1 else 0 end as c from fx_dirty) t),
 e as (select ck, run, min(record) as rec, arg_min(res_num, serial) as a, arg_max(res_num, serial) as b from r group by ck, run),
 p as (select ck, run, coalesce(rec = 'HETATM' and lag(b) over w = a - 1 and lead(a) over w = b + 1, false) as p from e window w as (partition by ck order by run))
 select ck, serial, atom_name, res_num, case when record = 'ATOM' or p then 'ATOM' else record end as record,
   case when record = 'ATOM' or p then {MAPPED} else res_name end as res_name from r join p using (ck, run)""")
def _(q: Input):
    return C.standardise_residues(q.fx_dirty).select("ck", "serial", "atom_name", "res_num", "record", "res_name")


@query("select_representation", "fx_atoms", "select ck, serial, atom_type from (select *, aa || atom_name as atom_type from fx_atoms) t where atom_type in ("
       + ", ".join(f"'{t}'" for t in K.representation("sidechains")) + ")")
def _(q: Input):
    return C.select_representation(q.fx_atoms, "sidechains").select("ck", "serial", "atom_type")


@query("select_atoms", "fx_atoms", """select 'bb' as kind, ck, serial from fx_atoms where atom_name in ('N','CA','C','O','OXT')
  union all select 'sc', ck, serial from fx_atoms where atom_name not in ('N','CA','C','O','OXT')
  union all select 'not_cys_s', ck, serial from fx_atoms where not (res_name = 'CYS' and element = 'S')""")
def _(q: Input):
    parts = {"bb": C.select_atoms(q.fx_atoms, names="BB"), "sc": C.select_atoms(q.fx_atoms, names="SC"),
             "not_cys_s": C.select_atoms(q.fx_atoms, residues=["CYS"], elements=["S"], negate=True)}
    frames = [df.select(F.lit(k).alias("kind"), "ck", "serial") for k, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("select_residues", "fx_res fx_atoms", """select ck, serial, atom_name from fx_atoms a where exists
  (select 1 from fx_res r where r.ck = a.ck and r.res_num = a.res_num and r.ss = 'H')""")
def _(q: Input):
    return C.select_residues(q.fx_atoms, q.fx_res.where("ss = 'H'")).select("ck", "serial", "atom_name")


@query("residue_class", "fx_dirty", f"""select structure_id, res_name, case when res_name in {STD} or res_name = 'MSE' then 'AMINO-ACID'
   when res_name in ('HOH','H2O','WAT','DOD') then 'SOLVENT' else 'HETERO' end as class, res_name in {STD} as std from fx_dirty group by structure_id, res_name""")
def _(q: Input):
    std = C.residue_names(q.fx_dirty, "std").select("structure_id", "res_name", F.lit(True).alias("s"))
    return (C.residue_names(q.fx_dirty).join(std, ["structure_id", "res_name"], "left")
            .select("structure_id", "res_name", "class", F.coalesce("s", F.lit(False)).alias("std")))


@query("mask_residues", "fx_res", "select ck, idx, aa from fx_res where ss <> ' '")
def _(q: Input):
    masks = CH.chain_string(q.fx_res, F.when(F.col("ss") == " ", "-").otherwise(F.col("ss")), "mask")
    return C.mask_residues(q.fx_res, masks).select("ck", "idx", "aa")


@query("slice_by_sequence", "fx_res", """with s as (select ck, string_agg(aa, '' order by idx) as seq from fx_res group by ck)
  select ck, idx, aa from fx_res join s using (ck) where instr(seq, 'NKGD') > 0 and idx between instr(seq, 'NKGD') - 1 and instr(seq, 'NKGD') + 2""")
def _(q: Input):
    return C.slice_by_sequence(q.fx_res, CH.chain_sequence(q.fx_res), "NKGD").select("ck", "idx", "aa")


@query("has_only_ca", "fx_atoms", """select ck, case when bool_and(atom_name = 'CA') then 'Yes' else 'No' end as only_ca from fx_atoms
  where chain = 'A' or atom_name = 'CA' group by ck""")
def _(q: Input):
    return C.has_only_ca(q.fx_atoms.where("chain = 'A' or atom_name = 'CA'"))


@query("renumber_residues", "fx_clean", """select ck, res_num as auth_num, cast(row_number() over (partition by ck order by s) - 1 as int) as idx
  from (select ck, res_num, min(serial) as s from fx_clean group by ck, res_num) t""")
def _(q: Input):
    return C.number_map(C.clean(q.fx_dirty)).select("ck", "auth_num", "idx")


@query("renumber_atoms_chains_models", "fx_dirty", """with c as (select structure_id, chain, row_number() over (partition by structure_id order by min(serial), chain) as k
    from fx_dirty group by structure_id, chain)
  select structure_id, model, chain, serial, cast(row_number() over (partition by structure_id, model order by serial) + 99 as int) as new_serial,
    chr(cast(64 + k as int)) as new_chain, cast(model + 4 as int) as new_model from fx_dirty join c using (structure_id, chain)""")
def _(q: Input):
    return (C.renumber_atoms_chains_models(q.fx_dirty, 100, 5)
            .select("structure_id", "model", "chain", "serial", "new_serial", "new_chain", "new_model"))
