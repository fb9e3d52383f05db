"""Queries of the checks and whole-chain statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.catalog.base import Input, query, r, rs
from foldframe.catalog.sqlgeom import dist, vec
from foldframe.operators import chain as CH
from foldframe.operators import checks as C

SIDE = ", ".join(f"('{K.ONE_TO_THREE[aa]}', '{a}')" for aa, side in K.SIDE_CHAIN.items() for a in side.split())


@query("disulfides", "fx_atoms", f"""with s as (select structure_id, chain, res_num, x, y, z from fx_atoms where res_name = 'CYS' and atom_name = 'SG'),
  p as (select a.structure_id, cast(a.res_num as string) || a.chain as resl, cast(b.res_num as string) || b.chain as resr, {dist(vec('a.'), vec('b.'))} as d,
    a.chain = b.chain as intra, a.res_num % 2 = 0 as declared from s a join s b on a.structure_id = b.structure_id
    where a.chain < b.chain or (a.chain = b.chain and b.res_num - a.res_num >= 2))
  select structure_id, resl, resr, {rs('d')} as d, intra, declared from p where d < 8""")
def _(q: Input):
    sg = q.fx_atoms.where("atom_name = 'SG' and res_num % 2 = 0").select("structure_id", F.concat(F.col("res_num").cast("string"), "chain").alias("resl"))
    any_r = q.fx_atoms.where("atom_name = 'SG'").select("structure_id", F.concat(F.col("res_num").cast("string"), "chain").alias("resr"))
    out = C.disulfides(q.fx_atoms, 8.0, 2, sg.join(any_r, "structure_id"))
    return out.select("structure_id", "resl", "resr", r("d").alias("d"), "intra", "declared")


@query("neighbours_around", "fx_atoms fx_res", f"""with c as (select a.structure_id, a.ck, a.res_num, a.x, a.y, a.z, r.x as rx, r.y as ry, r.z as rz
    from fx_atoms a join fx_res r on r.ck = a.ck and r.idx = a.idx)
  select distinct l.structure_id, l.ck as centre_ck, l.res_num as centre, r.ck, r.res_num from c l join c r on l.structure_id = r.structure_id
  where l.ck || '_' || cast(l.res_num as string) in (select ck || '_' || cast(res_num as string) from fx_res where aa = 'W')
    and (l.ck <> r.ck or l.res_num <> r.res_num) and {dist(vec('l.'), vec('r.'))} <= 4 and {dist(vec('l.r'), vec('r.r'))} <= 15""")
def _(q: Input):
    return C.neighbours_around(q.fx_atoms, q.fx_res.where("aa = 'W'"), 4.0)


@query("solvent_accessibility")
def _(q: Input):
    return C.solvent_accessibility(q.fx_atoms)


@query("exposed_residues")
def _(q: Input):
    return C.exposed_residues(C.solvent_accessibility(q.fx_atoms), q.fx_res.select("ck", "res_num", "aa")).select("ck", "res_num", "aa", "area", r("relative").alias("relative"))


@query("missing_atoms", "fx_atoms", f"""with w (res_name, atom) as (values {SIDE}), k as (select distinct ck, res_num, res_name from fx_atoms),
  m as (select 'side' as part, k.ck, k.res_num, w.atom from k join w on w.res_name = k.res_name where not exists
      (select 1 from fx_atoms a where a.ck = k.ck and a.res_num = k.res_num and a.atom_name = w.atom)
    union all select 'backbone', ck, res_num, 'O' from fx_atoms where atom_name = 'N' and idx % 7 = 0)
  select part, ck, res_num, string_agg(atom, ' ' order by atom) as missing from m group by part, ck, res_num""")
def _(q: Input):
    side = C.missing_atoms(q.fx_atoms, "side").withColumn("part", F.lit("side"))
    bb = C.missing_atoms(q.fx_atoms.where("not (atom_name = 'O' and idx % 7 = 0)")).withColumn("part", F.lit("backbone"))
    return side.unionByName(bb).select("part", "ck", "res_num", F.array_join("missing", " ").alias("missing"))


@query("altloc_residues", "fx_dirty", """select ck, res_num, icode, bool_or(atom_name in ('N','CA','C','O','OXT')) as backbone,
  bool_or(atom_name not in ('N','CA','C','O','OXT')) as side_chain from fx_dirty where alt_loc <> ' ' and element <> 'H' group by ck, res_num, icode""")
def _(q: Input):
    return C.altloc_residues(q.fx_dirty)


@query("mean_ca_displacement", "fx_res", f"""select structure_id, {rs('avg(d)')} as mean_d, {rs('sqrt(avg(d * d))')} as rmsd, count(*) as n from
  (select a.structure_id, {dist(vec('a.'), vec('b.'))} as d from fx_res a join fx_res b on a.structure_id = b.structure_id and a.idx = b.idx
   where a.chain = 'A' and b.chain = 'B') t group by structure_id""")
def _(q: Input):
    d = C.mean_ca_displacement(q.fx_res.where("chain = 'A'"), q.fx_res.where("chain = 'B'"), ["structure_id"])
    return d.select("structure_id", r("mean_d").alias("mean_d"), r("rmsd").alias("rmsd"), "n")


SITE = "ck || '_' || lpad(cast(cast(floor(idx / 7e0) as int) as string), 3, '0')"


@query("dedup_sites", "fx_res", f"""with s as (select structure_id, {SITE} as site, aa, res_num, ss as part, 'E' || cast(idx % 2 as string) as ec from fx_res where aa in ('H','D','S','C')),
  a as (select structure_id, site, string_agg(distinct aa || cast(res_num as string) || part, ',' order by aa || cast(res_num as string) || part) as sg, max(ec) as ec,
    string_agg(distinct aa || part, ',' order by aa || part) as lg from s group by structure_id, site)
  select 'strict' as mode, structure_id, max(site) as site from a group by structure_id, sg, ec union all select 'loose', structure_id, max(site) from a group by structure_id, lg""")
def _(q: Input):
    sites = q.fx_res.where("aa in ('H','D','S','C')").select(
        "structure_id", F.expr(SITE).alias("site"), F.col("aa").alias("res_name"), "res_num", F.col("ss").alias("part"), F.lit(False).alias("het"),
        F.concat(F.lit("E"), (F.col("idx") % 2).cast("string")).alias("ec"))
    modes = [C.dedup_sites(sites, m == "strict").select(F.lit(m).alias("mode"), "structure_id", "site") for m in ("strict", "loose")]
    return modes[0].unionByName(modes[1])


@query("chain_census", "fx_dirty", """select structure_id, model, chain, count(distinct structure_id || '_' || cast(model as string) || '_' || chain) as n_chains,
   count(distinct structure_id || '_' || cast(model as string) || chain || cast(res_num as string) || icode || res_name) as n_residues,
   count(*) filter (record = 'ATOM') as n_atoms, count(*) filter (record <> 'ATOM') as n_het, cast(count(distinct element) as int) as n_elements
  from fx_dirty group by rollup (structure_id, model, chain)""")
def _(q: Input):
    return C.chain_census(q.fx_dirty)


@query("chain_type", "fx_dirty", """with k as (select distinct ck || '_' || record as ck, res_num, icode, res_name from fx_dirty),
  n as (select ck, count(*) filter (res_name <> 'HOH') as aa, count(*) filter (res_name = 'HOH') as sol from k group by ck)
  select ck, case when aa > 0 then 'Protein' when sol > 0 then 'SOLVENT' else 'HETERO' end as type from n""")
def _(q: Input):
    return C.chain_type(q.fx_dirty.withColumn("ck", F.concat_ws("_", "ck", "record")))


MASS = "case element " + " ".join(f"when '{k}' then {v}e0" for k, v in K.MASSES.items()) + " else 0e0 end"


@query("mass_and_centre", "fx_atoms", f"""with m as (select ck, x, y, z, {MASS} as m from fx_atoms),
  a as (select ck, sum(m) as mass, sum(m*x)/sum(m) as mx, sum(m*y)/sum(m) as my, sum(m*z)/sum(m) as mz, avg(x) as bx, avg(y) as by_, avg(z) as bz from m group by ck),
  d as (select m.ck, max(sqrt((x-bx)*(x-bx) + (y-by_)*(y-by_) + (z-bz)*(z-bz))) as radius from m join a on a.ck = m.ck group by m.ck)
  select a.ck, round(mass, 6) as mass, {rs("mx", 9)} as mx, {rs("my", 9)} as my, {rs("mz", 9)} as mz, {rs("bx", 9)} as bx, {rs("by_", 9)} as "by", {rs("bz", 9)} as bz,
    round(radius, 6) as radius from a join d on d.ck = a.ck""")
def _(q: Input):
    return C.mass_and_centre(q.fx_atoms).select("ck", *[r(c, 6).alias(c) for c in ("mass", "radius")],
                                                *[r(c, 9).alias(c) for c in ("mx", "my", "mz", "bx", "by", "bz")])


@query("chain_sequence", "fx_res", "select ck, string_agg(aa, '' order by idx) as seq from fx_res group by ck")
def _(q: Input):
    return CH.chain_sequence(q.fx_res)


@query("runtime_estimate", "fx_atoms", """select ck, n, cast(trunc(16.8e0 + 0.163e0 * n - 4.3e-5 * n * n) as int) as "full", cast(trunc(4.23e0 + 0.0412e0 * n - 8.42e-6 * n * n) as int) as fast
  from (select ck, count(distinct res_num) as n from fx_atoms group by ck) t""")
def _(q: Input):
    return C.runtime_estimate(q.fx_atoms)
