"""Queries of the window operators along the chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldframe.catalog.base import Input, query, r, rs
from foldframe.catalog.sqlgeom import ALONG, cos_angle, cross, dihedral, dist, dot, norm, shifted, sub, vec
from foldframe.functions import geometry as G
from foldframe.operators import chain as CH
from foldframe.plans.fixtures import register_view


def residues(q: Input):
    return q.fx_res.select("ck", "idx", F.col("res_num").alias("auth_num"), "aa", G.point("nx", "ny", "nz").alias("n"),
                           G.point("x", "y", "z").alias("ca"), G.point("cx", "cy", "cz").alias("c"), G.point("ox", "oy", "oz").alias("o"), "ss")


CA = vec("")
register_view("fx_prev", ("fx_res",), f"""select *, {shifted('lag', '', 'p')}, {shifted('lag', 'c', 'pc')}, {shifted('lead', 'n', 'fn')},
  {shifted('lead', '', 'f')} from fx_res {ALONG}""")
register_view("fx_frag", ("fx_prev",), f"""select ck, idx, aa, cast(sum(b) over (partition by ck order by idx) as int) as frag from
  (select ck, idx, aa, case when px is not null and {dist(vec('p'), CA)} > 3.8008e0 then 1 else 0 end as b from fx_prev) t""")
register_view("fx_runs", ("fx_res",), """select ck, code, min(idx) as s, max(idx) as e from (select *, sum(n) over (partition by ck order by idx) as g from
  (select *, case when lag(code) over (partition by ck order by idx) <> code then 1 else 0 end as n from
    (select ck, idx, case when ss in ('H','G') then 1 when ss in ('E','B') then 2 else 0 end as code from fx_res) a) b) c group by ck, code, g""")
register_view("fx_mask", ("fx_runs", "fx_res"), """select r.ck, r.idx, not exists (select 1 from fx_runs t where t.ck = r.ck and t.code > 0
    and t.e - t.s between 1 and 8 and t.e < (select max(idx) from fx_res m where m.ck = r.ck) and r.idx between t.s and t.e - 1) as cuttable from fx_res r""")


@query("ss_reduce", "fx_res", """select ck, idx, case when ss in ('H','G','I') then 'H' when ss in ('E','B') then 'E' else 'C' end as ss3,
  case when ss in ('H','G') then 1 when ss in ('E','B') then 2 else 0 end as ss_code from fx_res""")
def _(q: Input):
    return CH.ss_reduce(q.fx_res).select("ck", "idx", "ss3", "ss_code")


@query("ss_runs", "fx_runs", 'select ck, cast(code as int) as code, s as "start", e as "end" from fx_runs')
def _(q: Input):
    return CH.ss_runs(CH.ss_reduce(q.fx_res).select("ck", "idx", F.col("ss_code").alias("code")), "code")


@query("cut_mask", "fx_mask", "select ck, idx, cuttable from fx_mask")
def _(q: Input):
    return CH.cut_mask(q.fx_res)


STEP_D = dist(vec("p"), CA)
OMEGA = dihedral(vec("p"), vec("pc"), vec("n"), CA)


@query("ca_trace_check", "fx_prev", f"""with d as (select ck, idx, aa, {STEP_D} as d, {OMEGA} as om from fx_prev),
 f as (select *, case when d < 3.7995e0 or (d < 3.8e0 and abs(om) < 20) then 1 when d > 3.8008e0 or d < 3.8e0 then 2 else 0 end as flag from d)
 select ck, case when count(*) filter (flag = 2) > 0 then 'Bad' else 'Ok' end as trace, count(*) filter (flag = 1 and aa = 'P') as n_cis_pro,
   count(*) filter (flag = 1 and aa <> 'P') as n_cis_pep, string_agg(cast(flag as string), '' order by idx) as flags from f group by ck""")
def _(q: Input):
    return CH.ca_trace_check(residues(q), 3.8, 3.8008, 3.7995)


@query("peptide_bond_check", "fx_prev", f"""select ck, case when max(l) = 2 then 'Bad' when max(l) = 1 then 'Poor' else 'Ok' end as geometry from
  (select ck, case when {dist(vec('pc'), vec('n'))} > 0.83e0 then 2 when {dist(vec('pc'), vec('n'))} > 0.8185e0 then 1 else 0 end as l from fx_prev) t group by ck""")
def _(q: Input):
    return CH.peptide_bond_check(residues(q), 0.8185, 0.83)


@query("chain_fragments", "fx_frag", """select ck, frag, min(idx) as "start", max(idx) as "end", string_agg(aa, '' order by idx) as seq from fx_frag group by ck, frag""")
def _(q: Input):
    return CH.chain_fragments(residues(q), max_ca=3.8008, ca_only=True)


def tors(ok: str, e: str) -> str:
    """SQL torsion rounded to (-180, 180], or 360."""
    v = rs(f"(case when {ok} then {e} else 360e0 end)", 4)
    return f"(case when {v} = -180 then 180e0 else {v} end)"


def deg(name: str):
    """Torsion column rounded to (-180, 180]."""
    return F.when(r(name, 4) == -180, 180.0).otherwise(r(name, 4)).alias(name)


OKP, OKN = f"{dist(vec('pc'), vec('n'))} <= 2", f"{dist(vec('c'), vec('fn'))} <= 2"


@query("backbone_torsions", "fx_prev", f"""select ck, idx, aa, {tors(OKP, dihedral(vec('pc'), vec('n'), CA, vec('c')))} as phi,
  {tors(OKN, dihedral(vec('n'), CA, vec('c'), vec('fn')))} as psi, {tors(OKN, dihedral(CA, vec('c'), vec('fn'), vec('f')))} as omega from fx_prev""")
def _(q: Input):
    t = CH.backbone_torsions(residues(q))
    return t.select("ck", "idx", "aa", deg("phi"), deg("psi"), deg("omega"))


P2, P1, F1, F2 = vec("p2"), vec("p1"), vec("f1"), vec("f2")


@query("ca_virtual_angles", "fx_res fx_frag", f"""with a as (select r.ck, r.idx, r.x, r.y, r.z, r.cx, r.cy, r.cz, r.ox, r.oy, r.oz, g.frag,
    lag(frag) over w as g1, lag(frag, 2) over w as g2, lead(frag, 2) over w as h2, {shifted('lag', 'r.', 'p1')}, {shifted('lag', 'r.', 'p2', 2)},
    {shifted('lead', 'r.', 'f1')}, {shifted('lead', 'r.', 'f2', 2)}, {shifted('lag', 'r.o', 'po')}, {shifted('lag', 'r.c', 'pc')}
    from fx_res r join fx_frag g on r.ck = g.ck and r.idx = g.idx window w as (partition by r.ck order by r.idx)),
 b as (select ck, idx, case when g1 = h2 then {dihedral(P1, CA, F1, F2)} else 360e0 end as alpha,
    case when g2 = h2 then degrees(acos({cos_angle(sub(CA, P2), sub(F2, CA))})) else 360e0 end as kappa,
    case when g1 = frag then {cos_angle(sub(vec('o'), vec('c')), sub(vec('po'), vec('pc')))} else 0e0 end as tco from a)
 select ck, idx, {tors('true', 'alpha')} as alpha, {rs('kappa', 4)} as kappa, {rs('tco', 4)} as tco,
   case when alpha = 360 then ' ' when alpha < 0 then '-' else '+' end as chirality, case when kappa <> 360 and kappa > 70 then 'S' else ' ' end as bend from b""")
def _(q: Input):
    t = CH.ca_virtual_angles(CH.with_fragments(residues(q), max_ca=3.8008, ca_only=True))
    return t.select("ck", "idx", deg("alpha"), r("kappa", 4).alias("kappa"), r("tco", 4).alias("tco"), "chirality", "bend")


@query("side_chain_torsions", "fx_atoms", f"""select n.ck, n.idx, n.aa, 1 as chi,
  {rs(dihedral(vec('n.'), vec('a.'), vec('b.'), vec('s.')), 4)} as angle
  from fx_atoms n join fx_atoms a on a.ck = n.ck and a.idx = n.idx and a.ord = 2 join fx_atoms b on b.ck = n.ck and b.idx = n.idx and b.ord = 5
  join fx_atoms s on s.ck = n.ck and s.idx = n.idx and s.ord = 6 where n.ord = 1""")
def _(q: Input):
    return CH.side_chain_torsions(q.fx_atoms).select("ck", "idx", "aa", "chi", r("angle", 4).alias("angle"))


N12 = cross(sub(F1, CA), sub(F2, F1))
HEIGHT = f"(case when {norm(N12)} > 0 then {dot(N12, sub(vec('f3'), F2))} / {norm(N12)} else 0e0 end)"


@query("ca_tetrad_descriptor", "fx_res", f"""with a as (select ck, idx, x, y, z, {shifted('lead', '', 'f1')}, {shifted('lead', '', 'f2', 2)},
   {shifted('lead', '', 'f3', 3)} from fx_res {ALONG})
 select ck, idx, {rs(dist(CA, F2))} as d13, {rs(dist(CA, vec('f3')))} as d14, {rs(dist(F1, vec('f3')))} as d24, {rs(HEIGHT)} as height,
  {rs(dist(CA, F1))} as d12, {rs(dist(F1, F2))} as d23, {rs(dist(F2, vec('f3')))} as d34 from a where f3x is not null""")
def _(q: Input):
    t = CH.ca_tetrad_descriptor(residues(q))
    return t.select("ck", "idx", *[r(c).alias(c) for c in ("d13", "d14", "d24", "height", "d12", "d23", "d34")])
