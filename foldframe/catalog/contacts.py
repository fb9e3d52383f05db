"""Queries of the contact, block-sum and cut operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldframe.catalog.along import residues
from foldframe.catalog.base import Input, query, r, rs
from foldframe.operators import chain as CH
from foldframe.operators import contacts as CT
from foldframe.operators import cuts as CU
from foldframe.plans.fixtures import register_view
from foldframe.session import written

register_view("fx_con", ("fx_res",), """select a.ck, a.idx as i, b.idx as j, 1e0 / (1e0 + exp((sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)
  + (a.z-b.z)*(a.z-b.z)) - 6e0) / 1.5e0)) as p from fx_res a join fx_res b on a.ck = b.ck""")
register_view("fx_pre", ("fx_con",), """select ck, i, j, sum(t) over (partition by ck, j order by i) as c from
  (select ck, i, j, sum(p) over (partition by ck, i order by j) as t from fx_con) s""")
register_view("fx_blk", ("fx_con",), """select ck, i, j, sum(2e0 * u - 1e0 / (1e0 + exp(-4e0))) over (partition by ck, i order by j) as d from
  (select ck, i, j, sum(p) over (partition by ck, j order by i desc) as u from fx_con where i <= j) t""")
register_view("fx_seg", ("fx_res",), """select ck, 0 as seg, min(idx) as s, max(idx) as e from fx_res group by ck
  union all select ck, case when idx < 84 then 1 else 2 end, min(idx), max(idx) from fx_res group by ck, case when idx < 84 then 1 else 2 end""")
register_view("fx_pum", ("fx_con", "fx_pu"), """select c.ck, a.pu as a, b.pu as b, sum(c.p) as s from fx_con c join fx_pu a on a.ck = c.ck and c.i between a.s and a.e
  join fx_pu b on b.ck = c.ck and c.j between b.s and b.e group by c.ck, a.pu, b.pu""")


def chains(q: Input):
    return CU.packed_chains(residues(q).join(CH.cut_mask(q.fx_res), ["ck", "idx"]))


def segments(q: Input):
    return q.fx_seg.select("ck", F.col("seg").cast("int"), F.col("s").alias("start"), F.col("e").alias("end"))


def units(q: Input):
    """Residues with the fixed units of 28 positions."""
    pu = q.fx_pu.select("ck", F.col("pu").cast("int").alias("pu"), F.col("s").alias("start"), F.col("e").alias("end"))
    return CU.assign_units(residues(q), pu)


@query("contact_probability", "fx_con", f"select ck, i, j, {rs('p')} as p from fx_con where i <= j")
def _(q: Input):
    return CT.contact_probability(residues(q)).select("ck", "i", "j", r("p").alias("p"))


@query("prefix_sums", "fx_pre", "select ck, i, j, round(c, 6) as c from fx_pre where i <= j")
def _(q: Input):
    return CT.prefix_sums(CT.contact_probability(residues(q), blocks=True)).where("i <= j").select("ck", "i", "j", F.round("c", 6).alias("c"))


@query("best_single_cut", "fx_blk fx_seg fx_mask", """with m as materialized (select g.ck, g.seg, g.s, g.e, m.idx - 1 as i
   from fx_seg g join fx_mask m on m.ck = g.ck where m.cuttable and m.idx - 1 - g.s >= 30 and g.e - (m.idx - 1) >= 30),
 ma as materialized (select g.*, a.d as a from m g join fx_blk a on a.ck = g.ck and a.i = g.s and a.j = g.i),
 mb as materialized (select g.*, b.d as b from ma g join fx_blk b on b.ck = g.ck and b.i = g.i + 1 and b.j = g.e),
 c as (select g.*, (t.d - a - b) / 2 as c from mb g join fx_blk t on t.ck = g.ck and t.i = g.s and t.j = g.e),
 v as (select *, round((a*b - c*c) / ((a+c)*(b+c)), 9) as score from c where (a+c)*(b+c) <> 0)
 select ck, seg, round(score, 6) as score, i from (select *, row_number() over (partition by ck, seg order by score desc, i) as k from v where score > 0) t where k = 1""")
def _(q: Input):
    return CU.best_single_cut(chains(q), segments(q)).select("ck", "seg", F.round("score", 6).alias("score"), "i")


@query("best_double_cut", "fx_blk fx_seg fx_mask", """with m as materialized (select g.ck, g.seg, g.s, g.e, m.idx - 1 as i
   from fx_seg g join fx_mask m on m.ck = g.ck where m.cuttable and m.idx - 1 >= g.s + 29 and m.idx - 1 < g.e - 30 and m.idx - 1 + 60 < g.e - 15),
 n as materialized (select m.*, n.idx - 1 as j from m join fx_mask n on n.ck = m.ck where n.cuttable and n.idx - 1 >= m.i + 30 and n.idx - 1 <= m.e - 15),
 n1 as materialized (select g.*, x.d as a from n g join fx_blk x on x.ck = g.ck and x.i = g.i + 1 and x.j = g.j),
 n2 as materialized (select g.*, x.d as l1 from n1 g join fx_blk x on x.ck = g.ck and x.i = g.s and x.j = g.i),
 n3 as materialized (select g.*, x.d as l2 from n2 g join fx_blk x on x.ck = g.ck and x.i = g.s and x.j = g.j),
 n4 as materialized (select g.*, x.d as r1 from n3 g join fx_blk x on x.ck = g.ck and x.i = g.i + 1 and x.j = g.e),
 n5 as materialized (select g.*, x.d as r2 from n4 g join fx_blk x on x.ck = g.ck and x.i = g.j + 1 and x.j = g.e),
 c as (select g.*, x.d as t, (l2 - l1 - a + r1 - a - r2) / 2 as c from n5 g join fx_blk x on x.ck = g.ck and x.i = g.s and x.j = g.e),
 v as (select *, round((a*(t-a-2*c) - c*c) / ((a+c)*(t-a-c)), 9) as score from c where (a+c)*(t-a-c) <> 0)
 select ck, seg, round(score, 6) as score, i, j from (select *, row_number() over (partition by ck, seg order by score desc, i, j) as k from v where score > 0) t where k = 1""")
def _(q: Input):
    return CU.best_double_cut(chains(q), segments(q)).select("ck", "seg", F.round("score", 6).alias("score"), "i", "j")


@query("peel_level")
def _(q: Input):
    levels = written(CU.split_levels(chains(q)), "levels")
    out, _, _ = CU.peel_levels(residues(q), levels)
    return out.select("ck", "level", "ord", "start", "end", *[F.round(c, 6).alias(c) for c in ("score", "ci", "r", "max_cr", "min_density")])


@query("pu_contacts", "fx_pum", "select ck, cast(a as int) as a, cast(b as int) as b, round(s, 6) as s from fx_pum")
def _(q: Input):
    return CT.pu_contacts(units(q)).select("ck", "a", "b", F.round("s", 6).alias("s"))


@query("compaction_index", "fx_pum", f"""with p as (select *, s / sum(s) over (partition by ck) as p from fx_pum),
  m as (select *, sum(p) over (partition by ck, a) as m, sum(p) over (partition by ck, b) as n from p),
  i as (select ck, sum(case when p > 1e-5 and m > 1e-5 and n > 1e-5 then p * ln(p / (m * n)) else 0 end) as i from m group by ck)
  select ck, {rs('100 * sqrt(greatest(0e0, 1 - exp(-2 * i)))')} as ci, {rs('100 * greatest(0e0, 1 - exp(-2 * i))')} as r from i""")
def _(q: Input):
    return CT.compaction_index(CT.pu_contacts(units(q)), ["ck"]).select("ck", r("ci").alias("ci"), r("r").alias("r"))


@query("pu_quality", "fx_pum fx_pu", """with o as (select m.ck, m.a as pu, m.s as inn, u.e - u.s + 1 as size from fx_pum m join fx_pu u on u.ck = m.ck and u.pu = m.a where m.a = m.b),
  c as (select m.ck, max(m.s / (pow(x.size, 0.43e0) * pow(y.size, 0.43e0)) / ((x.inn + y.inn + m.s) / (x.size + y.size))) as max_cr from fx_pum m
    join o x on x.ck = m.ck and x.pu = m.a join o y on y.ck = m.ck and y.pu = m.b where m.a < m.b group by m.ck)
  select o.ck, round(min(inn / size), 6) as min_density, round(any_value(c.max_cr), 6) as max_cr from o left join c on c.ck = o.ck group by o.ck""")
def _(q: Input):
    u = units(q)
    sizes = u.groupBy("ck", "pu").agg(F.count(F.lit(1)).alias("size"))
    return CT.pu_quality(CT.pu_contacts(u), sizes, ["ck"]).select("ck", F.round("min_density", 6).alias("min_density"), F.round("max_cr", 6).alias("max_cr"))


@query("homogeneity", "fx_con fx_pu", f"""with s as (select c.*, u.pu, u.s as us, u.e as ue from fx_con c join fx_pu u on u.ck = c.ck and c.i between u.s and u.e and c.j between u.s and u.e
    where p > 0.5e0),
  t as (select *, sum(p) over (partition by ck, pu) as t1, sum(case when abs(i - j) < 6 then p else 0 end) over (partition by ck, pu) as t2 from s),
  h as (select ck, pu, any_value(us) as us, any_value(ue) as ue, sum(case when i < ue and j < ue then p / t1 * ln(p / t1) else 0 end) as h1,
    sum(case when i < ue and j < ue and abs(i - j) < 6 then p / t2 * ln(p / t2) else 0 end) as h2 from t group by ck, pu)
  select ck, cast(pu as int) as pu, {rs('(exp(-h1) - exp(-h2)) / (ue - us)')} as homogeneity from h where ue > us""")
def _(q: Input):
    return CT.homogeneity(units(q)).select("ck", "pu", r("homogeneity").alias("homogeneity"))


@query("contact_tiles", "fx_con fx_pu", f"""select c.ck, cast(a.pu as string) as label, c.i, c.j, {rs('c.p')} as p from fx_con c
  join fx_pu a on a.ck = c.ck and c.i between a.s and a.e and c.j between a.s and a.e where c.i <= c.j""")
def _(q: Input):
    boxes = q.fx_pu.select("ck", F.col("pu").cast("string").alias("label"), F.col("s").alias("start"), F.col("e").alias("end"))
    return CT.box_contacts(residues(q), boxes).select("ck", "label", "i", "j", r("p").alias("p"))
