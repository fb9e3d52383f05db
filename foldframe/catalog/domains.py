"""Queries of the merge and quality operators."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.catalog.base import Input, query, r, rs
from foldframe.catalog.contacts import units
from foldframe.operators import contacts as CT
from foldframe.operators import chain as CH
from foldframe.operators import merge as M
from foldframe.operators import quality as QU
from foldframe.plans.fixtures import register_view
from foldframe.session import written

X, Y = f"((max_cr - {K.QX_MIN}e0) / {K.QX_MAX - K.QX_MIN}e0)", f"((min_density - {K.QY_MIN}e0) / {K.QY_MAX - K.QY_MIN}e0)"
DD, HH, VV = f"(abs({K.QM}e0 * {X} - {Y} + {K.QQ}e0) / sqrt(1 + {K.QM}e0 * {K.QM}e0))", f"abs({Y} - {K.QH}e0)", f"abs({X} - {K.QV}e0)"
SIDE = f"({K.QD}e0 * ({Y} - {K.QQ}e0) - (1 - {K.QQ}e0) * {X})"
DISTANCE = f"""(case when {Y} > {K.QH} and {X} < {K.QV} and {SIDE} < 0 then -least({DD}, {HH}, {VV})
  when {SIDE} < 0 and (({Y} > {K.QH} and {Y} < {K.QDH}) or ({X} > {K.QDV} and {X} < {K.QV}) or ({Y} < {K.QDH} and {X} > {K.QDV})) then -{DD}
  when {Y} < {K.QH} then -{HH} when {X} > {K.QV} then -{VV} else least({DD}, {HH}, {VV}) end)"""
STARS = "case when dist >= 0.15 then 5 when dist >= 0.05 then 4 when dist >= -0.05 then 3 when dist >= -0.15 then 2 else 1 end"

register_view("fx_part", ("fx_pu",), """select p.ck, cast(s.m as int) as m, p.pu, cast(bit_count(s.m & ((1 << cast(p.pu as bigint)) - 1)) as int) as dom, p.s, p.e
  from (select *, max(pu) over (partition by ck) as last from fx_pu) p join (select ck, unnest(range(0, 1 << cast(max(pu) as bigint))) as m from fx_pu group by ck) s on s.ck = p.ck""")
register_view("fx_dom", ("fx_part", "fx_pum"), """select d.*, s.inn from (select ck, m, dom, min(pu) as pa, max(pu) as pb, min(s) as s, max(e) as e, sum(e - s + 1) as size
    from fx_part group by ck, m, dom) d
  join (select a.ck, a.m, a.dom, sum(x.s) / 2 as inn from fx_part a join fx_part b on a.ck = b.ck and a.m = b.m and a.dom = b.dom
    join fx_pum x on x.ck = a.ck and x.a = a.pu and x.b = b.pu group by a.ck, a.m, a.dom) s on s.ck = d.ck and s.m = d.m and s.dom = d.dom""")
register_view("fx_ext", ("fx_part", "fx_pum", "fx_dom"), """select x.ck, x.m, x.i, x.j, x.ext, a.size as sa, b.size as sb, a.inn as ia, b.inn as ib
  from (select a.ck, a.m, a.dom as i, b.dom as j, sum(x.s) as ext from fx_part a join fx_part b on a.ck = b.ck and a.m = b.m and a.dom < b.dom
    join fx_pum x on x.ck = a.ck and x.a = a.pu and x.b = b.pu group by a.ck, a.m, a.dom, b.dom) x
  join fx_dom a on a.ck = x.ck and a.m = x.m and a.dom = x.i join fx_dom b on b.ck = x.ck and b.m = x.m and b.dom = x.j""")
register_view("fx_meas", ("fx_dom", "fx_ext"), """select d.*, coalesce(c.max_cr, 0e0) as max_cr from (select ck, m, cast(count(*) as int) as n, cast(min(size) as int) as min_size,
    case when count(*) = 1 then 0e0 else min(inn / size) end as min_density, case when count(*) = 1 then 0e0 else avg(inn / size) end as kappa from fx_dom group by ck, m) d
  left join (select ck, m, max(ext / (pow(sa, 0.43e0) * pow(sb, 0.43e0)) / ((ext + ia + ib) / (sa + sb))) as max_cr from fx_ext group by ck, m) c
  on c.ck = d.ck and c.m = d.m""")
register_view("fx_assign", ("fx_meas",), f"select *, case when n > 1 then {STARS} end as quality from (select *, {DISTANCE} as dist from fx_meas) t")


def matrix(q: Input):
    pu = q.fx_pu.select("ck", F.col("pu").cast("int").alias("pu"), F.col("s").alias("start"), F.col("e").alias("end"))
    return written(M.unit_matrix(CT.pu_contacts(units(q)), pu), "matrix")


def partitions(mat):
    """All contiguous groupings of the fixed units, numbered by their border bits m."""
    m = mat.select("ck", "npu", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, npu - 1) - 1"))).alias("m"))
    below = lambda u: F.bit_count(F.col("m").bitwiseAND((F.pow(F.lit(2), u) - 1).cast("int")))
    doms = F.transform(F.sequence(F.lit(0), F.bit_count("m")), lambda d: F.filter(F.sequence(F.lit(0), F.col("npu") - 1), lambda u: below(u) == d))
    return m.select("ck", "m", doms.alias("doms"))


def measured(q: Input):
    mat = matrix(q)
    return M.partition_measures(partitions(mat), mat)


def assigned(q: Input):
    return QU.with_quality(measured(q))


PAIR_SQL = """select *, nnc / ((ia + ib) / (sa * sb)) as ratio from (select *, greatest(ext, 0.001e0) / (pow(sa, 0.43e0) * pow(sb, 0.43e0)) as nnc from fx_ext) x"""


@query("merge_candidates", "fx_ext", f"""select ck, m, cast(i as int) as i, cast(j as int) as j, round(nnc, 6) as nnc, round(ratio, 6) as ratio, cast(rk as int) as "rank" from
  (select *, row_number() over (partition by ck, m order by round(ratio, 9) desc, i, j) as rk from ({PAIR_SQL}) p) t where rk = 1 or nnc > 0.01""")
def _(q: Input):
    mat = matrix(q)
    parts = partitions(mat)
    return (M.merge_candidates(parts, mat).join(parts, ["ck", "doms"])
            .select("ck", "m", "i", "j", F.round("nnc", 6).alias("nnc"), F.round("ratio", 6).alias("ratio"), "rank"))


@query("partition_measures", "fx_meas", """select ck, m, n, min_size, round(max_cr, 6) as max_cr, round(min_density, 6) as min_density, round(kappa, 6) as kappa from fx_meas""")
def _(q: Input):
    return measured(q).select("ck", "m", "n", "min_size", *[F.round(c, 6).alias(c) for c in ("max_cr", "min_density", "kappa")])


@query("merge_beam")
def _(q: Input):
    mat = matrix(q)
    found = M.partition_measures(M.merge_beam(mat), mat)
    return found.select("ck", F.to_json("doms").alias("doms"), "n", "min_size", *[F.round(c, 6).alias(c) for c in ("max_cr", "min_density", "kappa")])


@query("join_adjacent_units", "fx_part", """with p as (select ck, m as part, pu % 3 as dom, s, e from fx_part),
  o as (select *, case when lag(e) over w + 1 = s then 0 else 1 end as o from p window w as (partition by ck, part, dom order by s)),
  g as (select *, sum(o) over (partition by ck, part, dom order by s) as g from o)
  select ck, part, cast(dom as int) as dom, min(s) as "start", max(e) as "end" from g group by ck, part, dom, g
  union all select ck, m, cast(dom + 100 as int), min(s), max(e) from fx_part group by ck, m, dom""")
def _(q: Input):
    mat = matrix(q).select("ck", "npu", "starts", "ends")
    at = partitions(mat).join(mat, "ck").select("ck", F.col("m").alias("part"), F.posexplode("doms").alias("dom", "pus"), "starts", "ends")
    rows = at.select("ck", "part", "dom", F.explode("pus").alias("pu"), "starts", "ends")
    rows = rows.select("ck", "part", "dom", "pu", F.get("starts", "pu").alias("start"), F.get("ends", "pu").alias("end"))
    loose = rows.select("ck", "part", (F.col("pu") % 3).cast("int").alias("dom"), "start", "end")
    whole = rows.select("ck", "part", (F.col("dom") + 100).alias("dom"), "start", "end")
    return M.join_adjacent_units(loose.unionByName(whole))


@query("quality_distance", "fx_assign", f"select ck, m, {rs('dist')} as distance from fx_assign where n > 1")
def _(q: Input):
    return assigned(q).where("n > 1").select("ck", "m", r("distance").alias("distance"))


@query("quality_stars", "fx_assign", "select ck, m, n, cast(quality as int) as quality from fx_assign")
def _(q: Input):
    return assigned(q).select("ck", "m", "n", "quality")


ACCEPT = f"""min_density >= case when max_cr <= {K.COUNT_KNEE} then {K.COUNT_HORIZONTAL} when max_cr >= {K.COUNT_VERTICAL} then 10000 else max_cr * {K.COUNT_SLOPE}e0 + {K.COUNT_INTERCEPT}e0 end"""


@query("predict_domain_count", "fx_meas", f"""with b as (select *, row_number() over (partition by ck, n order by round(kappa, 9) desc, m desc) as k from fx_meas where n > 1),
  a as (select ck, n, bool_and({ACCEPT}) over w and count(*) over w = n - 1 as ok from b where k = 1 window w as (partition by ck order by n))
  select c.ck, cast(coalesce(max(a.n), 1) as int) as n_pred from (select distinct ck from fx_meas) c left join a on a.ck = c.ck and a.ok group by c.ck""")
def _(q: Input):
    return QU.predict_domain_count(measured(q))


PERMS = ", ".join(f"({n}, {p}, {k}, {v})" for n in range(1, 7) for p, perm in enumerate(permutations(range(n))) for k, v in enumerate(perm))


@query("partition_overlap", "fx_part fx_meas", f"""with f as (select ck, n, min(m) as fm from fx_meas group by ck, n),
  pr as (select f.ck, f.n, f.fm, x.m from f join fx_meas x on x.ck = f.ck and x.n = f.n),
  ov as materialized (select p.ck, p.n, p.m, a.dom as da, b.dom as db, sum(a.e - a.s + 1) as w from pr p join fx_part a on a.ck = p.ck and a.m = p.fm
    join fx_part b on b.ck = p.ck and b.m = p.m and b.pu = a.pu group by p.ck, p.n, p.m, a.dom, b.dom),
  pe (n, p, k, v) as (values {PERMS}),
  sc as (select o.ck, o.n, o.m, pe.p, sum(o.w) as w from ov o join pe on pe.n = o.n and pe.k = o.da and pe.v = o.db group by o.ck, o.n, o.m, pe.p),
  al as (select ck, sum(e - s + 1) as t from fx_pu group by ck)
  select s.ck, s.n, s.m, round(100e0 * max(s.w) / any_value(al.t), 6) as overlap from sc s join al on al.ck = s.ck group by s.ck, s.n, s.m""")
def _(q: Input):
    mat = matrix(q)
    parts = partitions(mat).withColumn("n", F.size("doms"))
    first = parts.groupBy("ck", "n").agg(F.min_by("doms", "m").alias("doms_a"))
    pairs = parts.withColumnRenamed("doms", "doms_b").join(first, ["ck", "n"])
    return QU.partition_overlap(pairs, mat).select("ck", "n", "m", F.round("overlap", 6).alias("overlap"))


@query("pick_alternatives")
def _(q: Input):
    mat = matrix(q)
    picked = QU.pick_alternatives(M.partition_measures(M.merge_beam(mat), mat), mat)
    return picked.select("ck", "alt_id", "n", "n_pred", F.to_json("doms").alias("doms"), r("kappa").alias("kappa"), "quality")


@query("ambiguity_index", "fx_assign", """select ck, cast(least(5, max(least(quality, k))) as int) as ambiguity from
  (select ck, quality, row_number() over (partition by ck order by quality desc) as k from fx_assign where quality is not null) t group by ck""")
def _(q: Input):
    return QU.ambiguity_index(assigned(q))


@query("domain_consistency", "fx_dom", """select ck, cast(pa as string) || '-' || cast(pb as string) as domain, count(*) as n from fx_dom group by ck, pa, pb""")
def _(q: Input):
    d = QU.domain_consistency(partitions(matrix(q)))
    return d.select("ck", F.concat_ws("-", F.array_min("domain").cast("string"), F.array_max("domain").cast("string")).alias("domain"), "n")


@query("junction_consistency", "fx_dom fx_assign", f"""with l as (select ck, count(*) as lines from fx_assign where quality is not null group by ck),
  j as (select d.ck, unnest([d.s, d.e]) as position, a.quality from fx_dom d join fx_assign a on a.ck = d.ck and a.m = d.m where a.quality is not null),
  g as (select j.ck, position, count(*) as n, count(*) / any_value(lines) as raw, sum(quality) / any_value(lines) as weighted from j join l on l.ck = j.ck group by j.ck, position)
  select ck, position, n, {rs('raw')} as raw, {rs('weighted')} as weighted from
   (select *, min(position) over (partition by ck) as lo, max(position) over (partition by ck) as hi from g) t where position > lo and position < hi""")
def _(q: Input):
    mat = matrix(q)
    rows = M.domain_fragments(assigned(q), mat)
    return QU.inner_junctions(QU.junction_consistency(rows)).select("ck", "position", "n", r("raw").alias("raw"), r("weighted").alias("weighted"))


@query("report_window", "fx_meas", """with a as (select ck, m as alt_id, n from fx_meas), b as (select *, max(case when alt_id = 0 then n end) over (partition by ck) as o,
   row_number() over (partition by ck, n order by alt_id) as k from a)
  select ck, cast(alt_id as int) as alt_id, n, cast(row_number() over (partition by ck order by alt_id <> 0, n, alt_id) as int) as line from b where k <= 2 and abs(n - o) <= 2""")
def _(q: Input):
    rows = partitions(matrix(q)).select("ck", F.col("m").alias("alt_id"), F.size("doms").alias("n"))
    return QU.report_window(rows).select("ck", "alt_id", "n", "line")


@query("author_numbering", "fx_pu fx_res", """select p.ck, cast(p.pu as int) as pu, a.res_num as auth_start, b.res_num as auth_end from fx_pu p
  join fx_res a on a.ck = p.ck and a.idx = p.s join fx_res b on b.ck = p.ck and b.idx = p.e""")
def _(q: Input):
    frags = q.fx_pu.select("ck", F.col("pu").cast("int").alias("pu"), F.col("s").alias("start"), F.col("e").alias("end"))
    return QU.author_numbering(frags, q.fx_res.select("ck", "idx", F.col("res_num").alias("auth_num"))).select("ck", "pu", "auth_start", "auth_end")


@query("palette_index", "fx_dom", """select ck, domain, cast((row_number() over (partition by ck order by m, dom, domain) - 1) % 60 as int) as colour from
  (select ck, domain, m, dom, row_number() over (partition by ck, domain order by m, dom) as k from
    (select ck, m, dom, cast(pa as string) || '-' || cast(pb as string) as domain from fx_dom) x) y where k = 1""")
def _(q: Input):
    rows = partitions(matrix(q)).select("ck", F.col("m").alias("alt_id"), F.posexplode("doms").alias("dom", "d"))
    name = F.concat_ws("-", F.array_min("d").cast("string"), F.array_max("d").cast("string"))
    return CH.palette_index(rows.select("ck", "alt_id", "dom", name.alias("domain")))


