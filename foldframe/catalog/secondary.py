"""Queries of the secondary-structure operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldframe.catalog.along import residues
from foldframe.catalog.base import Input, query, r, rs
from foldframe.catalog.sqlgeom import dist, norm, shifted, sub, vec
from foldframe.operators import chain as CH
from foldframe.operators import secondary as SS
from foldframe.plans.fixtures import register_view
from foldframe.session import written

CO = sub(vec("pc"), vec("po"))
HSQL = ", ".join(f"case when aa <> 'P' and pcx is not null and {norm(CO)} > 0 then n{k} + {CO[i]} / {norm(CO)} else n{k} end as h{k}" for i, k in enumerate("xyz"))
register_view("fx_h", ("fx_res",), f"""select *, {HSQL} from (select *, {shifted('lag', 'c', 'pc')}, {shifted('lag', 'o', 'po')} from fx_res
  window w as (partition by ck order by idx)) t""")


def e_sql(d: str, a: str) -> str:
    ho, hc = dist(vec(f"{d}.h"), vec(f"{a}.o")), dist(vec(f"{d}.h"), vec(f"{a}.c"))
    nc, no = dist(vec(f"{d}.n"), vec(f"{a}.c")), dist(vec(f"{d}.n"), vec(f"{a}.o"))
    q = "-27888e0"
    return (f"cast(case when {d}.aa = 'P' then 0 when least({ho}, {hc}, {nc}, {no}) < 0.5e0 then -9900 "
            f"else greatest(floor({q} / {ho} - {q} / {hc} + {q} / {nc} - {q} / {no} + 0.5e0), -9900) end as int)")


NEAR = f"a.ck = b.ck and a.idx < b.idx and {dist(vec('a.'), vec('b.'))} < 9"
BONDS = f"""(
  select a.ck, a.idx as donor, b.idx as acceptor, {e_sql('a', 'b')} as e from fx_h a join fx_h b on {NEAR}
  union all select a.ck, b.idx, a.idx, {e_sql('b', 'a')} from fx_h a join fx_h b on {NEAR} where b.idx <> a.idx + 1) t where e < 0"""
register_view("fx_hb", ("fx_h",), f"""select * from (select *, row_number() over (partition by ck, donor order by e, acceptor) as rk,
    row_number() over (partition by ck, acceptor order by e, donor) as ark from {BONDS}) u where rk <= 2""")
register_view("fx_bond", ("fx_hb",), "select ck, donor, acceptor from fx_hb where e < -500")
register_view("fx_turn", ("fx_bond",), "select ck, acceptor as idx, donor - acceptor as n from fx_bond where donor - acceptor between 3 and 5")


def framed(q: Input):
    return CH.with_fragments(residues(q), max_cn=2.5)


def framed_once(q: Input):
    """Residues with their stretches, written as several steps read them."""
    return written(framed(q).select("ck", "idx", "aa", "n", "ca", "c", "o", "frag"), "residues")


def bonds(q: Input, res=None):
    return written(SS.hbond_energy(framed(q) if res is None else res), "hbonds")


@query("amide_hydrogen", "fx_h", f"select ck, idx, {rs('hx')} as hx, {rs('hy')} as hy, {rs('hz')} as hz from fx_h")
def _(q: Input):
    return SS.amide_hydrogen(framed(q)).select("ck", "idx", *[r(f"h.{k}").alias(f"h{k}") for k in "xyz"])


@query("hbond_energy", "fx_hb", "select ck, donor, acceptor, e, cast(rk as int) as rk, cast(ark as int) as ark from fx_hb")
def _(q: Input):
    return SS.hbond_energy(framed(q)).select("ck", "donor", "acceptor", "e", "rk", "ark")


@query("turns", "fx_turn", """with m as (select ck, n, idx + k as idx, k = 0 as a, k = n as b from fx_turn, (select unnest(range(0, 6)) as k) where k <= n)
  select ck, cast(idx as int) as idx, n, case when bool_or(a) and bool_or(b) then 'X' when bool_or(a) then '>' when bool_or(b) then '<' else cast(n as string) end as mark
  from m group by ck, idx, n""")
def _(q: Input):
    return SS.turns(framed(q), bonds(q))


COVER = "exists (select 1 from {v} h where h.ck = r.ck and r.idx between h.idx and h.idx + {k})"
CARGS = sub(vec(""), vec("p2")), sub(vec("f2"), vec(""))


@query("helix_symbols", "fx_turn fx_res", f"""with last as (select ck, max(idx) as last from fx_res group by ck),
  st as (select a.ck, a.idx, a.n from fx_turn a join fx_turn b on b.ck = a.ck and b.n = a.n and b.idx = a.idx - 1 join last l on l.ck = a.ck where a.idx + a.n <= l.last),
  h4 as (select * from st where n = 4), hh as (select r.ck, r.idx, {COVER.format(v='h4', k=3)} as h from fx_res r),
  g3 as (select s.ck, s.idx from st s where n = 3 and not exists (select 1 from hh where hh.ck = s.ck and hh.h and hh.idx between s.idx and s.idx + 2)),
  gg as (select r.ck, r.idx, h, {COVER.format(v='g3', k=2)} as g from hh r),
  i5 as (select s.ck, s.idx from st s where n = 5 and not exists (select 1 from gg where gg.ck = s.ck and (gg.h or gg.g) and gg.idx between s.idx and s.idx + 4)),
  ii as (select r.ck, r.idx, h, g, {COVER.format(v='i5', k=4)} as i, exists (select 1 from fx_turn t where t.ck = r.ck and r.idx > t.idx and r.idx < t.idx + t.n) as t from gg r),
  b as (select ck, idx, lag(idx, 2) over w is not null and lead(idx, 2) over w is not null and
     degrees(acos(case when {norm(CARGS[0])} * {norm(CARGS[1])} > 0 then least(1e0, greatest(-1e0, ({' + '.join(f'{a} * {c}' for a, c in zip(*CARGS, strict=True))}) / ({norm(CARGS[0])} * {norm(CARGS[1])}))) else 0e0 end)) > 70 as s
     from (select *, {shifted('lag', '', 'p2', 2)}, {shifted('lead', '', 'f2', 2)} from fx_res window w as (partition by ck order by idx)) k window w as (partition by ck order by idx))
  select x.ck, x.idx, case when h then 'H' when g then 'G' when i then 'I' when x.idx > 0 and x.idx < last and t then 'T' when x.idx > 0 and x.idx < last and coalesce(s, false) then 'S' else ' ' end as ss
  from ii x join b on b.ck = x.ck and b.idx = x.idx join last l on l.ck = x.ck""")
def _(q: Input):
    res = framed(q)
    return SS.helix_symbols(res, SS.turn_starts(res, bonds(q)), CH.ca_virtual_angles(res))


register_view("fx_bridge", ("fx_bond", "fx_res"), """with c as (select x.ck, x.donor - 1 as u, x.acceptor as v, 'P' as kind from fx_bond x join fx_bond y on y.ck = x.ck and y.donor = x.acceptor and y.acceptor = x.donor - 2
  union all select x.ck, x.donor - 1, x.acceptor + 1, 'A' from fx_bond x join fx_bond y on y.ck = x.ck and y.donor = x.acceptor + 2 and y.acceptor = x.donor - 2
  union all select x.ck, x.donor, x.acceptor, 'A' from fx_bond x join fx_bond y on y.ck = x.ck and y.donor = x.acceptor and y.acceptor = x.donor),
  p as (select c.ck, least(u, v) as i, greatest(u, v) as j, max(kind) as kind from c join (select ck, max(idx) as last from fx_res group by ck) l on l.ck = c.ck
    where abs(u - v) >= 3 and least(u, v) >= 1 and greatest(u, v) < last group by c.ck, least(u, v), greatest(u, v))
  select ck, i, j, kind from (select *, row_number() over (partition by ck, i order by j) as k from p) t where k <= 2""")
register_view("fx_ladder", ("fx_bridge",), """select ck, kind, count(*) as size from (select *, sum(b) over (partition by ck, kind, d order by i) as g from
  (select *, case when lag(i) over (partition by ck, kind, d order by i) + 1 = i then 0 else 1 end as b from
    (select *, case when kind = 'P' then j - i else j + i end as d from fx_bridge) x) y) z group by ck, kind, d, g""")


@query("bridges", "fx_bridge", "select ck, i, j, kind from fx_bridge")
def _(q: Input):
    return SS.bridges(framed(q), bonds(q))


def linked(q: Input):
    res = framed_once(q)
    found = written(SS.ladders(res, SS.bridges(res, bonds(q, res))), "runs")
    return written(SS.link_ladders(found, res), "ladders")


@query("ladders")
def _(q: Input):
    return linked(q)


@query("sheets")
def _(q: Input):
    return SS.sheets(linked(q))


@query("assign_ss")
def _(q: Input):
    return SS.assign_ss(framed_once(q), with_sheets=True)


register_view("fx_taken", ("fx_h",), f"""select ck, donor, acceptor from (select *, row_number() over (partition by ck, acceptor order by e, donor) as ark
  from {BONDS}) u where ark <= 2 and e < -500""")
register_view("fx_rung", ("fx_bridge",), """select ck, kind, row_number() over (partition by ck order by ib, j) as ladder, ib, ie, jb, je from
  (select ck, kind, min(i) as ib, max(i) as ie, min(j) as jb, max(j) as je, arg_min(j, i) as j from
    (select *, sum(b) over (partition by ck, kind, d order by i) as g from
      (select *, case when lag(i) over (partition by ck, kind, d order by i) + 1 = i then 0 else 1 end as b from
        (select *, case when kind = 'P' then j - i else j + i end as d from fx_bridge) x) y) z group by ck, kind, d, g) l""")
register_view("fx_linked", ("fx_rung",), """with recursive near as (select a.ck, a.ladder as a, b.ladder as b, b.ib - a.ie as gi, case when a.kind = 'P' then b.jb - a.je else a.jb - b.je end as gj
    from fx_rung a join fx_rung b on b.ck = a.ck and b.kind = a.kind and b.ladder > a.ladder and b.ib - a.ie between 0 and 5),
  edge as (select ck, a, b, row_number() over (partition by ck order by a, b) as k from near where gj >= 0 and (gj < 3 or gj < 6 and gi < 3)),
  taken as (select distinct ck, cast(0 as bigint) as k, cast([] as bigint[]) as ones, cast([] as bigint[]) as others from edge
    union all select t.ck, e.k, case when list_contains(ones, a) or list_contains(others, b) then ones else list_append(ones, a) end,
      case when list_contains(ones, a) or list_contains(others, b) then others else list_append(others, b) end from taken t join edge e on e.ck = t.ck and e.k = t.k + 1),
  link as (select ck, unnest(ones) as a, unnest(others) as b from (select ck, arg_max(ones, k) as ones, arg_max(others, k) as others from taken group by ck) x),
  h as (select ck, ladder, ladder as head from fx_rung r where not exists (select 1 from link where link.ck = r.ck and link.b = r.ladder)
    union all select link.ck, link.b, h.head from h join link on link.ck = h.ck and link.a = h.ladder)
  select r.*, h.head from fx_rung r join h on h.ck = r.ck and h.ladder = r.ladder""")
register_view("fx_sheet", ("fx_linked",), """with recursive touch as (select a.ck, a.ladder as a, b.ladder as b from fx_linked a join fx_linked b on b.ck = a.ck and (a.head = b.head
    or a.ib <= b.ie and b.ib <= a.ie or a.ib <= b.je and b.jb <= a.ie or a.jb <= b.ie and b.ib <= a.je or a.jb <= b.je and b.jb <= a.je)),
  reach as (select ck, a, b from touch union select r.ck, r.a, t.b from reach r join touch t on t.ck = r.ck and t.a = r.b),
  least as (select ck, a, min(b) as sheet from reach group by ck, a)
  select l.ck, sheet, count(distinct head) as size from fx_linked l join least on least.ck = l.ck and a = l.ladder group by l.ck, sheet having count(*) > 1 or max(ie - ib) > 0""")
LENGTH = "join (select ck, count(*) as l from fx_res group by ck) s on s.ck = b.ck"


@query("ss_statistics", "fx_taken fx_turn fx_res fx_linked fx_sheet", f"""select 'hbond' as kind, b.ck, cast(donor - acceptor as int) as "key", count(*) as n, {rs('100e0 * count(*) / any_value(l)', 4)} as per_100
   from fx_taken b {LENGTH} where abs(donor - acceptor) <= 5 group by b.ck, donor - acceptor
  union all select 'hbonds', b.ck, 0, count(*), {rs('100e0 * count(*) / any_value(l)', 4)} from fx_taken b {LENGTH} group by b.ck
  union all select 'helix', ck, cast(least(size, 30) as int), count(*), 0e0 from (select ck, count(*) as size from
    (select ck, idx, idx - row_number() over (partition by ck order by idx) as g from (select distinct a.ck, a.idx + k as idx
      from fx_turn a join fx_turn b on b.ck = a.ck and b.n = 4 and b.idx = a.idx - 1 join (select ck, max(idx) as last from fx_res group by ck) l on l.ck = a.ck, (select unnest(range(0, 4)) as k)
      where a.n = 4 and a.idx + 4 <= last) c) x group by ck, g) y group by ck, least(size, 30)
  union all select 'bridge_' || kind, b.ck, 0, cast(sum(ie - ib + 2) as bigint), {rs('100e0 * sum(ie - ib + 2) / any_value(l)', 4)} from fx_linked b {LENGTH} group by kind, b.ck
  union all select 'ladder_' || kind, ck, cast(least(size, 30) as int), count(*), 0e0 from (select ck, kind, sum(ie - ib + 1) as size from fx_linked group by ck, kind, head) t group by kind, ck, least(size, 30)
  union all select 'sheet', ck, cast(least(size, 30) as int), count(*), 0e0 from fx_sheet group by ck, least(size, 30)""")
def _(q: Input):
    res = framed_once(q)
    ranked = written(SS.ranked_bonds(res).where("rk <= 2 or ark <= 2"), "hbonds")
    hb = ranked.where("rk <= 2")
    lads = written(SS.link_ladders(written(SS.ladders(res, SS.bridges(res, hb)), "runs"), res), "ladders")
    states = SS.helix_symbols(res, SS.turn_starts(res, hb), res.select("ck", "idx", F.lit(None).cast("string").alias("bend")))  # H goes over all others
    whole = lambda df, kind, key: df.select(kind.alias("kind"), "ck", key.alias("key"), "n", r("per_100", 4).alias("per_100"))
    out = whole(SS.hbond_offsets(res, ranked), F.lit("hbond"), F.col("offset")).unionByName(whole(SS.hbond_totals(res, ranked), F.lit("hbonds"), F.lit(0)))
    out = out.unionByName(whole(SS.bridge_bonds(res, lads), F.concat(F.lit("bridge_"), "bridge"), F.lit(0)))
    sizes = SS.ladder_sizes(lads)
    for kind, of in (("helix", SS.helix_sizes(res, states)), *((f"ladder_{k}", sizes.where(F.col("kind") == k)) for k in "PA"), ("sheet", SS.sheet_sizes(SS.sheets(lads)))):
        out = out.unionByName(SS.size_histogram(of, kind).select("kind", "ck", F.col("size").alias("key"), "n", F.lit(0.0).alias("per_100")))
    return out
