"""Queries of the potential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldframe.catalog.base import Input, query, r, rs
from foldframe.operators import chain as CH
from foldframe.operators import potential as P
from foldframe.plans.fixtures import register_view
from foldframe.session import written

register_view("fx_pd", ("fx_res",), """select structure_id, case when la < ra then la || 'CA' || ra || 'CA' else ra || 'CA' || la || 'CA' end as pair, d,
    case when la < ra then lck else rck end as ckl, case when la < ra then rck else lck end as ckr,
    case when la < ra then ln else rn end as numl, case when la < ra then rn else ln end as numr,
    case when la < ra then lc else rc end as cl, case when la < ra then rc else lc end as cr
  from (select a.structure_id, a.aa as la, b.aa as ra, a.ck as lck, b.ck as rck, a.res_num as ln, b.res_num as rn, a.chain as lc, b.chain as rc,
      sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as d
    from fx_res a join fx_res b on a.structure_id = b.structure_id
    where (a.chain = b.chain and b.res_num - a.res_num > 3 and b.res_num - a.res_num < 5100) or a.chain < b.chain) t where d < 15 and d > 0""")
register_view("fx_hist", ("fx_pd",), "select pair, cast(ceil(round(d / 0.1e0, 6)) as int) - 1 as bin, count(*) as n from fx_pd group by 1, 2")
register_view("fx_freq", ("fx_hist",), """select t.pair, s.bin, coalesce(h.n, 0) as n, coalesce(h.n, 0) / t.t as f
  from (select pair, sum(n) as t from fx_hist group by pair) t join (select unnest(range(0, 150)) as bin) s on true
  left join fx_hist h on h.pair = t.pair and h.bin = s.bin""")
register_view("fx_ref", ("fx_hist",), "select bin, sum(n) / (select sum(n) from fx_hist) as f from fx_hist group by bin")
register_view("fx_pot", ("fx_freq", "fx_ref"), """select pair, bin, case when e = 10 and coalesce(bool_or(e <> 10) over (partition by pair order by bin
    rows between unbounded preceding and 1 preceding), false) then 0e0 else e end as e
  from (select pair, bin, case when e = 10 and lag(e) over w <> 10 and lead(e) over w <> 10 then (lag(e) over w + lead(e) over w) / 2
      when e <> 10 and lead(e) over w = 10 and lead(e, 2) over w = 10 then 10e0 else e end as e
    from (select pair, bin, case when e = 0 then 10e0 else e end as e from
      (select q.pair, cast(q.bin as int) as bin, case when g.f > 0 and q.f > 0 then -ln(q.f / g.f) else 0e0 end as e from fx_freq q left join fx_ref g on g.bin = q.bin) a) b
    window w as (partition by pair order by bin)) c""")
register_view("fx_pe", ("fx_pd", "fx_pot"), """select s.*, coalesce(case when t <= 0 then y0.e when t >= 149 then y0.e else y0.e + (t - k) * (y1.e - y0.e) end, 0e0) as e
  from (select *, greatest(0, least(149, cast(floor(t) as int))) as k from (select *, round((d - 0.1e0/2) / 0.1e0, 9) as t from fx_pd where ckl = ckr) u) s
  left join fx_pot y0 on y0.pair = s.pair and y0.bin = s.k left join fx_pot y1 on y1.pair = s.pair and y1.bin = s.k + 1""")
register_view("fx_re", ("fx_pe",), """select ck, res_num, sum(e) as e from (select ckl as ck, numl as res_num, e from fx_pe
  union all select ckr, numr, e from fx_pe) t group by ck, res_num""")


def ca_atoms(q: Input):
    return q.fx_res.select("structure_id", "chain", "ck", "res_num", F.concat("aa", F.lit("CA")).alias("atom_type"), "x", "y", "z")


def pairs(q: Input, inter: bool = True):
    return P.pair_distances(ca_atoms(q), inter=inter)


def trained(q: Input):
    return P.train(pairs(q))


def scored(q: Input):
    return P.linear_energy(pairs(q, inter=False), trained(q))


@query("pair_distances", "fx_pd", f"""select structure_id, pair, {rs('d')} as d, cast(numl as string) || cl as resl, cast(numr as string) || cr as resr from fx_pd""")
def _(q: Input):
    return pairs(q).select("structure_id", "pair", r("d").alias("d"), "resl", "resr")


@query("distance_histogram", "fx_hist", "select pair, bin, n from fx_hist")
def _(q: Input):
    return P.distance_histogram(pairs(q))


@query("pair_frequencies", "fx_freq", "select pair, cast(bin as int) as bin, cast(n as bigint) as n, round(f, 6) as f from fx_freq")
def _(q: Input):
    return P.pair_frequencies(P.distance_histogram(pairs(q))).select("pair", "bin", "n", F.round("f", 6).alias("f"))


@query("reference_frequencies", "fx_ref", "select bin, round(f, 6) as f from fx_ref")
def _(q: Input):
    return P.reference_frequencies(P.distance_histogram(pairs(q))).select("bin", F.round("f", 6).alias("f"))


@query("pseudo_energy", "fx_pot", f"select pair, bin, {rs('e')} as e from fx_pot")
def _(q: Input):
    return trained(q).select("pair", "bin", r("e").alias("e"))


@query("kde_frequencies", "fx_pd", f"""with x as (select pair, round(d, 3) as x, count(*) as n from fx_pd group by 1, 2),
  st as (select pair, count(*) as m, stddev_samp(x) as sd, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34e0 as iqr, min(x) as lo, max(x) as hi
    from (select pair, round(d, 3) as x from fx_pd) t group by pair having count(*) > 1),
  bw as (select *, case when iqr > 0 then least(sd, iqr) else sd end * 0.9e0 * pow(cast(m as double), -0.2e0) as bw from st),
  gr as (select b.*, cast(s.bin as int) as bin, (s.bin + 0.5e0) * 0.1e0 as c from bw b join (select unnest(range(0, 150)) as bin) s on true where bw > 0),
  fl as (select pair, cast(ceil(round(x / 0.1e0, 6)) as int) - 1 as bin from x group by 1, 2),
  lv as materialized (select g.* from gr g join fl on fl.pair = g.pair and fl.bin = g.bin where c between lo - 3 * bw and hi + 3 * bw),
  de as (select l.pair, l.bin, sum(x.n * (exp(-0.5e0 * ((c - x.x) / bw) * ((c - x.x) / bw)) / (bw * sqrt(2 * pi()))) / m) as f from lv l join x on x.pair = l.pair group by l.pair, l.bin)
  select g.pair, g.bin, {rs('coalesce(de.f, 0e0)')} as f from gr g left join de on de.pair = g.pair and de.bin = g.bin""")
def _(q: Input):
    return P.kde_frequencies(pairs(q)).select("pair", "bin", r("f").alias("f"))


@query("top_distances", "fx_pd", f"""select structure_id, pair, {rs('d')} as d, resl, resr from (select structure_id, pair, d, cast(numl as string) || cl as resl,
    cast(numr as string) || cr as resr from fx_pd) t order by t.d, pair, structure_id, resl, resr limit 100""")
def _(q: Input):
    return P.top_distances(pairs(q)).select("structure_id", "pair", r("d").alias("d"), "resl", "resr")


@query("top_energies", "fx_pot", f"select pair, {rs('min(e)')} as e from fx_pot group by pair")
def _(q: Input):
    return P.top_energies(trained(q)).select("pair", r("e").alias("e"))


@query("top_occurrences", "fx_hist", "select pair, cast(sum(n) as bigint) as n from fx_hist group by pair")
def _(q: Input):
    return P.top_occurrences(P.distance_histogram(pairs(q)))


@query("missing_pairs", "fx_pd", """with a as (select unnest(string_split('A C D E F G H I K L M N P Q R S T V W Y', ' ')) as a)
  select x.a || 'CA' || y.a || 'CA' as pair from a x join a y on x.a <= y.a where not exists
    (select 1 from fx_pd p where p.d < 4 and p.pair = x.a || 'CA' || y.a || 'CA')""")
def _(q: Input):
    return P.missing_pairs(pairs(q).where("d < 4"), "CA")


@query("linear_energy", "fx_pe", f"select ckl as ck, pair, numl, numr, {rs('d')} as d, {rs('e')} as e from fx_pe")
def _(q: Input):
    return scored(q).select(F.col("ckl").alias("ck"), "pair", "numl", "numr", r("d").alias("d"), r("e").alias("e"))


CUBIC_SQL = f"""with recursive r as materialized (select pair, bin as k, 6 * (lead(e) over w - 2 * e + lag(e) over w) / (0.1e0 * 0.1e0) as r from fx_pot window w as (partition by pair order by bin)),
  fwd(pair, k, c, d) as (select pair, 1, 0.25e0, r / 4 from r where k = 1
    union all select f.pair, f.k + 1, 1 / (4 - f.c), (r.r - f.d) / (4 - f.c) from fwd f join r on r.pair = f.pair and r.k = f.k + 1 where f.k < 148),
  done as materialized (select * from fwd),
  bwd(pair, k, m) as (select pair, 148, d from done where k = 148
    union all select b.pair, b.k - 1, f.d - f.c * b.m from bwd b join done f on f.pair = b.pair and f.k = b.k - 1 where b.k > 1),
  m as (select * from bwd union all select distinct pair, 0, 0e0 from fx_pot union all select distinct pair, 149, 0e0 from fx_pot),
  seg as (select pair, k, e, (m1 - m0) / 0.6e0 as a, m0 / 2 as b, (e1 - e) / 0.1e0 - 0.1e0 * (2 * m0 + m1) / 6 as c from
    (select p.pair, p.bin as k, p.e, m.m as m0, lead(p.e) over w as e1, lead(m.m) over w as m1 from fx_pot p join m on m.pair = p.pair and m.k = p.bin window w as (partition by p.pair order by p.bin)) x where e1 is not null),
  co as (select pair, k, a, b, c, e from seg union all select pair, -1, 0e0, b, c, e from seg where k = 0
    union all select s.pair, 149, 0e0, 0e0, s.c + 2 * s.b * 0.1e0 + 3 * s.a * 0.01e0, p.e from seg s join fx_pot p on p.pair = s.pair and p.bin = 149 where s.k = 148),
  pd as (select *, greatest(-1, least(149, cast(floor(round((d - 0.05e0) / 0.1e0, 9)) as int))) as k from fx_pd where ckl = ckr)
  select ckl as ck, pair, numl, numr, {rs('d')} as d, {rs('e')} as e from (select t.ckl, t.pair, t.numl, t.numr, t.d,
    coalesce(((c.a * h + c.b) * h + c.c) * h + c.e, 0e0) as e from (select *, d - (greatest(k, 0) + 0.5e0) * 0.1e0 as h from pd) t left join co c on c.pair = t.pair and c.k = t.k) u"""


@query("cubic_energy", "fx_pd fx_pot", CUBIC_SQL)
def _(q: Input):
    e = P.cubic_energy(pairs(q, inter=False), trained(q))
    return e.select(F.col("ckl").alias("ck"), "pair", "numl", "numr", r("d").alias("d"), r("e").alias("e"))


@query("structure_energy", "fx_pe fx_re", f"""select t.ck, t.n_pairs, {rs('t.e')} as e, {rs('u.e')} as residue_sum from
  (select ckl as ck, sum(e) as e, count(*) as n_pairs from fx_pe group by ckl) t join (select ck, sum(e) as e from fx_re group by ck) u using (ck)""")
def _(q: Input):
    pe = written(scored(q).select("ckl", "ckr", "numl", "numr", "e"), "pair-energies")  # read twice, met once
    both = P.residue_energy(pe).groupBy("ck").agg(F.sum("e").alias("s"))
    return P.structure_energy(pe).join(both, "ck").select("ck", "n_pairs", r("e").alias("e"), r("s").alias("residue_sum"))


@query("window_energy", "fx_re fx_res", f"""with e as (select r.ck, r.idx, coalesce(x.e, 0e0) as e from fx_res r left join fx_re x on x.ck = r.ck and x.res_num = r.res_num)
  select ck, idx, {rs('m')} as mean_e from (select ck, idx, avg(e) over w as m, count(*) over w as n from e
    window w as (partition by ck order by idx rows between 4 preceding and 5 following)) t where n = 10""")
def _(q: Input):
    e = q.fx_res.select("ck", "idx", "res_num").join(P.residue_energy(scored(q)), ["ck", "res_num"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    return CH.window_energy(e, 10).select("ck", "idx", r("mean_e").alias("mean_e"))


@query("decoy_zscore")
def _(q: Input):
    members = q.fx_res.select("ck", F.concat(F.lit("whole "), "ck").alias("subset"), "res_num")
    potential = written(trained(q), "potential", bounded=True)
    z = P.decoy_zscore(P.linear_energy(pairs(q, inter=False), potential), q.fx_res, members, potential)
    return z.select("ck", "subset", *[r(c, 4).alias(c) for c in ("e", "mean", "sd", "z")], P.aul_percent(F.col("z")).alias("aul"))


@query("subset_energy", "fx_pe fx_res fx_pu", f"""with m as (select r.ck, cast(u.pu as string) as subset, r.res_num from fx_res r join fx_pu u on u.ck = r.ck and r.idx between u.s and u.e),
  s as (select ckl as ck, a.subset, sum(e) as e from fx_pe p join m a on a.ck = p.ckl and a.res_num = p.numl join m b on b.ck = p.ckr and b.res_num = p.numr and b.subset = a.subset group by 1, 2)
  select t.ck, t.subset, {rs('coalesce(s.e, 0e0)')} as e from (select distinct ck, subset from m) t left join s on s.ck = t.ck and s.subset = t.subset""")
def _(q: Input):
    return P.subset_energy(scored(q), pu_members(q)).select("ck", "subset", r("e").alias("e"))


def pu_members(q: Input):
    at = q.fx_pu.select("ck", F.col("pu").cast("string").alias("subset"), F.explode(F.sequence("s", "e")).alias("idx"))
    return q.fx_res.select("ck", "idx", "res_num").join(at, ["ck", "idx"]).select("ck", "subset", "res_num")


@query("aul_percent", "fx_res", f"""select ck, idx, {rs('z')} as z, case when abs(z) >= 1 then cast(trunc((1 - 1 / (z * z)) * 100) as int) else 0 end as aul
  from (select ck, idx, x / 5.123e0 as z from fx_res) t""")
def _(q: Input):
    return q.fx_res.select("ck", "idx", (F.col("x") / 5.123).alias("z")).select("ck", "idx", r("z").alias("z"), P.aul_percent(F.col("z")).alias("aul"))


@query("write_pair_table", "fx_pe", f"select pair, cast(numl as string) || cl || '-' || cast(numr as string) || cr as residues, {rs('d')} as d, {rs('e')} as e from fx_pe")
def _(q: Input):
    from foldframe.session import scratch_path
    from foldframe.sources import writers

    path = scratch_path(q.spark, "pairs")
    writers.write_pair_table(scored(q).select(r("e").alias("e"), r("d").alias("d"), "pair", "resl", "resr"), path)
    return q.spark.read.option("sep", "\t").schema("e double, d double, pair string, residues string").csv(path)
