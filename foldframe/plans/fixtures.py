"""Protein-like views derived from the ``embeddings`` table.

Three of a vector's 64 numbers make a step of the chain; the last one makes the temperature factor of its atoms. Every view is one SELECT that reads the same in Spark SQL and in ANSI SQL engines; only the first step (unnesting the
vectors) differs. ``spark_view`` runs it in Spark and caches it for the session; ``with_views`` renders the SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

THREE = ("case aa when 'A' then 'ALA' when 'C' then 'CYS' when 'D' then 'ASP' when 'E' then 'GLU' when 'F' then 'PHE' "
         "when 'G' then 'GLY' when 'H' then 'HIS' when 'I' then 'ILE' when 'K' then 'LYS' when 'L' then 'LEU' when 'M' then 'MET' "
         "when 'N' then 'ASN' when 'P' then 'PRO' when 'Q' then 'GLN' when 'R' then 'ARG' when 'S' then 'SER' when 'T' then 'THR' "
         "when 'V' then 'VAL' when 'W' then 'TRP' when 'Y' then 'TYR' end")

UNNEST_SQL = """select vec_id, label, k, cast(embedding[3*k+1] as double) as a, cast(embedding[3*k+2] as double) as b,
  cast(embedding[3*k+3] as double) as c, cast(embedding[64] as double) as u from embeddings, (select unnest(range(0, 21)) as k)"""
UNNEST_SPARK = """select vec_id, label, k, cast(embedding[cast(3*k as int)] as double) as a,
  cast(embedding[cast(3*k+1 as int)] as double) as b, cast(embedding[cast(3*k+2 as int)] as double) as c,
  cast(embedding[63] as double) as u from {embeddings} lateral view explode(sequence(0L, 20L)) t as k"""

ATOM_COLS = "structure_id, model, chain, ck, idx, aa, ord, record, serial, atom_name, alt_loc, res_name, res_num, icode, x, y, z, occ, bfac, element"

VIEWS: dict[str, str] = {
    "fx_ca": """select chain_id, idx, aa, u, round(sum(dx) over w, 3) as x, round(sum(dy) over w, 3) as y, round(sum(dz) over w, 3) as z
  from (select chain_id, idx, aa, u, 3.8e0*a/sqrt(a*a+b*b+c*c) as dx, 3.8e0*b/sqrt(a*a+b*b+c*c) as dy, 3.8e0*c/sqrt(a*a+b*b+c*c) as dz
    from (select cast(floor(vec_id/8e0) as bigint) as chain_id, (vec_id % 8) * 21 + k as idx,
            substr('ACDEFGHIKLMNPQRSTVWY', cast((vec_id*31 + k*17 + label*7) % 20 as int) + 1, 1) as aa, a, b, c, u from fx_raw) s) v
  window w as (partition by chain_id order by idx)""",
    "fx_res": """select 's' || cast(cast(floor(chain_id/2e0) as bigint) as string) as structure_id,
    case when chain_id % 2 = 0 then 'A' else 'B' end as chain,
    's' || cast(cast(floor(chain_id/2e0) as bigint) as string) || '_1_' || case when chain_id % 2 = 0 then 'A' else 'B' end as ck,
    chain_id, u, cast(idx as int) as idx, cast(11 + idx + floor(idx/60e0) as int) as res_num, aa, x, y, z,
    round(x-0.3851234567e0*px,3) as nx, round(y-0.3851234567e0*py,3) as ny, round(z-0.3851234567e0*pz,3) as nz,
    round(x+0.4001234567e0*ux,3) as cx, round(y+0.4001234567e0*uy,3) as cy, round(z+0.4001234567e0*uz,3) as cz,
    round(x+0.4001234567e0*ux + 1.2301234567e0*uy/greatest(sqrt(ux*ux+uy*uy),1e-6),3) as ox,
    round(y+0.4001234567e0*uy - 1.2301234567e0*ux/greatest(sqrt(ux*ux+uy*uy),1e-6),3) as oy,
    round(z+0.4001234567e0*uz,3) as oz,
    substr('HHECTTEG B', cast((chain_id*3 + floor(idx/11e0)*7) % 10 as int) + 1, 1) as ss
  from (select *, coalesce((lead(x) over (w)) - x, x - (lag(x) over (w))) as ux, coalesce((lead(y) over (w)) - y, y - (lag(y) over (w))) as uy,
        coalesce((lead(z) over (w)) - z, z - (lag(z) over (w))) as uz, coalesce(x - (lag(x) over (w)), (lead(x) over (w)) - x) as px,
        coalesce(y - (lag(y) over (w)), (lead(y) over (w)) - y) as py, coalesce(z - (lag(z) over (w)), (lead(z) over (w)) - z) as pz
      from fx_ca window w as (partition by chain_id order by idx)) n""",
    "fx_cb": """select *, round(x - 0.5827341234e0*ax + 0.5680281234e0*bx - 0.5406741234e0*gx, 3) as sx,
    round(y - 0.5827341234e0*ay + 0.5680281234e0*by_ - 0.5406741234e0*gy, 3) as sy,
    round(z - 0.5827341234e0*az + 0.5680281234e0*bz - 0.5406741234e0*gz, 3) as sz
  from (select *, by_*gz - bz*gy as ax, bz*gx - bx*gz as ay, bx*gy - by_*gx as az
    from (select *, x-nx as bx, y-ny as by_, z-nz as bz, cx-x as gx, cy-y as gy, cz-z as gz from fx_res) p) q""",
    "fx_atoms": f"""select structure_id, 1 as model, chain, ck, idx, aa, ord, 'ATOM' as record,
    cast(row_number() over (partition by structure_id order by chain, idx, ord) as int) as serial, atom_name, ' ' as alt_loc,
    {THREE} as res_name, res_num, ' ' as icode, x, y, z, 1e0 as occ, round(10e0 + ord + 7.1234567e0*abs(u), 2) as bfac, substr(atom_name, 1, 1) as element
  from (select structure_id, chain, ck, idx, aa, u, res_num, 1 as ord, 'N' as atom_name, nx as x, ny as y, nz as z from fx_res
    union all select structure_id, chain, ck, idx, aa, u, res_num, 2, 'CA', x, y, z from fx_res
    union all select structure_id, chain, ck, idx, aa, u, res_num, 3, 'C', cx, cy, cz from fx_res
    union all select structure_id, chain, ck, idx, aa, u, res_num, 4, 'O', ox, oy, oz from fx_res
    union all select structure_id, chain, ck, idx, aa, u, res_num, 5, 'CB', sx, sy, sz from fx_cb where aa <> 'G'
    union all select structure_id, chain, ck, idx, aa, u, res_num, 6, 'SG', round(sx + 1.1712345678e0*(sx-x), 3), round(sy + 1.1712345678e0*(sy-y), 3),
      round(sz + 1.1712345678e0*(sz-z), 3) from fx_cb where aa = 'C') a""",
    "fx_flaws": """select structure_id, chain, idx, aa, ord, case when aa = 'M' and idx % 3 = 0 then 'HETATM' else 'ATOM' end as record, atom_name,
      case when idx % 97 = 5 then 'A' else ' ' end as alt_loc, case when aa = 'M' and idx % 3 = 0 then 'MSE' else res_name end as res_name,
      res_num, ' ' as icode, x, y, z, occ, bfac, element, 0 as kind from fx_atoms
    union all select structure_id, chain, idx, aa, ord, case when aa = 'M' and idx % 3 = 0 then 'HETATM' else 'ATOM' end, atom_name, 'B',
      case when aa = 'M' and idx % 3 = 0 then 'MSE' else res_name end,
      res_num, ' ', round(x + 0.3e0, 3), y, z, occ, bfac, element, 0 from fx_atoms where idx % 97 = 5
    union all select structure_id, chain, idx, aa, ord, 'ATOM', atom_name, ' ', res_name, res_num, 'A', round(x + 0.2e0, 3), y, z, occ, bfac, element, 0
      from fx_atoms where idx % 101 = 7
    union all select structure_id, chain, idx, aa, 7, 'HETATM', 'O', ' ', 'HOH', res_num + 1000, ' ', round(x + 3.1e0, 3), y, z, occ, bfac, 'O', 1
      from fx_atoms where idx % 20 = 10 and ord = 2""",
    "fx_dirty": """select structure_id, model, chain, structure_id || '_' || cast(model as string) || '_' || chain as ck,
    idx, aa, ord, record, cast(row_number() over (partition by structure_id, model order by chain, idx, icode, kind, ord, alt_loc) as int) as serial,
    atom_name, alt_loc, res_name, res_num, icode, round(x + 100e0*(model-1), 3) as x, y, z, occ, bfac, element
  from (select *, 1 as model from fx_flaws union all select *, 2 as model from fx_flaws) d""",
    "fx_pu": """select ck, pu, min(idx) as s, max(idx) as e from (select ck, idx, cast(floor(idx/28e0) as int) as pu from fx_res) p group by ck, pu""",
}
DEPS = {"fx_ca": ("fx_raw",), "fx_res": ("fx_ca",), "fx_cb": ("fx_res",), "fx_atoms": ("fx_res", "fx_cb"), "fx_flaws": ("fx_atoms",), "fx_dirty": ("fx_flaws",),
        "fx_pu": ("fx_res",), "fx_raw": ()}


# Spark builds the atom views from one row per residue: its atoms as an array, numbered by a running count of the residues before it, where the SQL
# texts above unite one SELECT per kind of atom and flaw and sort all atoms.
SIDE = "round({0} + 1.1712345678e0*({0}-{1}), 3)"
BACK = ("named_struct('ord', 1, 'atom_name', 'N', 'x', nx, 'y', ny, 'z', nz), named_struct('ord', 2, 'atom_name', 'CA', 'x', x, 'y', y, 'z', z), "
        "named_struct('ord', 3, 'atom_name', 'C', 'x', cx, 'y', cy, 'z', cz), named_struct('ord', 4, 'atom_name', 'O', 'x', ox, 'y', oy, 'z', oz)")
CB = "named_struct('ord', 5, 'atom_name', 'CB', 'x', sx, 'y', sy, 'z', sz)"
SG = f"named_struct('ord', 6, 'atom_name', 'SG', 'x', {SIDE.format('sx', 'x')}, 'y', {SIDE.format('sy', 'y')}, 'z', {SIDE.format('sz', 'z')})"
N_ATOMS = "(4 + cast(aa <> 'G' as int) + cast(aa = 'C' as int))"
N_FLAWED = f"({N_ATOMS} * (1 + cast(idx % 97 = 5 as int) + cast(idx % 101 = 7 as int)) + cast(idx % 20 = 10 as int))"
LISTED = """(select structure_id, chain, ck, idx, aa, u, res_num, before, case when aa = 'G' then array({back}) when aa = 'C' then array({back}, {cb}, {sg})
    else array({back}, {cb}) end as atoms from (select *, coalesce(sum({n}) over (partition by structure_id order by chain, idx rows between unbounded preceding
    and 1 preceding), 0) as before from fx_cb) c)"""
MSE = "(flaw < 2 and aa = 'M' and idx % 3 = 0)"
SPARK_VIEWS: dict[str, str] = {
    "fx_atoms": f"""select structure_id, 1 as model, chain, ck, idx, aa, a.ord, 'ATOM' as record, cast(before + pos + 1 as int) as serial, a.atom_name, ' ' as alt_loc,
    {THREE} as res_name, res_num, ' ' as icode, a.x, a.y, a.z, 1e0 as occ, round(10e0 + a.ord + 7.1234567e0*abs(u), 2) as bfac, substr(a.atom_name, 1, 1) as element
  from {LISTED.format(back=BACK, cb=CB, sg=SG, n=N_ATOMS)} l lateral view posexplode(atoms) t as pos, a""",
    # flaws: 0 none, 1 a second location, 2 a water beside CA, 3 an inserted residue
    "fx_dirty": f"""select structure_id, model, chain, structure_id || '_' || cast(model as string) || '_' || chain as ck, idx, aa, ord, record, serial, atom_name, alt_loc,
    res_name, res_num, icode, round(x + 100e0*(model-1), 3) as x, y, z, occ, bfac, element
  from (select structure_id, chain, idx, aa, case when flaw = 2 then 7 else a.ord end as ord, case when flaw = 2 or {MSE} then 'HETATM' else 'ATOM' end as record,
      cast(before + pos + 1 as int) as serial, case when flaw = 2 then 'O' else a.atom_name end as atom_name,
      case when flaw = 1 then 'B' when flaw = 0 and idx % 97 = 5 then 'A' else ' ' end as alt_loc,
      case when flaw = 2 then 'HOH' when {MSE} then 'MSE' else {THREE} end as res_name, case when flaw = 2 then res_num + 1000 else res_num end as res_num,
      case when flaw = 3 then 'A' else ' ' end as icode,
      case flaw when 0 then a.x when 1 then round(a.x + 0.3e0, 3) when 2 then round(a.x + 3.1e0, 3) else round(a.x + 0.2e0, 3) end as x, a.y, a.z, 1e0 as occ,
      round(10e0 + a.ord + 7.1234567e0*abs(u), 2) as bfac, case when flaw = 2 then 'O' else substr(a.atom_name, 1, 1) end as element
    from (select *, row.a, row.flaw from (select *, concat(
        flatten(transform(atoms, a -> case when idx % 97 = 5 then array(struct(a as a, 0 as flaw), struct(a as a, 1 as flaw)) else array(struct(a as a, 0 as flaw)) end)),
        case when idx % 20 = 10 then array(struct(atoms[1] as a, 2 as flaw)) else array() end,
        case when idx % 101 = 7 then transform(atoms, a -> struct(a as a, 3 as flaw)) else array() end) as lines
      from {LISTED.format(back=BACK, cb=CB, sg=SG, n=N_FLAWED)} l) m lateral view posexplode(lines) t as pos, row) e) d lateral view explode(array(1, 2)) t as model""",
}
SPARK_DEPS = {"fx_atoms": ("fx_cb",), "fx_dirty": ("fx_cb",)}


def register_view(name: str, deps: tuple[str, ...], sql: str) -> None:
    """Add one more shared view (used by catalog modules for common steps of their SQL checks)."""
    VIEWS[name], DEPS[name] = sql, deps


def closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in DEPS[n]:
                visit(d)
            order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(select: str, *names: str) -> str:
    """SQL text of ``select`` with the views it names in front."""
    parts = [f"{n} as materialized ({UNNEST_SQL if n == 'fx_raw' else VIEWS[n]})" for n in closure(names)]
    head = "with " + ",\n".join(parts)
    body = select.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head[5:]},\n{body[15:]}"
    return f"{head},\n{body[5:]}" if body.lower().startswith("with ") else f"{head}\n{body}"


def keeping_sign(text: str) -> str:
    """``round(e, n)`` of a view's text so that Spark keeps the sign of what rounds to zero, as SQL engines do: files show it as -0.000."""
    out, at = "", 0
    while (found := text.find("round(", at)) >= 0:
        depth, end, comma = 1, found + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            comma = end if text[end] == "," and depth == 1 else comma
            end += 1
        e = keeping_sign(text[found + 6:comma])
        out += f"{text[at:found]}(sign({e}) * round(abs({e}){text[comma:end]})"
        at = end
    return out + text[at:]


_cache: dict[tuple[str, str, str], DataFrame] = {}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; the final views are cached per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        if name == "fx_raw":
            df = spark.sql(UNNEST_SPARK, embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        else:
            text = keeping_sign(SPARK_VIEWS.get(name, VIEWS[name]))
            frames = {d: spark_view(spark, sf_dir, d) for d in SPARK_DEPS.get(name, DEPS[name])}
            for d in frames:
                text = text.replace(f"from {d}", "from {" + d + "}")
            df = spark.sql(text, **frames)
        _cache[key] = df.cache() if name in ("fx_res", "fx_atoms", "fx_dirty") else df
    return _cache[key]
