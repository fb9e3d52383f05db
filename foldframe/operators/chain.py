"""Window operators along the chain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.functions import codes
from foldframe.functions import geometry as G

def along() -> WindowSpec:
    """Residues of a chain in index order."""
    return W.partitionBy("ck").orderBy("idx")


def chain_string(residues: DataFrame, char: Column, name: str) -> DataFrame:
    """One string per chain from one character per residue, in index order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), char.alias("c"))))
    return residues.groupBy("ck").agg(F.array_join(F.transform(ordered, lambda s: s["c"]), "").alias(name))


def chain_sequence(residues: DataFrame) -> DataFrame:
    """One-letter sequence of each chain."""
    return chain_string(residues, F.coalesce("aa", F.lit("X")), "seq")


def ss_reduce(residues: DataFrame) -> DataFrame:
    """Display letter and cut number of the secondary-structure state."""
    return residues.withColumn("ss3", codes.ss_display(F.col("ss"))).withColumn("ss_code", codes.ss_cut(F.col("ss")))


def ss_runs(residues: DataFrame, state: str = "ss") -> DataFrame:
    """Maximal runs of equal state: ck, state, start, end."""
    starts = residues.withColumn("_n", F.coalesce((F.lag(state).over(along()) != F.col(state)).cast("int"), F.lit(0)))
    runs = starts.withColumn("_r", F.sum("_n").over(along().rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("ck", "_r", state).agg(F.min("idx").alias("start"), F.max("idx").alias("end")).drop("_r")


def cut_mask(residues: DataFrame, limit: int = K.SS_LIMIT, stale_start: bool = False) -> DataFrame:
    """Whether the chain may be cut before each position.

    A helix or strand run from ``start`` to ``end`` with 0 < end - start <= limit is closed on [start, end). A run still
    open at the chain end does not count. With ``stale_start`` a direct change from helix to strand (or back) keeps the
    earlier start.
    """
    coded = residues.select("ck", "idx", codes.ss_cut(F.col("ss")).alias("code"))
    runs = ss_runs(coded, "code")
    v = W.partitionBy("ck").orderBy("start")
    if stale_start:
        fresh = F.coalesce(((F.col("code") > 0) & (F.lag("code").over(v) == 0)).cast("int"), F.lit(1))
        runs = runs.withColumn("_g", F.sum(F.when(F.col("code") > 0, fresh).otherwise(1)).over(v.rowsBetween(W.unboundedPreceding, 0)))
        runs = runs.withColumn("start", F.min("start").over(W.partitionBy("ck", "_g")))
    last = F.max("end").over(W.partitionBy("ck"))
    closed = (runs.withColumn("_last", last).where((F.col("code") > 0) & (F.col("end") < F.col("_last"))
                                                   & (F.col("end") - F.col("start")).between(1, limit))
              .select("ck", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx")).distinct().withColumn("_x", F.lit(True)))
    return (residues.select("ck", "idx").join(closed, ["ck", "idx"], "left")
            .select("ck", "idx", F.col("_x").isNull().alias("cuttable")))


def ca_steps(residues: DataFrame, min_d: float = 3.7, max_d: float = 3.9, cis_d: float = 3.6) -> DataFrame:
    """Distance from the CA before and its verdict: 0 regular, 1 cis, 2 outside the limits."""
    d = G.distance(F.lag("ca").over(along()), F.col("ca"))
    omega = G.dihedral(F.lag("ca").over(along()), F.lag("c").over(along()), F.col("n"), F.col("ca"))
    steps = residues.select("ck", "idx", "auth_num", "aa", d.alias("d"), omega.alias("omega"))
    cis = (F.col("d") < cis_d) | ((F.col("d") < min_d) & (F.abs("omega") < 20))
    bad = (F.col("d") > max_d) | ((F.col("d") < min_d) & ~cis)
    return steps.withColumn("flag", F.when(cis, 1).when(bad, 2).otherwise(0))


def ca_trace_check(residues: DataFrame, min_d: float = 3.7, max_d: float = 3.9, cis_d: float = 3.6) -> DataFrame:
    """Per chain: verdict, numbers of cis prolines and cis peptides, and the flags as a string."""
    steps = ca_steps(residues, min_d, max_d, cis_d)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "flag")))
    return steps.groupBy("ck").agg(
        F.when(F.count_if(F.col("flag") == 2) > 0, "Bad").otherwise("Ok").alias("trace"),
        F.count_if((F.col("flag") == 1) & (F.col("aa") == "P")).alias("n_cis_pro"),
        F.count_if((F.col("flag") == 1) & (F.col("aa") != "P")).alias("n_cis_pep"),
        F.array_join(F.transform(ordered, lambda s: s["flag"].cast("string")), "").alias("flags"))


def peptide_bond_check(residues: DataFrame, poor: float = 1.5, bad: float = 3.0) -> DataFrame:
    """Worst C-N bond of a chain: Ok, Poor or Bad."""
    d = G.distance(F.lag("c").over(along()), F.col("n"))
    level = F.when(d > bad, 2).when(d > poor, 1).otherwise(0)
    return (residues.select("ck", level.alias("level")).groupBy("ck").agg(F.max("level").alias("level"))
            .select("ck", F.when(F.col("level") == 2, "Bad").when(F.col("level") == 1, "Poor").otherwise("Ok").alias("geometry")))


def with_fragments(residues: DataFrame, max_cn: float = 1.7, max_ca: float = 4.1, ca_only: bool = False) -> DataFrame:
    """Add ``frag``: 0-based number of the unbroken stretch a residue belongs to."""
    step = G.distance(F.lag("ca").over(along()), F.col("ca")) > max_ca if ca_only else G.distance(F.lag("c").over(along()), F.col("n")) > max_cn
    present = F.lag("idx").over(along()).isNotNull()
    broken = F.when(present, F.coalesce(step, F.lit(True))).otherwise(F.lit(False))
    marked = residues.withColumn("_b", broken.cast("int"))
    return marked.withColumn("frag", F.sum("_b").over(along().rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_b")


def chain_fragments(residues: DataFrame, max_cn: float = 1.7, max_ca: float = 4.1, ca_only: bool = False) -> DataFrame:
    """Unbroken stretches with bounds and sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "aa")))
    return with_fragments(residues, max_cn, max_ca, ca_only).groupBy("ck", "frag").agg(
        F.min("idx").alias("start"), F.max("idx").alias("end"), F.array_join(F.transform(ordered, lambda s: s["aa"]), "").alias("seq"))


def backbone_torsions(residues: DataFrame, undefined: float = 360.0, max_cn: float = 2.0) -> DataFrame:
    """phi, psi and omega in degrees; ``undefined`` where the neighbour is missing or not bonded."""
    prev, nxt = lambda c: F.lag(c).over(along()), lambda c: F.lead(c).over(along())
    bonded_prev = G.distance(prev("c"), F.col("n")) <= max_cn
    bonded_next = G.distance(F.col("c"), nxt("n")) <= max_cn
    val = lambda ok, t: F.when(ok, t).otherwise(F.lit(undefined))
    return residues.select(
        "ck", "idx", "aa", val(bonded_prev, G.dihedral(prev("c"), F.col("n"), F.col("ca"), F.col("c"))).alias("phi"),
        val(bonded_next, G.dihedral(F.col("n"), F.col("ca"), F.col("c"), nxt("n"))).alias("psi"),
        val(bonded_next, G.dihedral(F.col("ca"), F.col("c"), nxt("n"), nxt("ca"))).alias("omega"))


def ca_virtual_angles(residues: DataFrame) -> DataFrame:
    """alpha with chirality, kappa with bend flag, and tco; 360 or 0 where a chain break lies inside the span.

    ``residues`` carries ``frag``. alpha: torsion of CA i-1..i+2; kappa: angle between CA i-2 to i and i to i+2;
    tco: cosine between this and the previous C=O.
    """
    at = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(along())
    same = lambda a, b: F.coalesce(at("frag", a) == at("frag", b) if a and b else at("frag", a or b) == F.col("frag"), F.lit(False))
    alpha = F.when(same(-1, 2), G.dihedral(at("ca", -1), F.col("ca"), at("ca", 1), at("ca", 2))).otherwise(F.lit(360.0))
    ck = G.cos_angle(G.sub(F.col("ca"), at("ca", -2)), G.sub(at("ca", 2), F.col("ca")))
    kappa = F.when(same(-2, 2), F.degrees(F.acos(ck))).otherwise(F.lit(360.0))
    tco = F.when(same(-1, 0), G.cos_angle(G.sub(F.col("o"), F.col("c")), G.sub(at("o", -1), at("c", -1)))).otherwise(F.lit(0.0))
    out = residues.select("ck", "idx", alpha.alias("alpha"), kappa.alias("kappa"), tco.alias("tco"))
    return (out.withColumn("chirality", F.when(F.col("alpha") == 360, " ").when(F.col("alpha") < 0, "-").otherwise("+"))
            .withColumn("bend", F.when((F.col("kappa") != 360) & (F.col("kappa") > 70), "S").otherwise(" ")))


def side_chain_torsions(atoms: DataFrame) -> DataFrame:
    """chi1..chi5 per residue; the list stops at the first torsion with a missing atom."""
    defs = {a: [t.split() for t in ts] for a, ts in K.CHI_ATOMS.items()}
    points = (atoms.withColumn("aa", codes.one_letter(F.col("res_name"))).groupBy("ck", "idx", "aa")
              .agg(F.map_from_entries(F.collect_list(F.struct("atom_name", G.point("x", "y", "z")))).alias("p")))
    names = codes_map(defs)
    with_defs = points.select("ck", "idx", "aa", "p", F.posexplode(names[F.col("aa")]).alias("k", "t"))
    pt = lambda j: F.col("p")[F.col("t")[j]]
    chi = with_defs.select("ck", "idx", "aa", (F.col("k") + 1).alias("chi"), G.dihedral(pt(0), pt(1), pt(2), pt(3)).alias("angle"))
    w = W.partitionBy("ck", "idx").orderBy("chi").rowsBetween(W.unboundedPreceding, 0)
    return chi.withColumn("_ok", F.bool_and(F.col("angle").isNotNull()).over(w)).where("_ok").drop("_ok")


def codes_map(defs: dict[str, list[list[str]]]) -> Column:
    """Map literal residue -> torsion definitions."""
    parts: list[Column] = []
    for aa, torsions in defs.items():
        parts += [F.lit(aa), F.array(*[F.array(*[F.lit(n) for n in t]) for t in torsions])]
    return F.create_map(*parts)


def ca_tetrad_descriptor(residues: DataFrame) -> DataFrame:
    """Seven numbers for four consecutive CA: d13, d14, d24, signed height, d12, d23, d34."""
    p = [F.col("ca")] + [F.lead("ca", k).over(along()) for k in (1, 2, 3)]
    rows = residues.select("ck", "idx", *[c.alias(f"p{k}") for k, c in enumerate(p)]).where("p3 is not null")
    c = [F.col(f"p{k}") for k in range(4)]
    return rows.select("ck", "idx", G.distance(c[0], c[2]).alias("d13"), G.distance(c[0], c[3]).alias("d14"), G.distance(c[1], c[3]).alias("d24"),
                       G.mixed(G.sub(c[1], c[0]), G.sub(c[2], c[1]), G.sub(c[3], c[2])).alias("height"),
                       G.distance(c[0], c[1]).alias("d12"), G.distance(c[1], c[2]).alias("d23"), G.distance(c[2], c[3]).alias("d34"))


def window_energy(energies: DataFrame, size: int) -> DataFrame:
    """Mean residue energy in a centred window; only full windows are kept. Input: ck, idx, e."""
    before, after = math.ceil(size / 2) - 1, size // 2
    w = along().rowsBetween(-before, after)
    return (energies.select("ck", "idx", F.avg("e").over(w).alias("mean_e"), F.count("e").over(w).alias("_n"))
            .where(F.col("_n") == size).drop("_n"))


def palette_index(domains: DataFrame, colours: int = 60) -> DataFrame:
    """Stable colour number of each distinct domain of a chain by its first (alt_id, dom). Input: ck, alt_id, dom, domain."""
    first = domains.groupBy("ck", "domain").agg(F.min(F.struct("alt_id", "dom")).alias("_f"))
    w = W.partitionBy("ck").orderBy("_f", "domain")
    return first.select("ck", "domain", ((F.row_number().over(w) - 1) % colours).alias("colour"))
