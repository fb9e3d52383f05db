"""Structure checks and whole-chain statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.functions import codes
from foldframe.functions import geometry as G
from foldframe.functions.spatial import near_pairs, near_self_pairs
from foldframe.session import spread

RES = ["ck", "res_num", "icode"]


def entry_keys(atoms: DataFrame) -> list[str]:
    """What keeps coordinates of one frame together: the structure and, where there is one, the model."""
    return [c for c in ("structure_id", "model") if c in atoms.columns]


def disulfides(atoms: DataFrame, max_d: float = 2.35, min_gap: int = 1, declared: DataFrame | None = None) -> DataFrame:
    """Cysteine SG pairs of one model closer than ``max_d``, each once: ids, d, whether inside one chain, and whether declared.

    ``min_gap`` 2 leaves out neighbouring residues of a chain. ``declared``: structure_id, resl, resr.
    """
    sg = atoms.where("res_name = 'CYS' and atom_name = 'SG'").select(*entry_keys(atoms), "chain", "res_num", "x", "y", "z")
    apart = (F.col("l.chain") != F.col("r.chain")) | (F.col("r.res_num") - F.col("l.res_num") >= min_gap)
    rid = lambda s: F.concat(F.col(f"{s}.res_num").cast("string"), F.col(f"{s}.chain"))
    met = near_self_pairs(sg, entry_keys(atoms), ["chain", "res_num"], max_d, apart)
    out = met.select(*entry_keys(atoms), rid("l").alias("resl"), rid("r").alias("resr"), "d", (F.col("l.chain") == F.col("r.chain")).alias("intra"))
    if declared is None:
        return out.withColumn("declared", F.lit(False))
    told = declared.select("structure_id", "resl", "resr", F.lit(True).alias("declared")).distinct()
    return out.join(told, ["structure_id", "resl", "resr"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def neighbours_around(atoms: DataFrame, centres: DataFrame, dist: float, ca_limit: float = 15.0) -> DataFrame:
    """Residues with an atom within ``dist`` of an atom of a centre residue whose CA lies within ``ca_limit``.

    ``centres``: ck, res_num. Result: structure_id, centre_ck, centre, ck, res_num.
    """
    ca = atoms.where("atom_name = 'CA'").select("ck", "res_num", F.struct("x", "y", "z").alias("ca"))
    with_ca = atoms.select(*entry_keys(atoms), "ck", "res_num", "x", "y", "z").join(ca, ["ck", "res_num"])
    mid = with_ca.join(centres.select("ck", "res_num").distinct(), ["ck", "res_num"], "left_semi")
    other = (F.col("l.ck") != F.col("r.ck")) | (F.col("l.res_num") != F.col("r.res_num"))
    return (near_pairs(mid, with_ca, entry_keys(atoms), dist, other & (G.distance(F.col("l.ca"), F.col("r.ca")) <= ca_limit))
            .select("structure_id", F.col("l.ck").alias("centre_ck"), F.col("l.res_num").alias("centre"), F.col("r.ck").alias("ck"),
                    F.col("r.res_num").alias("res_num")).distinct())


def sphere_points(order: int = 2) -> list[tuple[float, float, float, float]]:
    """Face centres of an icosahedron split ``order`` times, with their shares of the sphere's 4 pi (320 for order 2)."""
    g = (1 + 5 ** 0.5) / 2
    v = [np.array(p, float) / (1 + g * g) ** 0.5 for a, b in ((1, g), (-1, g), (1, -g), (-1, -g)) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    edge = min(np.linalg.norm(v[0] - p) for p in v[1:])
    near = lambda p, q: abs(np.linalg.norm(p - q) - edge) < 1e-6
    faces = [(v[i], v[j], v[k]) for i in range(12) for j in range(i) for k in range(j) if near(v[i], v[j]) and near(v[j], v[k]) and near(v[i], v[k])]
    unit = lambda p: p / np.linalg.norm(p)
    for _ in range(order):
        faces = [f for a, b, c in faces for ab, bc, ca in [(unit(a + b), unit(b + c), unit(c + a))]
                 for f in ((a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca))]
    area = np.array([np.linalg.norm(np.cross(b - a, c - a)) / 2 for a, b, c in faces])
    area *= 4 * np.pi / area.sum()
    return [(*map(float, unit(a + b + c)), float(w)) for (a, b, c), w in zip(faces, area, strict=True)]


#: Side of the blocks of ``solvent_accessibility`` in reaches: an atom goes to its own block and those within a reach, two on average.
BLOCK_REACHES = 8
#: Atoms whose points are held against their neighbours together, and neighbours met at a time.
ATOMS_AT_ONCE, PAIRS_MET = 512, 1 << 20


def near_lists(own: np.ndarray, xyz: np.ndarray, rad: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``own`` of a block and, for each, the rows that may touch it, a bounded number of pairs at a time: two arrays of equal length."""
    cell = np.floor((xyz - xyz.min(axis=0)) / reach).astype(np.int64) + 1
    ny, nz = cell[:, 1].max() + 2, cell[:, 2].max() + 2
    code = (cell[:, 0] * ny + cell[:, 1]) * nz + cell[:, 2]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    # the three cells along z are one run of codes, so nine runs hold the neighbours
    steps = np.array([(dx * ny + dy) * nz for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    first = np.searchsorted(ranked, code[own][:, None] + steps - 1)
    count = np.searchsorted(ranked, code[own][:, None] + steps + 1, side="right") - first
    ends = np.cumsum(count.sum(axis=1))
    at = 0
    while at < len(own):
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(at + ATOMS_AT_ONCE, int(np.searchsorted(ends, base + PAIRS_MET, side="right"))))
        n = count[at:to].ravel()
        run = np.repeat(first[at:to].ravel() - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        left, right = np.repeat(own[at:to], count[at:to].sum(axis=1)), order[run]
        d2 = ((xyz[right] - xyz[left]) ** 2).sum(axis=1)
        touch = (d2 > 1e-6) & (d2 < (rad[left] + rad[right]) ** 2)
        yield left[touch], right[touch]
        at = to


def free_shares(own: np.ndarray, xyz: np.ndarray, rad: np.ndarray, reach: float, points: np.ndarray) -> np.ndarray:
    """Share of 4 pi of each row of ``own`` that no neighbour covers, from the points (x, y, z, share) of the unit sphere."""
    share = np.full(len(xyz), points[:, 3].sum())
    for left, right in near_lists(own, xyz, rad, reach):
        if not len(left):
            continue
        gap = xyz[right] - xyz[left]
        limit = (rad[left] ** 2 - rad[right] ** 2 + (gap ** 2).sum(axis=1)) / (2 * rad[left])
        starts = np.flatnonzero(np.diff(left, prepend=-1))
        step = max(1, PAIRS_MET // len(points))
        hidden = np.zeros((len(starts), len(points)), bool)
        atom = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(left))))
        for lo in range(0, len(left), step):
            covers = gap[lo:lo + step] @ points[:, :3].T > limit[lo:lo + step, None]
            here = atom[lo:lo + step]
            cut = np.flatnonzero(np.diff(here, prepend=-1))
            hidden[here[cut]] |= np.logical_or.reduceat(covers, cut, axis=0)
        share[left[starts]] = (~hidden) @ points[:, 3]
    return share[own]


def solvent_accessibility(atoms: DataFrame) -> DataFrame:
    """Accessible area per residue, rounded: points on each atom's enlarged sphere that no neighbour covers.

    Neighbours are all atoms of the same structure and model, whatever their chain. Space is cut into blocks; an atom goes to its own block and
    to those within a reach of it, so a block finds its atoms' neighbours and areas alone and only areas are shuffled after it. Points and
    neighbours are met a bounded number at a time.
    """
    keys = entry_keys(atoms) or ["ck"]
    radius = codes.lookup({k: v + K.RADIUS_WATER for k, v in K.RADII.items()}, F.col("atom_name"), K.RADIUS_SIDE + K.RADIUS_WATER)
    a = atoms.where(F.col("element") != "H").select(*dict.fromkeys([*keys, "ck"]), "res_num", "x", "y", "z", radius.alias("rad"))
    reach = 2 * (max(*K.RADII.values(), K.RADIUS_SIDE) + K.RADIUS_WATER)
    side = BLOCK_REACHES * reach
    block = lambda c, d: F.floor((F.col(c) + d) / side).cast("int")
    for c in "xyz":
        a = a.withColumn(f"_g{c}", F.explode(F.sequence(block(c, -reach), block(c, reach))))
    own = F.lit(True)
    for c in "xyz":
        own = own & (F.col(f"_g{c}") == block(c, 0))
    cells = [*keys, "_gx", "_gy", "_gz"]
    sent = a.select(*cells, *[F.when(own, F.col(c)).alias(f"_{c}") for c in ("ck", "res_num")], "x", "y", "z", "rad")
    points = np.array(sphere_points())

    def run(block: pa.Table) -> pa.Table:
        mine = np.flatnonzero(block["_res_num"].is_valid().to_numpy())
        rad = block["rad"].to_numpy()
        xyz = np.stack([block[c].to_numpy() for c in "xyz"], axis=1)
        area = free_shares(mine, xyz, rad, reach, points) * rad[mine] ** 2 if len(mine) else np.zeros(0)
        return pa.table({"ck": block["_ck"].take(mine), "res_num": block["_res_num"].take(mine), "area": area})

    kind = a.schema["res_num"].dataType.simpleString()
    areas = spread(sent, *cells).groupBy(*cells).applyInArrow(run, f"ck string, res_num {kind}, area double")
    return areas.groupBy("ck", "res_num").agg(F.floor(F.sum("area") + 0.5).cast("int").alias("area"))


def exposed_residues(areas: DataFrame, residues: DataFrame, limit: float = 0.25, exposed: bool = True) -> DataFrame:
    """Residues whose area is at least (or below) ``limit`` of the largest area of their type."""
    rel = F.col("area") / codes.lookup(K.MAX_AREA, F.col("aa"))
    rows = residues.join(areas, ["ck", "res_num"]).withColumn("relative", rel)
    return rows.where(F.col("relative") >= limit if exposed else F.col("relative") < limit)


def missing_atoms(atoms: DataFrame, part: str = "backbone") -> DataFrame:
    """Residues that lack expected backbone or side-chain atoms, with the missing names; OXT stands in for O."""
    have = atoms.groupBy(*RES, "res_name").agg(F.collect_set("atom_name").alias("_h"))
    names = lambda items: F.array(*[F.lit(a) for a in items]) if items else F.array().cast("array<string>")
    if part == "backbone":
        want = names(K.BACKBONE)
        have = have.withColumn("_h", F.when(F.array_contains("_h", "OXT"), F.concat("_h", names(["O"]))).otherwise(F.col("_h")))
    else:
        parts: list[Column] = []
        for aa, side in K.SIDE_CHAIN.items():
            parts += [F.lit(K.ONE_TO_THREE[aa]), names(side.split())]
        want = F.create_map(*parts)[F.col("res_name")]
    return have.withColumn("missing", F.array_sort(F.array_except(want, "_h"))).where(F.size("missing") > 0).drop("_h")


def altloc_residues(atoms: DataFrame) -> DataFrame:
    """Residues with alternate locations of backbone or side-chain atoms; hydrogens are ignored."""
    alt = atoms.where((F.col("alt_loc") != " ") & (F.col("element") != "H"))
    bb = F.col("atom_name").isin("N", "CA", "C", "O", "OXT")
    return alt.groupBy(*RES).agg(F.bool_or(bb).alias("backbone"), F.bool_or(~bb).alias("side_chain"))


def mean_ca_displacement(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance and root mean square of paired CA (same ``keys`` and idx) without superposition."""
    a = first.select(*keys, "idx", F.struct("x", "y", "z").alias("p"))
    b = second.select(*keys, "idx", F.struct("x", "y", "z").alias("q"))
    d = G.distance(F.col("p"), F.col("q"))
    return a.join(b, [*keys, "idx"]).groupBy(*keys).agg(F.avg(d).alias("mean_d"), F.sqrt(F.avg(d * d)).alias("rmsd"), F.count(F.lit(1)).alias("n"))


def dedup_sites(sites: DataFrame, strict: bool = True) -> DataFrame:
    """Keep the last of equal sites of a structure. Input: structure_id, site, res_name, res_num, part, het, ec.

    Strict: equal (name, number, part) sets and EC; otherwise equal (name, part) sets. Hetero groups are compared apart.
    """
    item = F.struct("res_name", "res_num", "part") if strict else F.struct("res_name", "part")
    ordered = lambda het: F.array_sort(F.collect_set(F.when(F.col("het") == het, item)))
    sig = sites.groupBy("structure_id", "site").agg(ordered(False).alias("s"), ordered(True).alias("h"), F.max("ec").alias("ec"))
    keys = ["structure_id", "s", "h"] + (["ec"] if strict else [])
    return sig.groupBy(*keys).agg(F.max("site").alias("site")).select("structure_id", "site")


def chain_census(atoms: DataFrame) -> DataFrame:
    """Counts at chain, model, structure and corpus level (rollup): residues, atoms, hetero atoms, chains, elements.

    Atoms are first added up per residue, so the rollup carries one row per residue and no distinct counts.
    """
    per_res = atoms.groupBy("structure_id", "model", "chain", "res_num", "icode", "res_name").agg(
        F.count_if(F.col("record") == "ATOM").alias("a"), F.count_if(F.col("record") != "ATOM").alias("h"), F.collect_set("element").alias("e"))
    per_chain = per_res.groupBy("structure_id", "model", "chain").agg(
        F.count(F.lit(1)).alias("r"), F.sum("a").alias("a"), F.sum("h").alias("h"), F.array_distinct(F.flatten(F.collect_set("e"))).alias("e"))
    return per_chain.rollup("structure_id", "model", "chain").agg(
        F.count(F.lit(1)).alias("n_chains"), F.sum("r").alias("n_residues"), F.sum("a").alias("n_atoms"), F.sum("h").alias("n_het"),
        F.size(F.array_distinct(F.flatten(F.collect_set("e")))).alias("n_elements"))


def chain_type(atoms: DataFrame) -> DataFrame:
    """Protein, RNA, DNA, SOLVENT or HETERO by the residues of each class."""
    res = atoms.groupBy(*RES, "res_name").agg(F.first("record")).withColumn("k", codes.residue_class(F.col("res_name")))
    n = {k: F.count_if(F.col("k") == v).alias(k) for k, v in
         {"aa": "AMINO-ACID", "rna": "RNA", "dna": "DNA", "sol": "SOLVENT", "het": "HETERO"}.items()}
    c = res.groupBy("ck").agg(*n.values())
    nucleic = F.col("rna") + F.col("dna")
    kind = (F.when((F.col("het") + nucleic < F.col("aa")) | (F.col("aa") > nucleic), "Protein")
            .when(nucleic > 0, F.when(F.col("rna") > 0, "RNA").otherwise("DNA"))
            .when(F.col("sol") > F.col("het"), "SOLVENT").otherwise("HETERO"))
    return c.select("ck", kind.alias("type"))


def mass_and_centre(atoms: DataFrame) -> DataFrame:
    """Mass, mass-weighted centre, barycentre and largest distance from the barycentre of each chain."""
    m = atoms.select("ck", "x", "y", "z", codes.lookup(K.MASSES, F.col("element"), 0.0).alias("m"))
    agg = m.groupBy("ck").agg(F.sum("m").alias("mass"), *[(F.sum(F.col("m") * F.col(c)) / F.sum("m")).alias(f"m{c}") for c in "xyz"],
                              *[F.avg(c).alias(f"b{c}") for c in "xyz"])
    r = G.distance(G.point("x", "y", "z"), G.point("bx", "by", "bz"))
    radius = m.join(agg.select("ck", "bx", "by", "bz"), "ck").groupBy("ck").agg(F.max(r).alias("radius"))
    return agg.join(radius, "ck")


def runtime_estimate(atoms: DataFrame) -> DataFrame:
    """Predicted seconds of the single-structure program for each chain, full and fast."""
    x = F.col("n")
    n = atoms.select("ck", "res_num").distinct().groupBy("ck").agg(F.count(F.lit(1)).alias("n"))
    return n.select("ck", "n", (16.8 + 0.163 * x - 4.3e-5 * x * x).cast("int").alias("full"), (4.23 + 0.0412 * x - 8.42e-6 * x * x).cast("int").alias("fast"))

