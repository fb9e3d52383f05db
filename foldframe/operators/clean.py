"""Row filters and residue-level cleaning on the atom table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.functions import codes
from foldframe.functions import geometry as G
from foldframe.session import written

RESIDUE = ["ck", "res_num", "icode"]


def select_model(atoms: DataFrame, n: int = 1) -> DataFrame:
    """Keep one model."""
    return atoms.where(F.col("model") == n)


def select_chain(atoms: DataFrame, ids: Iterable[str] | None = None, exclude: bool = False) -> DataFrame:
    """Keep (or drop) the given chain labels; by default keep the alphabetically first label of each structure."""
    if ids is not None:
        hit = F.col("chain").isin(*ids)
        return atoms.where(~hit if exclude else hit)
    first = atoms.groupBy("structure_id").agg(F.min("chain").alias("chain"))
    return atoms.join(first, ["structure_id", "chain"], "left_semi")


def missing_chains(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested (structure_id, chain) rows that the atom table does not hold."""
    return wanted.join(atoms.select("structure_id", "chain").distinct(), ["structure_id", "chain"], "left_anti")


def keep_standard_protein(atoms: DataFrame) -> DataFrame:
    """Keep ATOM records of the twenty residues."""
    return atoms.where((F.col("record") == "ATOM") & F.col("res_name").isin(*K.THREE_TO_ONE))


def drop_insertion_residues(atoms: DataFrame) -> DataFrame:
    """Drop every residue whose number also occurs with an insertion code."""
    coded = atoms.where(F.col("icode") != " ").select("ck", "res_num").distinct()
    return atoms.join(coded, ["ck", "res_num"], "left_anti")


def resolve_altloc(atoms: DataFrame, mode: str = "blank_or_a") -> DataFrame:
    """One location per atom: blank or A, or the first one listed; the column is blank afterwards."""
    if mode == "blank_or_a":
        kept = atoms.where(F.col("alt_loc").isin(" ", "A"))
    elif mode == "first":
        w = W.partitionBy(*RESIDUE, "res_name", "atom_name").orderBy("serial")
        kept = atoms.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    else:
        raise ValueError(mode)
    return kept.withColumn("alt_loc", F.lit(" "))


def backbone_table(atoms: DataFrame) -> DataFrame:
    """One row per residue in file order with its N, CA, C, O points (null when missing)."""
    pick = lambda name: F.max(F.when(F.col("atom_name") == name, G.point("x", "y", "z"))).alias(name.lower())
    return atoms.groupBy(*RESIDUE).agg(F.min("serial").alias("first_serial"), F.first("res_name").alias("res_name"),
                                       *[pick(a) for a in K.BACKBONE])


def superposed(residues: DataFrame, limit: float = 1.0, every: bool = True, atoms: tuple[str, ...] = ("n", "ca", "c", "o")) -> DataFrame:
    """Residues to drop because they lie on their neighbour: the one with an insertion code, else the second."""
    w = W.partitionBy("ck").orderBy("first_serial")
    hit = None
    for a in atoms:
        near = G.distance(F.col(a), F.lag(a).over(w)) < limit
        hit = near if hit is None else (hit & near if every else hit | near)
    flagged = residues.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    second = F.col("_hit") & ((F.col("icode") != " ") | (F.lag("icode").over(w) == " "))
    first = F.lead("_hit", 1, False).over(w) & (F.col("icode") != " ") & (F.lead("icode").over(w) == " ")
    return flagged.withColumn("_drop", second | first).where("_drop").select(*RESIDUE)


def drop_superposed_residues(atoms: DataFrame, limit: float = 1.0, every: bool = True,
                             names: tuple[str, ...] = ("n", "ca", "c", "o")) -> DataFrame:
    """Remove superposed neighbour residues until none is left."""
    while True:
        drop = written(superposed(backbone_table(atoms), limit, every, names), "superposed")
        if drop.isEmpty():
            return atoms
        atoms = written(atoms.join(drop, RESIDUE, "left_anti"), "apart")  # else each pass repeats the ones before


def standardise_residues(atoms: DataFrame, modified: dict[str, str] | None = None, told: DataFrame | None = None) -> DataFrame:
    """Rename modified residues to the standard twenty (else UNK) and promote embedded HETATM runs to ATOM.

    ``told``: structure_id, res_name, standard, as a file's own MODRES records say (see ``modified_residues``); it goes before the
    table ``modified``.

    A HETATM run is promoted when its numbering continues the ATOM block before it and the ATOM block after it
    continues its own.
    """
    table = {**{c: c for c in K.THREE_TO_ONE}, **(modified or K.MODIFIED)}
    w = W.partitionBy("ck").orderBy("serial")
    change = F.coalesce((F.lag("record").over(w) != F.col("record")).cast("int"), F.lit(0))
    runs = atoms.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = runs.groupBy("ck", "_run").agg(F.first("record").alias("rec"), F.min_by("res_num", "serial").alias("a"),
                                          F.max_by("res_num", "serial").alias("b"))
    v = W.partitionBy("ck").orderBy("_run")
    promoted = (ends.withColumn("_p", (F.col("rec") == "HETATM") & (F.lag("b").over(v) == F.col("a") - 1)
                                & (F.lead("a").over(v) == F.col("b") + 1))
                .select("ck", "_run", F.coalesce("_p", F.lit(False)).alias("_p")))
    out = runs.join(promoted, ["ck", "_run"])
    becomes_atom = (F.col("record") == "ATOM") | F.col("_p")
    own = F.lit(None).cast("string")
    if told is not None:
        named = told.groupBy("structure_id", "res_name").agg(F.min("standard").alias("_own"))
        out, own = out.join(named, ["structure_id", "res_name"], "left"), F.col("_own")
    standard = F.coalesce(own, codes.lookup(table, F.col("res_name"), "UNK"))
    return (out.withColumn("res_name", F.when(becomes_atom, standard).otherwise(F.col("res_name")))
            .withColumn("record", F.when(becomes_atom, "ATOM").otherwise(F.col("record"))).select(*atoms.columns))


def select_representation(atoms: DataFrame, name: str) -> DataFrame:
    """Keep the atom types of one representation; adds ``atom_type``."""
    kind = F.concat(codes.one_letter(F.col("res_name")), F.col("atom_name"))
    return atoms.withColumn("atom_type", kind).where(F.col("atom_type").isin(*K.representation(name)))


SHORTCUTS = {"BB": ("N", "CA", "C", "O", "OXT"), "CA": ("CA",)}


def select_atoms(atoms: DataFrame, residues: Iterable[str] | None = None, names: Iterable[str] | str | None = None,
                 elements: Iterable[str] | None = None, negate: bool = False) -> DataFrame:
    """Keep (or with ``negate`` drop) atoms by residue name, atom name and element; names may be BB, SC or CA."""
    cond: Column = F.lit(True)
    if residues is not None:
        cond = cond & F.col("res_name").isin(*residues)
    if names == "SC":
        cond = cond & ~F.col("atom_name").isin(*SHORTCUTS["BB"])
    elif names is not None:
        cond = cond & F.col("atom_name").isin(*(SHORTCUTS[names] if isinstance(names, str) else names))
    if elements is not None:
        cond = cond & F.col("element").isin(*elements)
    return atoms.where(~cond if negate else cond)


def select_residues(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keep residues listed as (ck, res_num)."""
    return atoms.join(wanted.select("ck", "res_num").distinct(), ["ck", "res_num"], "left_semi")


def residue_names(atoms: DataFrame, what: str = "all", solvent: bool = True) -> DataFrame:
    """Distinct residue names with their class: std (twenty), lstd (amino acids), het (others), shet (others, no solvent)."""
    named = atoms.select("structure_id", "res_name").distinct().withColumn("class", codes.residue_class(F.col("res_name")))
    keep = {"all": F.lit(True), "std": F.col("res_name").isin(*K.THREE_TO_ONE), "lstd": F.col("class") == "AMINO-ACID",
            "het": F.col("class") != "AMINO-ACID", "shet": ~F.col("class").isin("AMINO-ACID", "SOLVENT")}[what]
    return named.where(keep if solvent else keep & (F.col("class") != "SOLVENT"))


def mask_residues(residues: DataFrame, masks: DataFrame) -> DataFrame:
    """Keep residues whose character in the chain's mask (ck, mask) is not a dash."""
    kept = (masks.select("ck", F.posexplode(F.split("mask", "")).alias("idx", "_m")).where("_m <> '-'").select("ck", "idx"))
    return residues.join(kept, ["ck", "idx"], "left_semi")


def alignment_mask(aligned: DataFrame) -> DataFrame:
    """Positions of the first sequence that face a residue in a pairwise alignment (ck, first, second)."""
    cols = aligned.select("ck", F.posexplode(F.arrays_zip(F.split("first", "").alias("a"), F.split("second", "").alias("b"))).alias("p", "s"))
    w = W.partitionBy("ck").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    at = cols.select("ck", "p", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    at = at.withColumn("idx", (F.sum((F.col("a") != "-").cast("int")).over(w) - 1).cast("int"))
    return at.where("a <> '-' and b <> '-'").select("ck", "idx")


def slice_by_sequence(residues: DataFrame, sequences: DataFrame, seed: str) -> DataFrame:
    """Residues that spell the first occurrence of ``seed`` in the chain's sequence (ck, seq)."""
    hits = sequences.select("ck", (F.instr("seq", seed) - 1).alias("_at")).where("_at >= 0")
    return residues.join(hits, "ck").where(F.col("idx").between(F.col("_at"), F.col("_at") + len(seed) - 1)).drop("_at")


def has_only_ca(atoms: DataFrame) -> DataFrame:
    """Whether a chain holds CA atoms only."""
    return atoms.groupBy("ck").agg(F.when(F.bool_and(F.col("atom_name") == "CA"), "Yes").otherwise("No").alias("only_ca"))


def number_map(atoms: DataFrame) -> DataFrame:
    """Author number to dense 0-based index along the chain, in order of first appearance."""
    first = atoms.groupBy(*RESIDUE).agg(F.min("serial").alias("_s"))
    w = W.partitionBy("ck").orderBy("_s")
    return first.select("ck", F.col("res_num").alias("auth_num"), "icode", (F.row_number().over(w) - 1).alias("idx"))


def renumber_residues(atoms: DataFrame) -> DataFrame:
    """Attach the dense index ``idx`` to every atom."""
    m = number_map(atoms).withColumnRenamed("auth_num", "res_num").withColumnRenamed("idx", "new_idx")
    return atoms.join(m, RESIDUE).withColumn("idx", F.col("new_idx")).drop("new_idx")


def renumber_atoms_chains_models(atoms: DataFrame, first_atom: int = 1, first_model: int = 1) -> DataFrame:
    """Atoms numbered from ``first_atom`` within a model, chains lettered from A, models from ``first_model``."""
    order = W.partitionBy("structure_id", "model").orderBy("serial")
    chains = atoms.groupBy("structure_id", "chain").agg(F.min("serial").alias("_f"))
    chains = chains.select("structure_id", "chain", codes.chain_letter(
        F.row_number().over(W.partitionBy("structure_id").orderBy("_f", "chain"))).alias("new_chain"))
    models = atoms.select("structure_id", "model").distinct()
    models = models.select("structure_id", "model", (F.row_number().over(W.partitionBy("structure_id").orderBy("model"))
                                                     + (first_model - 1)).alias("new_model"))
    return (atoms.withColumn("new_serial", F.row_number().over(order) + (first_atom - 1))
            .join(chains, ["structure_id", "chain"]).join(models, ["structure_id", "model"]))


def clean(atoms: DataFrame, model: int = 1) -> DataFrame:
    """The usual preparation: one model, twenty residues, no insertions, one location per atom."""
    return resolve_altloc(drop_insertion_residues(keep_standard_protein(select_model(atoms, model))))


def residues_of(atoms: DataFrame) -> DataFrame:
    """Residue table of cleaned atoms: dense index, author number, one-letter code and backbone points."""
    w = W.partitionBy("ck").orderBy("first_serial")
    return backbone_table(atoms).select(
        "ck", (F.row_number().over(w) - 1).alias("idx"), F.col("res_num").alias("auth_num"),
        codes.one_letter(F.col("res_name")).alias("aa"), "n", "ca", "c", "o")
