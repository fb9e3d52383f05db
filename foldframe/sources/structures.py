"""Readers of structure text: coordinates, headers, tables and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe.functions import codes

# Columns of the coordinate record (1-based start, length).
ATOM_FIELDS = {"record": (1, 6), "serial": (7, 5), "atom_name": (13, 4), "alt_loc": (17, 1), "res_name": (18, 3), "chain": (22, 1),
               "res_num": (23, 4), "icode": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "occ": (55, 6), "bfac": (61, 6), "element": (77, 2)}
ATOM_TYPES = {"serial": "int", "res_num": "int", "x": "double", "y": "double", "z": "double", "occ": "double", "bfac": "double"}
KEEP_BLANK = ("alt_loc", "icode", "chain")
STEM = r"([^/]+?)(\.[^/.]+)*$"


def file_id(pattern: str = STEM) -> Column:
    """Structure id from the file path: by default the file name without its extensions."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def _blocks(spark: SparkSession, path: str, sep: str, pattern: str) -> DataFrame:
    """Text between separators, one row each: splits stay small whatever the file holds, and nothing is shuffled."""
    return spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(path).select(
        file_id(pattern).alias("structure_id"), "value")


def _held(df: DataFrame, **cols: Column) -> DataFrame:
    """The structure id and the columns computed once: a generator keeps Spark from copying their expressions into what follows."""
    row = F.struct("structure_id", *[c.alias(n) for n, c in cols.items()])
    return df.select(F.explode(F.array(row)).alias("_h")).select("_h.*")


def structure_lines(spark: SparkSession, path: str, pattern: str = STEM) -> DataFrame:
    """Lines of coordinate files with their model number: structure_id, model, line_no, line.

    Records end at a line ENDMDL, so a row is one model and carries its own MODEL number (1 when the file has none); line_no
    orders the lines of a model. What follows the last ENDMDL belongs to no model. The number is read before the lines are dealt out:
    beside them, Spark would search the whole model for it once a line.
    """
    number = F.regexp_extract("value", r"(?m)^MODEL\s+(\d+)", 1)
    after = F.col("value").rlike(r"\A *\r?\n")  # the rest of an ENDMDL line
    model = F.when(number != "", number.cast("int")).when(~after, 1)
    blocks = _held(_blocks(spark, path, "\nENDMDL", pattern), model=model, lines=F.split("value", "\r?\n"))
    return blocks.select("structure_id", "model", F.posexplode("lines").alias("line_no", "line")).where(F.length("line") > 0)


def scan_structures(spark: SparkSession, path: str, pattern: str = STEM) -> DataFrame:
    """Fixed-width ATOM and HETATM lines as the atom table; compressed files are unpacked by their extension."""
    lines = structure_lines(spark, path, pattern).where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    fields = []
    for name, (start, size) in ATOM_FIELDS.items():
        raw = F.substring("line", start, size)
        col = raw if name in KEEP_BLANK else F.trim(raw)
        if name in KEEP_BLANK:
            col = F.when(raw == "", " ").otherwise(raw)
        fields.append((col.cast(ATOM_TYPES[name]) if name in ATOM_TYPES else col).alias(name))
    atoms = lines.select("structure_id", "model", "line_no", *fields, F.substring("line", 13, 4).alias("_field"))
    element = F.when(F.col("element") == "", codes.element_of_field(F.col("_field"))).otherwise(F.col("element"))
    return atoms.withColumn("element", element).drop("_field").withColumn("ck", F.concat_ws("_", "structure_id", F.col("model").cast("string"), F.trim("chain")))


def modified_residues(lines: DataFrame) -> DataFrame:
    """What a file's MODRES records say about its modified residues: structure_id, res_name, standard. Input: ``structure_lines``."""
    rows = lines.where(F.substring("line", 1, 6) == "MODRES")
    named = rows.select("structure_id", F.trim(F.substring("line", 13, 3)).alias("res_name"), F.trim(F.substring("line", 25, 3)).alias("standard"))
    return named.where("res_name <> '' and standard <> ''").distinct()


# Items of the atom loop and the columns they fill.
CIF_ITEMS = {"record": "group_PDB", "serial": "id", "atom_name": "label_atom_id", "alt_loc": "label_alt_id", "res_name": "label_comp_id",
             "chain": "auth_asym_id", "res_num": "auth_seq_id", "icode": "pdbx_PDB_ins_code", "x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z",
             "occ": "occupancy", "bfac": "B_iso_or_equiv", "element": "type_symbol", "model": "pdbx_PDB_model_num"}


#: One token of mmCIF text: a text block between semicolons at line starts, a quoted value (its quote ends before white space only), a comment, a word.
CIF_TOKEN = r"""(?sm)^;.*?\n;(?=\s|\z)|'[^'\n]*+(?:'(?!\s|\z)[^'\n]*+)*+'|"[^"\n]*+(?:"(?!\s|\z)[^"\n]*+)*+"|#[^\n]*+|\S+"""
#: Words that end the values of a loop; they count only outside quotes and text blocks.
CIF_STOP = r"(?i)^(_.*|loop_|stop_|global_|data_.*|save_.*)$"


def scan_mmcif(spark: SparkSession, path: str, pattern: str = STEM) -> DataFrame:
    """Rows of the atom loop of mmCIF files as the atom table, whatever the order of its columns; one row in per data block.

    The block is cut into tokens, so values may be quoted, hold blanks or span lines, several rows may share a line and a row several lines,
    and atom lines in text blocks or other loops are not atoms. The loop's values end at the next tag or keyword; a last row that is not
    whole is left out. Blocks without an atom loop give no rows. Blocks begin at ``data_`` at a line start, so no text block may hold such a line.
    """
    tokens = F.filter(F.regexp_extract_all("value", F.lit(CIF_TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))
    site = lambda t: F.lower(F.substring(t, 1, 11)) == "_atom_site."
    from_first = lambda col, test: F.array_position(F.transform(col, test), True).cast("int")

    block = _held(_blocks(spark, path, "\ndata_", pattern).where(F.lower("value").contains("_atom_site.")), t=tokens)
    block = _held(block, t=F.col("t"), first=from_first("t", site)).where("first > 0")
    block = _held(block, t=F.slice("t", F.greatest(F.lit(1), "first"), F.size("t")))
    block = _held(block, t=F.col("t"), wide=F.greatest(F.lit(0), from_first("t", lambda t: ~site(t)) - 1))
    block = _held(block, names=F.transform(F.slice("t", 1, F.col("wide")), lambda n: F.substring(n, 12, 200)), t=F.slice("t", F.col("wide") + 1, F.size("t")))
    block = _held(block, names=F.col("names"), t=F.col("t"), stop=from_first("t", lambda t: t.rlike(CIF_STOP)))
    n, values = F.size("names"), F.when(F.col("stop") > 0, F.col("stop") - 1).otherwise(F.size("t"))
    block = _held(block, names=F.col("names"), t=F.col("t"), n=n, whole=F.floor(values / F.greatest(F.lit(1), n)).cast("int")).where("whole > 0")
    t = block.select("structure_id", "names", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda k: F.slice("t", k * F.col("n") + 1, F.col("n")))).alias("line_no", "v"))

    def item(col: str, name: str) -> Column:
        token = F.get("v", (F.array_position("names", name) - 1).cast("int"))
        raw = F.when(token.startswith(";") & token.contains("\n"), F.regexp_replace(token, r"(?s)^;(.*)\r?\n;$", "$1")).otherwise(F.regexp_replace(token, r"(?s)^([\"'])(.*)\1$", "$2"))
        val = F.when(raw.isin(".", "?"), " ").otherwise(raw) if col in ("alt_loc", "icode") else raw
        kind = ATOM_TYPES.get(col, "int" if col == "model" else None)
        return (val.try_cast(kind) if kind else val).alias(col)

    atoms = t.select("structure_id", "line_no", *[item(c, n) for c, n in CIF_ITEMS.items()]).where(F.col("record").isin("ATOM", "HETATM"))
    return atoms.withColumn("ck", F.concat_ws("_", "structure_id", F.col("model").cast("string"), "chain"))


def scan_manifest(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """List of codes or files with an optional chain: code (4 characters) + chain, or ``path chain``.

    ``pattern`` takes ``folder`` from the path of each list, where several folders have their own.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    folder = [] if pattern is None else [file_id(pattern).alias("folder")]
    line = text.select(*folder, F.trim("value").alias("line")).where("line <> ''")
    parts = F.split("line", r"\s+")
    short = (F.size(parts) == 1) & (F.length("line") <= 5)
    return line.select(*(["folder"] if folder else []), F.when(short, F.substring("line", 1, 4)).otherwise(F.get(parts, F.lit(0))).alias("code"),
                       F.when(short, F.substring("line", 5, 1)).otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("chain"))


def resolve_manifest(manifest: DataFrame, files: DataFrame, chains: DataFrame) -> DataFrame:
    """First existing file of each entry and the chains to use; an unknown chain falls back to all chains.

    ``files``: name; ``chains``: name, chain. Names are tried as XXXX.pdb, xxxx.pdb, pdbxxxx.ent, pdbXXXX.ent, then as given. With a column
    ``folder`` in all three, entries meet the files of their own folder only.
    """
    by = ["folder"] if "folder" in manifest.columns else []
    up, low = F.upper("code"), F.lower("code")
    names = F.array(F.concat(up, F.lit(".pdb")), F.concat(low, F.lit(".pdb")), F.concat(F.lit("pdb"), low, F.lit(".ent")),
                    F.concat(F.lit("pdb"), up, F.lit(".ent")), F.col("code"))
    tried = manifest.select(*by, "code", "chain", F.posexplode(names).alias("_k", "name")).join(files.select(*by, "name").distinct(), [*by, "name"])
    found = tried.groupBy(*by, "code", "chain").agg(F.min_by("name", "_k").alias("name"))
    every = found.join(chains.withColumnRenamed("chain", "has"), [*by, "name"])
    known = F.max((F.col("has") == F.col("chain")).cast("int")).over(W.partitionBy(*by, "code", "chain"))
    return every.withColumn("_k", known).where((F.col("_k") == 0) | (F.col("has") == F.col("chain"))).select(
        *by, "code", "chain", "name", F.col("has").alias("use_chain"))


def scan_pair_files(spark: SparkSession, path: str, value: str, pattern: str = STEM, bins: int | None = None, names: str = "*") -> DataFrame:
    """One short file of numbers per pair, a line per bin: pair, bin, value. A wrong number of bins is an error.

    ``names`` is the glob of the files to read: a folder also holds bin centres, parameters and rankings.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path, wholetext=True)
    nums = F.filter(F.split("value", r"\s+"), lambda s: s != "")
    rows = text.select(file_id(pattern).alias("pair"), nums.alias("v"))
    if bins is not None:
        rows = rows.withColumn("v", F.when(F.size("v") == bins, F.col("v")).otherwise(
            F.raise_error(F.concat(F.lit("bin count differs: "), "pair")).cast("array<string>")))
    return rows.select("pair", F.posexplode("v").alias("bin", "_s")).select("pair", "bin", F.col("_s").cast("double").alias(value))


def scan_potentials(spark: SparkSession, path: str, pattern: str = STEM, bins: int | None = None, names: str = "*.nrg*") -> DataFrame:
    """Energies of a potential directory: pair, bin, e."""
    return scan_pair_files(spark, path, "e", pattern, bins, names)


def scan_frequencies(spark: SparkSession, path: str, pattern: str = STEM, bins: int = 150, names: str = "*.frq*") -> DataFrame:
    """Frequencies per pair or of the reference: pair, bin, f."""
    return scan_pair_files(spark, path, "f", pattern, bins, names)


def scan_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Named values of a potential, one row: key=value lines in any order."""
    kv = spark.read.text(path).where("value like '%=%'").select(F.split("value", "=").alias("p"))
    return kv.agg(*[F.max(F.when(F.trim(F.col("p")[0]) == k, F.trim(F.col("p")[1]))).alias(k.lower())
                    for k in ("DIFFMIN", "DIFFMAX", "DISTMAX", "DISTMIN", "REPRES")])


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records as written: ck (the header line) and value; records end where the next begins, so files split anywhere."""
    rows = spark.read.option("lineSep", ">").option("recursiveFileLookup", "true").text(path).where("value <> ''")
    return rows.select(F.split("value", "\n")[0].alias("ck"), F.concat(F.lit(">"), F.regexp_replace("value", "\n+\\z", "")).alias("value"))


def scan_dssp(spark: SparkSession, path: str, pattern: str = STEM) -> DataFrame:
    """Fixed-width secondary-structure tables: structure_id, line_no, res_num, chain, aa, ss; break rows are left out."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    body = F.get(F.split("value", r"RESIDUE AA STRUCTURE[^\n]*\n", 2), F.lit(1))
    lines = text.select(file_id(pattern).alias("structure_id"), F.posexplode(F.split(body, "\r?\n")).alias("line_no", "line"))
    f = lambda start, size: F.substring("line", start, size)
    return (lines.where((F.length("line") > 16) & (f(14, 1) != "!"))
            .select("structure_id", "line_no", F.trim(f(6, 5)).cast("int").alias("res_num"), f(12, 1).alias("chain"), f(14, 1).alias("aa"), f(17, 1).alias("ss")))


SPANS = "array<array<struct<start:int,end:int>>>"


def scan_assignments(spark: SparkSession, path: str, pattern: str = STEM) -> DataFrame:
    """Assignment lines of reports: n, min_size, domains, kappa, quality (null for n/a) and the report's ambiguity."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    mark = F.length(F.regexp_extract("value", r"A-index = (\+*)", 1))
    reports = _held(text.select(file_id(pattern).alias("structure_id"), "value"), ambiguity=mark, lines=F.split("value", "\r?\n"))
    lines = reports.select("structure_id", "ambiguity", F.posexplode("lines").alias("line_no", "line"))
    cell = F.split("line", r"\|")
    part = lambda k: F.trim(F.get(cell, F.lit(k)))
    span = lambda s: F.struct(F.get(F.split(s, "-"), F.lit(0)).cast("int").alias("start"), F.get(F.split(s, "-"), F.lit(1)).cast("int").alias("end"))
    domains = F.transform(F.split(part(2), r"\s+"), lambda d: F.transform(F.split(d, ";"), span))
    return lines.where(F.col("line").rlike(r"^\d+\s*\|")).select(
        "structure_id", "line_no", "ambiguity", part(0).cast("int").alias("n"), part(1).cast("int").alias("min_size"), domains.alias("domains"),
        part(3).cast("double").alias("kappa"), F.when(part(4) != "n/a", F.length(part(4))).alias("quality"))


def scan_peeling_levels(spark: SparkSession, path: str, numbers: DataFrame | None = None, pattern: str = STEM) -> DataFrame:
    """Level lines ``max_cr min_density ci r n s e s e ...``: measures and sorted segments, in author numbers when given.

    ``numbers``: structure_id, idx, auth_num.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    lines = text.select(file_id(pattern).alias("structure_id"), F.explode(F.split("value", "\r?\n")).alias("line")).where(F.col("line").rlike(r"^\s*[-0-9]"))
    t = lines.select("structure_id", F.split(F.trim("line"), r"\s+").alias("v"))
    num = lambda k: F.get("v", F.lit(k)).cast("double")
    n = F.get("v", F.lit(4)).cast("int")
    segs = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("v", 5 + 2 * k).cast("int").alias("start"), F.get("v", 6 + 2 * k).cast("int").alias("end"))))
    out = t.select("structure_id", num(0).alias("max_cr"), num(1).alias("min_density"), num(2).alias("ci"), num(3).alias("r"), n.alias("n"), segs.alias("segs"))
    out = out.select("structure_id", "max_cr", "min_density", "ci", "r", "n", F.posexplode("segs").alias("ord", "s")).select("*", "s.start", "s.end").drop("s")
    if numbers is None:
        return out
    a = numbers.select("structure_id", F.col("idx").alias("start"), F.col("auth_num").alias("a"))
    b = numbers.select("structure_id", F.col("idx").alias("end"), F.col("auth_num").alias("b"))
    return (out.join(a, ["structure_id", "start"]).join(b, ["structure_id", "end"])
            .withColumn("start", F.col("a")).withColumn("end", F.col("b")).drop("a", "b"))


def header_metadata(lines: DataFrame) -> DataFrame:
    """Id, title, compound, source, author, keywords, date, method, resolution, R value and free R per structure."""
    tag = F.trim(F.substring("line", 1, 6))
    body = F.trim(F.substring("line", 11, 70))

    def joined(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(tag == name, F.struct("line_no", body.alias("t")))))
        return F.nullif(F.array_join(F.transform(rows, lambda s: s["t"]), " "), F.lit("")).alias(name.lower())

    def remark(pattern: str, name: str) -> Column:
        hit = F.regexp_extract("line", pattern, 1)
        return F.max(F.when((tag == "REMARK") & (hit != ""), hit)).cast("double").alias(name)

    first = lambda c: F.max(F.when(tag == "HEADER", F.trim(c)))
    rows = lines.where(tag.isin("HEADER", "TITLE", "COMPND", "SOURCE", "AUTHOR", "KEYWDS", "EXPDTA", "REMARK"))
    return rows.groupBy("structure_id").agg(
        first(F.substring("line", 63, 4)).alias("id"), first(F.substring("line", 51, 9)).alias("date"), joined("TITLE"), joined("COMPND"),
        joined("SOURCE"), joined("AUTHOR"), joined("KEYWDS"), joined("EXPDTA").alias("method"),
        remark(r"^REMARK   2 RESOLUTION\.\s+([0-9.]+)", "resolution"), remark(r"^REMARK   3\s+R VALUE\s+\(WORKING SET\)\s*:\s*([0-9.]+)", "r_value"),
        remark(r"^REMARK   3\s+FREE R VALUE\s*:\s*([0-9.]+)", "free_r"))


def seqres_sequence(lines: DataFrame) -> DataFrame:
    """Declared sequence per chain, X for unknown residues."""
    rows = lines.where(F.substring("line", 1, 6) == "SEQRES").select(
        "structure_id", F.substring("line", 12, 1).alias("chain"), "line_no", F.split(F.trim(F.substring("line", 20, 60)), r"\s+").alias("v"))
    seq = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.transform("v", codes.one_letter).alias("c")))), lambda s: s["c"])), "")
    return rows.groupBy("structure_id", "chain").agg(seq.alias("seq"))
