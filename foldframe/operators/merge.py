"""Merging of compact units into domains: beam search over partitions.

A partition is an array of domains, a domain the sorted array of its unit numbers. A chain has at most 33 units, so
partitions and the unit matrix are small arrays in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.session import written

DOMS = "array<array<int>>"


def unit_matrix(unit_sums: DataFrame, units: DataFrame) -> DataFrame:
    """One row per chain: ck, npu, sums (unit contacts, row by row), starts and ends of the units."""
    flat = unit_sums.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("a", "b", "s"))).alias("_m"))
    spans = units.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("pu", "start", "end"))).alias("_u"))
    return flat.join(spans, "ck").select("ck", F.size("_u").alias("npu"), F.col("_m.s").alias("sums"), F.col("_u.start").alias("starts"),
                                         F.col("_u.end").alias("ends"))


def total(items: Column, value) -> Column:
    """Sum of value(x) over an array."""
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def block_sum(a: Column, b: Column) -> Column:
    """Sum of unit contacts between two unit sets."""
    return total(a, lambda u: total(b, lambda v: F.get("sums", u * F.col("npu") + v)))


def domain_size(pus: Column) -> Column:
    return total(pus, lambda u: F.get("ends", u) - F.get("starts", u) + 1).cast("int")


#: What a partition carries beside its domains: inner sums and sizes of the domains, and the contacts between them as the upper triangle of
#: their matrix, row by row.
CARRIED = ("inn", "size", "ext")


def domain_pairs(n: Column) -> Column:
    """Pairs (i, j), i < j, of n domains in the order of ``ext``."""
    row = lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))
    none = F.array().cast("array<struct<i:int,j:int>>")
    return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), row))).otherwise(none)


def contacts_of(a: Column, b: Column) -> Column:
    """Entry of ``ext`` between domains a < b of the row."""
    return F.get("ext", F.shiftright(a * (2 * F.size("doms") - a - 1), 1) + b - a - 1)


def condensed(partitions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Partitions with their carried columns; those that have them stay as they are, others get them from the unit contacts."""
    if set(CARRIED) <= set(partitions.columns):
        return partitions
    between = F.transform(domain_pairs(F.size("doms")), lambda p: block_sum(F.get("doms", p["i"]), F.get("doms", p["j"])))
    return partitions.join(matrix, "ck").select(*partitions.columns, F.transform("doms", lambda d: block_sum(d, d) / 2).alias("inn"),
                                                F.transform("doms", domain_size).alias("size"), between.alias("ext"))


def normalised(ext: Column, size_a: Column, size_b: Column) -> Column:
    return ext / (F.pow(size_a, F.lit(K.SIZE_EXPONENT)) * F.pow(size_b, F.lit(K.SIZE_EXPONENT)))


def scored_pairs(partitions: DataFrame) -> DataFrame:
    """Add ``_p``: of every pair of domains key (falling ratio, rounded), i, j, nnc and ratio."""

    def scored(p: Column, sums: Column) -> Column:
        i, j = p["i"], p["j"]
        nnc = normalised(F.greatest(sums, F.lit(K.EXTERNAL_FLOOR)), F.get("size", i), F.get("size", j))
        ratio = nnc / ((F.get("inn", i) + F.get("inn", j)) / (F.get("size", i) * F.get("size", j)))
        return F.struct((-F.round(ratio, 9)).alias("key"), i.alias("i"), j.alias("j"), nnc.alias("nnc"), ratio.alias("ratio"))

    return partitions.withColumn("_p", F.zip_with(domain_pairs(F.size("doms")), "ext", scored))


def worth_trying(keep_nnc: float) -> Column:
    """Of ``_p`` the pair with the best ratio and every pair with nnc above the limit."""
    best = F.array_min("_p")
    return F.filter("_p", lambda p: (p["nnc"] > keep_nnc) | ((p["i"] == best["i"]) & (p["j"] == best["j"])))


def merge_candidates(partitions: DataFrame, matrix: DataFrame, keep_nnc: float = K.KEEP_NNC) -> DataFrame:
    """Mergers worth trying: of each partition the pair with the best ratio and every pair with nnc above the limit.

    Pairs are scored from the partition's carried sums inside its row; only the mergers worth trying become rows. ``rank`` is the place among all
    pairs of the partition by ratio.
    """
    rows = scored_pairs(condensed(partitions, matrix).where(F.size("doms") > 1)).select("ck", "doms", F.array_sort("_p").alias("_p"))
    rows = rows.select("ck", "doms", F.posexplode("_p").alias("_k", "_m")).where((F.col("_k") == 0) | (F.col("_m.nnc") > keep_nnc))
    out = rows.select("ck", "doms", (F.col("_k") + 1).alias("rank"), "_m.i", "_m.j", "_m.nnc", "_m.ratio")
    a, b = F.get("doms", F.col("i")), F.get("doms", F.col("j"))
    return out.withColumn("child", F.array_sort(F.concat(F.array_except("doms", F.array(a, b)), F.array(F.array_sort(F.concat(a, b))))))


def merged(partitions: DataFrame) -> DataFrame:
    """Partitions with their domains i < j made one: the new domain's contacts are the sum of both rows, all others stay.

    Domains are ordered by their first unit, so the new one takes the place of i.
    """
    i, j, last = F.col("i"), F.col("j"), F.size("doms") - 2
    old = lambda p: F.when(p < j, p).otherwise(p + 1)
    met = lambda a, b: contacts_of(F.least(a, b), F.greatest(a, b))

    def between(p: Column) -> Column:
        a, b = old(p["i"]), old(p["j"])
        return F.when(a == i, met(a, b) + met(j, b)).when(b == i, met(a, b) + met(a, j)).otherwise(contacts_of(a, b))

    def each(name: str, joined) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.when(p == i, joined).otherwise(F.get(name, old(p)))).alias(f"_{name}")

    two = lambda name: F.get(name, i) + F.get(name, j)
    # the new columns get their names afterwards: inside a lambda Spark would take an alias of the same select for the column it replaces
    new = partitions.select("ck", each("doms", F.array_sort(F.concat(F.get("doms", i), F.get("doms", j)))), each("inn", two("inn") + contacts_of(i, j)), each("size", two("size")),
                            F.transform(domain_pairs(last + 1), between).alias("_ext"), "_k")
    return new.select("ck", *[F.col(f"_{c}").alias(c) for c in ("doms", *CARRIED)], "_k")


def partition_measures(partitions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Number of domains, smallest size, largest contact ratio, smallest density and mean density (kappa), all within the row."""

    def ratio(p: Column, ext: Column) -> Column:
        a, b = p["i"], p["j"]
        return normalised(ext, F.get("size", a), F.get("size", b)) / ((ext + F.get("inn", a) + F.get("inn", b)) / (F.get("size", a) + F.get("size", b)))

    density = F.zip_with("inn", "size", lambda inn, size: inn / size)
    n = F.size("doms")
    measured = lambda c: F.when(n == 1, 0.0).otherwise(c)
    return condensed(partitions, matrix).select(
        *[c for c in partitions.columns if c not in CARRIED], n.alias("n"), F.array_min("size").alias("min_size"),
        F.coalesce(F.array_max(F.zip_with(domain_pairs(n), "ext", ratio)), F.lit(0.0)).alias("max_cr"), measured(F.array_min(density)).alias("min_density"),
        measured(total(density, lambda x: x) / n).alias("kappa"))


def merge_beam(matrix: DataFrame, beam: int = K.BEAM) -> DataFrame:
    """All partitions met while merging units down to one domain, for all chains at once: ck, doms and the carried sums.

    Every step merges two domains of each kept partition; a chain keeps its ``beam`` mergers with the highest nnc, equal
    partitions once. A partition carries the contacts between its domains and a merger adds two of their rows, so unit contacts are read only at the
    start; a step is one shuffle by chain. Chains with fewer units finish earlier and drop out.
    """
    n, single = F.col("npu"), F.transform(F.sequence(F.lit(0), F.col("npu") - 1), lambda u: F.array(u)).cast(DOMS)
    inner = F.transform(F.sequence(F.lit(0), n - 1), lambda u: F.get("sums", u * n + u) / 2)
    size = F.zip_with("starts", "ends", lambda s, e: (e - s + 1).cast("int"))
    live = written(matrix.select("ck", single.alias("doms"), inner.alias("inn"), size.alias("size"), F.transform(domain_pairs(n), lambda p: F.get("sums", p["i"] * n + p["j"])).alias("ext")), "units")
    steps = [live]
    for _ in range(int(live.agg(F.max(F.size("doms"))).first()[0] or 1) - 1):
        tried = scored_pairs(live.where(F.size("doms") > 1)).withColumn("_m", F.explode(worth_trying(K.KEEP_NNC))).select(*live.columns, "_m.i", "_m.j", "_m.nnc")
        w = W.partitionBy("ck").orderBy(F.desc(F.round("nnc", 9)), "doms", "i", "j")
        best = merged(tried.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= beam))
        once = best.withColumn("_one", F.row_number().over(W.partitionBy("ck", "doms").orderBy("_k"))).where("_one = 1")
        live = written(once.select(*live.columns), "beam")
        steps.append(live)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def domain_fragments(partitions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Add ``domains``: per domain its fragments, abutting units joined: array<array<struct<start, end>>>."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def joined(pus: Column) -> Column:
        frags = F.transform(pus, lambda u: F.struct(F.get("starts", u).alias("start"), F.get("ends", u).alias("end")))

        def step(acc: Column, f: Column) -> Column:
            last = F.element_at(acc, -1)
            grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), f["end"].alias("end"))))
            touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] + 1 == f["start"])
            return F.when(touches, grown).otherwise(F.concat(acc, F.array(f)))

        return F.aggregate(frags, none, step)

    with_m = partitions.join(matrix.select("ck", "starts", "ends"), "ck")
    return with_m.withColumn("domains", F.transform("doms", joined)).drop("starts", "ends")


def join_adjacent_units(fragments: DataFrame) -> DataFrame:
    """Collapse abutting fragments of a domain. Input: ck, part, dom, start, end; gaps-and-islands on the start order."""
    keys = ["ck", "part", "dom"]
    w = W.partitionBy(*keys).orderBy("start")
    opens = fragments.withColumn("_o", F.coalesce((F.lag("end").over(w) + 1 != F.col("start")).cast("int"), F.lit(1)))
    isl = opens.withColumn("_g", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return isl.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
