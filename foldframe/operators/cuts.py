"""Search for cuts that split a chain into compact units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.operators import contacts as CT
from foldframe.session import spread

ROWS = 256
Cut = tuple[float, int, int]  # score, first cut, second cut (-1: none); a cut lies after its position


def span_blocks(xyz: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of p over the square a..b x a..b for all a <= b, by blocks of rows a from the chain end to its start.

    Row a adds to row a + 1 its own contacts with a..b, twice off the diagonal; only one block is held at a time.
    """
    n = len(xyz)
    p0 = 1.0 / (1.0 + np.exp(-K.CONTACT_D0 / K.CONTACT_DELTA))
    carry = np.zeros(n)
    for lo in range((n - 1) // ROWS * ROWS, -1, -ROWS):
        hi = min(lo + ROWS, n)
        d = np.sqrt(((xyz[lo:hi, None, :] - xyz[None, :, :]) ** 2).sum(axis=2))
        p = np.triu(1.0 / (1.0 + np.exp((d - K.CONTACT_D0) / K.CONTACT_DELTA)), k=lo + 1)
        own = np.triu(2.0 * np.cumsum(p, axis=1) + p0, k=lo)
        sums = np.cumsum(own[::-1], axis=0)[::-1] + carry
        carry = sums[0]
        yield lo, sums


def score(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Separation of two parts with inner sums a, b and cross sum c; -inf where undefined or not positive."""
    den = (a + c) * (b + c)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (a * b - c * c) / den
    return np.where((den != 0) & (s > 0), np.round(s, 9), -np.inf)


def segment_cuts(xyz: np.ndarray, ok: np.ndarray, with_double: bool = True) -> tuple[Cut | None, Cut | None]:
    """Best single and best double cut of one segment; ``ok`` says where it may be cut (before the position).

    The first sweep over the span sums serves the single cut; the double one needs the sums up to both ends first and sweeps
    again, so memory stays one block of rows whatever the length.
    """
    n = len(xyz)
    if n - 1 < K.PU_MIN:
        return None, None
    left, right = np.zeros(n), np.zeros(n + 1)
    for lo, sums in span_blocks(xyz):
        left = sums[0]
        right[lo:lo + len(sums)] = sums[:, n - 1]
    total = left[n - 1]
    single = double = None
    i = np.arange(K.PU_MIN, n - K.PU_MIN)
    i = i[ok[i + 1]]
    if len(i):
        s = score(left[i], right[i + 1], (total - left[i] - right[i + 1]) / 2)
        k = int(np.argmax(s))
        single = (float(s[k]), int(i[k]), -1) if s[k] > -np.inf else None
    if not with_double:
        return single, None
    j = np.arange(n)
    j_ok = np.append(ok[1:], False) & (j <= n - 1 - 15)
    for lo, sums in span_blocks(xyz):
        a = np.arange(lo, lo + len(sums))
        a = a[(a - 1 >= K.PU_MIN - 1) & (a - 1 < n - 1 - K.PU_MIN) & (a - 1 + 60 < n - 1 - 15) & ok[a]]
        if not len(a):
            continue
        inner = sums[a - lo]
        before, after = left[a - 1][:, None], right[j + 1][None, :]
        cross = (left[None, :] - before - inner + right[a][:, None] - inner - after) / 2
        s = score(inner, total - inner - 2 * cross, cross)
        s = np.where(j_ok[None, :] & (j[None, :] >= a[:, None] - 1 + 30), s, -np.inf)
        k = int(np.argmax(s))
        best = (float(s.flat[k]), int(a[k // n]) - 1, int(k % n))
        if best[0] > -np.inf and (double is None or best[0] > double[0] or (best[0] == double[0] and best[1] < double[1])):
            double = best
    return single, double


def best_of(single: Cut | None, double: Cut | None) -> Cut | None:
    """The better cut; an equal score keeps the single one."""
    if single and (double is None or double[0] <= single[0]):
        return single
    return double


def unit_levels(xyz: np.ndarray, ok: np.ndarray, limit: int, levels: int, max_size: int) -> list[tuple[int, int, int, int, float]]:
    """Successive splits of one chain, best cut first: rows (level, ord, start, end, score of the level's cut)."""
    find = lambda s, e: best_of(*segment_cuts(xyz[s:e + 1], ok[s:e + 1]))
    open_units = [(0, len(xyz) - 1, find(0, len(xyz) - 1))]
    rows = [(0, 0, 0, len(xyz) - 1, 0.0)]
    for level in range(1, levels):
        scored = [(u[2][0], -k) for k, u in enumerate(open_units) if u[2]]
        if len(open_units) - 1 > limit or not scored or (max_size and all(e - s <= max_size for s, e, _ in open_units)):
            break
        k = -max(scored)[1]
        s, e, (value, i, j) = open_units[k]
        ends = [s + i, e] if j < 0 else [s + i, s + j, e]
        starts = [s] + [x + 1 for x in ends[:-1]]
        fresh = [(a, b, find(a, b)) for a, b in zip(starts, ends, strict=True)]
        open_units = fresh + open_units[:k] + open_units[k + 1:]
        rows += [(level, o, a, b, value) for o, (a, b, _) in enumerate(open_units)]
    return rows


def packed_chains(residues: DataFrame) -> DataFrame:
    """One row per chain with its CA coordinates and cut mask as arrays in index order. Input: ck, idx, ca, cuttable."""
    rows = spread(residues, "ck").groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("idx", "ca.x", "ca.y", "ca.z", "cuttable"))).alias("_r"))
    return rows.select("ck", *[F.col(f"_r.{c}").alias(c) for c in ("x", "y", "z", "cuttable")])


def _xyz(row) -> np.ndarray:
    return np.column_stack([row.x, row.y, row.z])


def segment_best_cuts(chains: DataFrame, segments: DataFrame, kinds: tuple[str, ...] = ("single", "double")) -> DataFrame:
    """Best cuts of each segment (ck, seg, start, end): kind, score, i, j (chain positions); only the asked kinds are searched.

    The segments of a chain travel with it in one row.
    """
    packed = segments.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("seg", "start", "end"))).alias("_s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                xyz, ok = _xyz(row), np.asarray(row.cuttable)
                for seg, s, e in zip(row.seg, row.start, row.end, strict=True):
                    cuts = segment_cuts(xyz[s:e + 1], ok[s:e + 1], "double" in kinds)
                    out += [(row.ck, seg, kind, cut[0], s + cut[1], s + cut[2] if cut[2] >= 0 else -1)
                            for kind, cut in zip(("single", "double"), cuts, strict=True) if cut and kind in kinds]
            yield pd.DataFrame(out, columns=["ck", "seg", "kind", "score", "i", "j"])

    rows = chains.join(packed, "ck").select("ck", F.col("_s.seg").alias("seg"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "x", "y", "z", "cuttable")
    return rows.mapInPandas(run, "ck string, seg int, kind string, score double, i int, j int")


def best_single_cut(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """Best cut in two parts of each segment."""
    return segment_best_cuts(chains, segments, ("single",)).select("ck", "seg", "score", "i")


def best_double_cut(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """Best cut in three parts of each segment."""
    return segment_best_cuts(chains, segments, ("double",)).select("ck", "seg", "score", "i", "j")


def split_levels(chains: DataFrame, limit: int = K.PU_LIMIT, levels: int = K.LEVEL_CAP, max_size: int = 0) -> DataFrame:
    """All levels of splitting before the compaction stop: ck, level, ord, start, end, score. Level 0 is the whole chain.

    The search needs one chain at a time, so it runs where the packed chain lies, without any shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(row.ck, *r) for row in pdf.itertuples(index=False)
                   for r in unit_levels(_xyz(row), np.asarray(row.cuttable), limit, levels, max_size)]
            yield pd.DataFrame(out, columns=["ck", "level", "ord", "start", "end", "score"])

    return chains.mapInPandas(run, "ck string, level int, ord int, start int, end int, score double")


def finest_units(levels: DataFrame) -> DataFrame:
    """Units of each chain's last level, numbered by position: ck, pu, start, end."""
    top = F.max("level").over(W.partitionBy("ck"))
    last = levels.withColumn("_m", top).where("level = _m")
    return last.select("ck", (F.row_number().over(W.partitionBy("ck").orderBy("start")) - 1).alias("pu"), "start", "end")


def assign_units(residues: DataFrame, units: DataFrame) -> DataFrame:
    """Attach to every residue the unit (ck, pu, start, end) it lies in."""
    at = units.select("ck", "pu", F.explode(F.sequence("start", "end")).alias("idx"))
    return residues.join(at, ["ck", "idx"])


def peel_levels(residues: DataFrame, levels: DataFrame, ci_stop: float = K.CI_STOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels up to the compaction stop with their measures, and the block sums of the finest units.

    The pair table is read once, for the finest units; every coarser level adds up those sums. Returns (levels with
    ci, r, max_cr, min_density; finest units; their block sums).
    """
    fine = finest_units(levels)
    sums = CT.pu_contacts(assign_units(residues.select("ck", "idx", "ca"), fine))
    inner = fine.select("ck", F.col("pu").alias("part"), F.col("start").alias("_s"))
    members = (levels.withColumnRenamed("ord", "pu").join(inner, "ck").where(F.col("_s").between(F.col("start"), F.col("end")))
               .select("ck", "level", "pu", "part"))
    keys = ["ck", "level"]
    level_sums = CT.coarsen(sums, members, keys)
    sizes = levels.select("ck", "level", F.col("ord").alias("pu"), (F.col("end") - F.col("start") + 1).alias("size"))
    measures = CT.compaction_index(level_sums, keys).join(CT.pu_quality(level_sums, sizes, keys), keys)
    w = W.partitionBy("ck").orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.bool_or(F.col("ci") > ci_stop).over(w), F.lit(False))
    kept = measures.withColumn("_x", stopped).where("not _x").drop("_x")
    return levels.join(kept, keys), fine, sums
