"""Choice among partitions: domain count, alternatives, ambiguity and consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe import constants as K
from foldframe.functions import scores as S
from foldframe.operators.merge import domain_size
from foldframe.session import written


def with_quality(measures: DataFrame) -> DataFrame:
    """Add the signed quality distance and the stars."""
    return (measures.withColumn("distance", S.quality_distance(F.col("max_cr"), F.col("min_density")))
            .withColumn("quality", S.quality_stars(F.col("distance"), F.col("n"))))


def predict_domain_count(measures: DataFrame) -> DataFrame:
    """Largest n for which the densest partition of every count from 2 to n is accepted, else 1: ck, n_pred."""
    w = W.partitionBy("ck", "n").orderBy(F.desc(F.round("kappa", 9)), "doms")
    best = measures.where("n > 1").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    up = W.partitionBy("ck").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    run = best.select("ck", "n", (F.bool_and(S.accepts_count(F.col("max_cr"), F.col("min_density"))).over(up)
                                  & (F.count(F.lit(1)).over(up) == F.col("n") - 1)).alias("ok"))
    found = run.where("ok").groupBy("ck").agg(F.max("n").alias("n_pred"))
    return measures.select("ck").distinct().join(found, "ck", "left").select("ck", F.coalesce("n_pred", F.lit(1)).alias("n_pred"))


def best_matching(weights: np.ndarray) -> float:
    """Largest total weight of a one-to-one matching of rows and columns (shortest augmenting paths)."""
    n = max(weights.shape)
    cost = np.zeros((n, n))
    cost[:weights.shape[0], :weights.shape[1]] = -weights
    u, v, match = np.zeros(n), np.zeros(n), np.full(n, -1)
    for row in range(n):
        low, back, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        cur, col = row, -1
        while True:
            slack = cost[cur] - u[cur] - v
            better = ~done & (slack < low)
            low[better], back[better] = slack[better], col
            nxt = int(np.argmin(np.where(done, np.inf, low)))
            delta = low[nxt]
            tree = np.flatnonzero(done)
            u[row] += delta
            u[match[tree]] += delta
            v[tree] -= delta
            low[~done] -= delta
            done[nxt], col = True, nxt
            if match[nxt] < 0:
                break
            cur = match[nxt]
        while col >= 0:
            prev = back[col]
            match[col] = row if prev < 0 else match[prev]
            col = prev
    rows = match[np.arange(n)]
    return float(-cost[rows, np.arange(n)].sum())


def partition_overlap(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """Percent of positions labelled alike under the best relabelling. Input: ck, doms_a, doms_b, more columns are kept.

    Unequal numbers of domains with more than seven on a side count as 0. The best relabelling is exact for any number.
    """
    common = F.flatten(F.transform("doms_a", lambda a: F.transform("doms_b", lambda b: domain_size(F.array_intersect(a, b)).cast("double"))))
    rows = (pairs.join(matrix, "ck").select(*pairs.columns, common.alias("_w"), F.size("doms_a").alias("_na"), F.size("doms_b").alias("_nb"),
                                            domain_size(F.flatten("doms_b")).alias("_all")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share = [0.0 if a != b and max(a, b) > 7 else 100.0 * best_matching(np.asarray(w, float).reshape(a, b)) / t
                     for w, a, b, t in zip(pdf.pop("_w"), pdf.pop("_na"), pdf.pop("_nb"), pdf.pop("_all"), strict=True)]
            yield pdf.assign(overlap=share)

    # nested arrays travel as JSON text, the matching only needs the weights
    nested = ["doms_a", "doms_b"]
    flat = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])
    schema = T.StructType([*[flat.schema[c] for c in pairs.columns], T.StructField("overlap", T.DoubleType())])
    out = flat.mapInPandas(run, schema)
    return out.select(*[F.from_json(c, "array<array<int>>").alias(c) if c in nested else F.col(c) for c in out.columns])


def _redundant(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    return partition_overlap(pairs, matrix).where(F.col("overlap") >= K.OVERLAP_REDUNDANT)


def pick_alternatives(measures: DataFrame, matrix: DataFrame, levels: int = 3, per_level: int = 3) -> DataFrame:
    """Optimum and alternatives of each chain: measures plus quality, n_pred, alt_id (0 is the optimum).

    Per domain count the partitions closer than the distance limit are taken by falling kappa; a later one that overlaps
    an earlier choice by 85 percent or more is passed over (each choice is compared with the next twenty at most). Counts
    above n_pred + levels and above 6 are not compared. The optimum is the best one at n_pred; alternatives have two or
    more domains, a count within ``levels`` of n_pred and another kappa than the optimum.
    """
    measures = written(measures, "measures")
    pred = predict_domain_count(measures)
    w = W.partitionBy("ck", "n").orderBy(F.desc(F.round("kappa", 9)), "doms")
    near = with_quality(measures).join(pred, "ck").where((F.col("n") == 1) | (F.col("distance") < K.ALT_MAX_DISTANCE))
    near = near.where(F.abs(F.col("n") - F.col("n_pred")) <= levels)
    # a chain whose partitions at n_pred are all too far keeps its densest one as optimum
    lost = pred.join(near.where("n = n_pred").select("ck").distinct(), "ck", "left_anti")
    spare = with_quality(measures).join(lost, "ck").where("n = n_pred").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    near = near.unionByName(spare.select(*near.columns))
    left = written(near.withColumn("rn", F.row_number().over(w)), "ranked")
    chosen = left.where("rn = 1")
    for step in range(1, per_level):
        # compare the latest choice with the next twenty, drop what repeats it, and take the next one left
        last = chosen.groupBy("ck", "n").agg(F.max_by("doms", "rn").alias("doms_a"), F.max("rn").alias("at"))
        after = left.withColumn("pos", F.row_number().over(w)).join(last, ["ck", "n"])
        pairs = after.where((F.col("rn") > F.col("at")) & (F.col("pos") <= step + K.ALT_COMPARE)).select(
            "ck", "n", "doms_a", F.col("doms").alias("doms_b"))
        gone = _redundant(pairs, matrix).select("ck", "n", F.col("doms_b").alias("doms"))
        left = written(left.join(gone, ["ck", "n", "doms"], "left_anti").select(*left.columns), "left")
        chosen = left.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= step + 1).drop("pos")
    best = left.where((F.col("rn") == 1) & (F.col("n") == F.col("n_pred"))).select("ck", F.col("doms").alias("_od"), F.col("kappa").alias("_ok"))
    rows = chosen.join(best, "ck").withColumn("is_optimum", F.col("doms") == F.col("_od"))
    rows = rows.where("is_optimum or (n > 1 and kappa <> _ok)")
    order = W.partitionBy("ck").orderBy(F.desc("is_optimum"), F.desc("n"), "rn")
    return rows.withColumn("alt_id", F.row_number().over(order) - 1).drop("_od", "_ok", "rn", "is_optimum")


def ambiguity_index(assignments: DataFrame) -> DataFrame:
    """Largest k up to 5 such that k assignments have quality k or more; assignments without quality are left out."""
    w = W.partitionBy("ck").orderBy(F.desc("quality"))
    ranked = assignments.where("quality is not null").withColumn("_k", F.row_number().over(w))
    return (ranked.groupBy("ck").agg(F.least(F.lit(5), F.max(F.least("quality", "_k"))).alias("ambiguity")))


def domain_consistency(assignments: DataFrame) -> DataFrame:
    """How often each distinct domain occurs among the assignments of a chain."""
    return assignments.select("ck", F.explode("doms").alias("domain")).groupBy("ck", "domain").agg(F.count(F.lit(1)).alias("n"))


def junction_consistency(assignments: DataFrame) -> DataFrame:
    """Outer ends of all domains with count, count / lines and stars / lines. Input: ck, domains (fragments), quality."""
    rated = assignments.where("quality is not null")
    lines = W.partitionBy("ck")
    dom = rated.withColumn("_n", F.count(F.lit(1)).over(lines)).select("ck", "_n", "quality", F.explode("domains").alias("d"))
    at = dom.select("ck", "_n", "quality", F.explode(F.array(F.element_at("d", 1)["start"], F.element_at("d", -1)["end"])).alias("position"))
    return at.groupBy("ck", "position").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.first("_n")).alias("raw"),
                                            (F.sum("quality") / F.first("_n")).alias("weighted"))


def inner_junctions(junctions: DataFrame) -> DataFrame:
    """Junctions without the first and the last of the chain."""
    w = W.partitionBy("ck")
    return (junctions.withColumn("_a", F.min("position").over(w)).withColumn("_b", F.max("position").over(w))
            .where((F.col("position") > F.col("_a")) & (F.col("position") < F.col("_b"))).drop("_a", "_b"))


def report_window(assignments: DataFrame, width: int = 2, per_count: int = 2) -> DataFrame:
    """Lines to show: the optimum first, then up to two per domain count within two of the optimum's count."""
    opt = F.max(F.when(F.col("alt_id") == 0, F.col("n"))).over(W.partitionBy("ck"))
    w = W.partitionBy("ck", "n").orderBy("alt_id")
    shown = (assignments.withColumn("_o", opt).withColumn("_k", F.row_number().over(w))
             .where((F.col("_k") <= per_count) & (F.abs(F.col("n") - F.col("_o")) <= width)))
    line = W.partitionBy("ck").orderBy((F.col("alt_id") != 0), "n", "alt_id")
    return shown.withColumn("line", F.row_number().over(line)).drop("_o", "_k")


def author_numbering(fragments: DataFrame, numbers: DataFrame) -> DataFrame:
    """Replace internal positions start, end by author numbers. ``numbers``: ck, idx, auth_num."""
    a = numbers.select("ck", F.col("idx").alias("start"), F.col("auth_num").alias("auth_start"))
    b = numbers.select("ck", F.col("idx").alias("end"), F.col("auth_num").alias("auth_end"))
    return fragments.join(a, ["ck", "start"]).join(b, ["ck", "end"])

