"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.llm.work import ascii_lower


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Rows are grouped by (128-bit hash, whole normalised text): the hash
    deals the rows out and rejects most comparisons, the text itself decides, so two texts that share a hash stay apart. The
    grouping adds up copies before the shuffle, hence a text that makes up a third of all rows costs one row per task. Only
    (id, hash, sha-256) is joined back, where Spark may split a hot key.

    ``keep`` names the id that stays: ``min`` (the smallest) or ``max``. Null texts count as empty and form one group with empty
    ones. A null id stays only if its group has no other id. Repeated rows all appear, and each counts in ``group_size``.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max: {keep}")
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    keyed = rows.select("id", "norm", content_hash(F.col("norm")).alias("h"))
    classes = keyed.groupBy("h", "norm").agg(getattr(F, keep)("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select(F.col("h").alias("g_h"), F.sha2("norm", 256).alias("g_sha"), "keep_id", "group_size")
    each = keyed.select("id", "h", F.sha2("norm", 256).alias("text_sha256"))
    joined = each.join(classes, (F.col("h") == F.col("g_h")) & (F.col("text_sha256") == F.col("g_sha")))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The input's rows and columns with one row per different text (see ``exact_groups``); repeated rows leave one.

    The rows that stay are joined by one key of id and SHA-256, by which repeated rows are found without dealing the texts out again.
    """
    named = F.when(F.col(id_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(id_col).cast("string")))
    stay = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.concat_ws("|", named, "text_sha256").alias("__key")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.select(*columns, F.concat_ws("|", named, F.sha2(ascii_lower(F.col(text_col)), 256)).alias("__key"))
    return tagged.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select(*columns)
