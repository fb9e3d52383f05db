"""Preference formatting of chats: the common turns of a chosen and a rejected conversation once as prompt, then both completions
with loss masks. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the chat template (fixed values), and what a mark inside a text becomes.
OPEN, CLOSE, BROKEN = "<|im_start|>", "<|im_end|>", "<| im_"
TRAINED_ROLE = "assistant"
#: Columns that ``preference_pairs`` makes, and those that it holds for a while.
RESULTS = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans", "__c", "__r", "__cp", "__rp")


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, turns as array<struct<role, text>> in order of turn, role and text (nulls first, then empty).

    One shuffle on the id. A conversation is one document: its turns meet in one row, as its rendering does. Rows without an id form one
    conversation; repeated rows repeat their turn.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(row)).alias("t"))
    return grouped.select(id_col, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns with equal role and text."""
    both = F.least(F.size(chosen), F.size(rejected))
    unlike = F.zip_with(F.slice(chosen, F.lit(1), both), F.slice(rejected, F.lit(1), both), lambda a, b: (a["role"] != b["role"]) | (a["text"] != b["text"]))
    first = F.array_position(unlike, F.lit(True))
    return F.when(first > 0, first - 1).otherwise(both).cast("int")


def rendered(turns: Column) -> Column:
    """Turns as the pieces of the template; a mark inside a text is broken so that it can't open or close a turn."""
    clean = lambda text: F.replace(text, F.lit("<|im_"), F.lit(BROKEN))
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), clean(t["role"]), F.lit("\n"), clean(t["text"]), F.lit(CLOSE + "\n")))


def loss_spans(turns: Column, pieces: Column) -> Column:
    """array<struct<start, length>> in characters of the joined pieces: texts of the trained role with their closing mark."""
    ends = F.aggregate(F.transform(pieces, lambda p: F.length(p)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    span = lambda t, i: F.struct((F.get(ends, i) + F.length(F.lit(OPEN)) + F.length(t["role"]) + 1).alias("start"),
                                 (F.length(F.get(pieces, i)) - F.length(F.lit(OPEN)) - F.length(t["role"]) - 2).alias("length"), t["role"].alias("role"))
    return F.transform(F.filter(F.transform(turns, span), lambda s: s["role"] == TRAINED_ROLE), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(..., chosen, rejected: array<struct<role, text>>) to prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    The longest common turn prefix is rendered once as the prompt, which is never trained on. Each completion is what its
    conversation adds; its spans say which characters carry loss. Where one conversation is the beginning of the other its completion is
    empty, and equal ones have two empty completions. A null or empty conversation has no turns. All other columns pass through but
    those named like a result, which the result replaces.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda c: F.transform(F.coalesce(F.col(c), empty), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rest = [F.col(f"`{c}`") for c in pairs.columns if c.lower() not in RESULTS]
    cut = pairs.select(*rest, plain("chosen").alias("__c"), plain("rejected").alias("__r")).withColumn("prompt_turns", common_turns(F.col("__c"), F.col("__r")))
    tail = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    parts = cut.select(*rest, "prompt_turns", F.array_join(rendered(F.slice("__c", F.lit(1), F.col("prompt_turns"))), "").alias("prompt"), tail("__c").alias("__c"), tail("__r").alias("__r"))
    parts = parts.withColumn("__cp", rendered(F.col("__c"))).withColumn("__rp", rendered(F.col("__r")))
    return parts.select(*rest, "prompt_turns", "prompt", F.array_join("__cp", "").alias("chosen"), F.array_join("__rp", "").alias("rejected"),
                        loss_spans(F.col("__c"), F.col("__cp")).alias("chosen_spans"), loss_spans(F.col("__r"), F.col("__rp")).alias("rejected_spans"))


def derived_rejections(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Chosen and rejected conversations from plain ones: in the rejected one, an assistant turn (the id modulo their number) says what
    the next assistant turn says (the last: the first; the only one: nothing). Without assistant turns the last turn is missing."""
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == TRAINED_ROLE)
    marked = convs.withColumn("a", places).withColumn("k", F.size("a")).withColumn("j", F.when(F.col("k") > 0, F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.col("k")).cast("int")))
    marked = marked.withColumn("d", F.get("a", "j")).withColumn("says", F.when(F.col("k") > 1, F.get("turns", F.get("a", F.pmod(F.col("j") + 1, F.col("k"))))["text"]).otherwise(""))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("d"), F.col("says")).otherwise(t["text"]).alias("text")))
    return marked.select(id_col, F.col("turns").alias("chosen"), F.when(F.col("k") > 0, swapped).otherwise(F.slice("turns", F.lit(1), F.size("turns") - 1)).alias("rejected"))
