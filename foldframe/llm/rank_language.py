"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.work import slices

PROFILE = 400
UNKNOWN = "und"
#: Profiles are sent to every task: PROFILE rows for each language, for so many languages at most.
MAX_LANGUAGES = 10_000
EDGE = 0x1FFFFF  # stands for the border of a word; no character has this number
MERGE_AT = 2_000_000


@cache
def letters() -> np.ndarray:
    """Which code points are letters; built once in each Python worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> np.ndarray:
    """All 1- to 3-grams of letters and word borders of the texts, in lower case, each packed into 63 bits (21 a character)."""
    codes = np.frombuffer(" ".join(t for t in texts if t).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other characters the first
    x = np.concatenate(([EDGE], np.where(letter, codes, EDGE)[keep], [EDGE])).astype(np.int64)
    if letter.any() and x[-2] == EDGE:
        x = x[:-1]
    inner = x[1:-1] != EDGE
    pairs = (x[:-1] << 21) | x[1:]
    return np.concatenate((x[x != EDGE], pairs if letter.any() else pairs[:0], ((pairs[:-1] << 21) | x[2:])[inner]))


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram, rank from 0): the ``size`` most frequent n-grams of all labelled texts of a language.

    Every task adds up its own n-grams first, so the shuffle holds one row per task, language and distinct n-gram, however common
    a language is; the ranking keeps ``size`` rows per language and task. Ties in count go to the smaller gram. Rows without
    language or text teach nothing.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = counted(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for part in slices(batches):
            by: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                found = np.unique(grams(texts), return_counts=True)
                held.setdefault(lang, []).append(found)
                size_held += len(found[0])
            if size_held > MERGE_AT:
                held = {lang: [counted(parts)] for lang, parts in held.items()}
                size_held = sum(len(p[0][0]) for p in held.values())
                if size_held > MERGE_AT // 2:
                    yield from out()
                    held, size_held = {}, 0
        yield from out()

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    # Asked of the row number itself, the limit also acts before the window's shuffle.
    return place.where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """All languages' profiles as sorted arrays."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams, self.ranks = [], []
        for lang in self.langs:
            mine = np.array(sorted((g, k) for x, g, k in rows if x == lang), np.int64)
            self.grams.append(mine[:, 0])
            self.ranks.append(mine[:, 1])

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language as a share of the largest possible; None without letters or languages."""
        found = grams([text])
        if not len(found) or not self.langs:
            return None
        keys, counts = np.unique(found, return_counts=True)
        top = keys[np.lexsort((keys, -counts))[: self.size]]
        rank = np.arange(len(top))
        out = np.empty(len(self.langs))
        for i, (have, place) in enumerate(zip(self.grams, self.ranks, strict=True)):
            at = np.minimum(np.searchsorted(have, top), len(have) - 1)
            out[i] = np.where(have[at] == top, np.minimum(np.abs(place[at] - rank), self.size), self.size).sum() / (len(top) * self.size)
        return out


def predict_language(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """One row per input row: id, lang_pred, score; the language whose profile is nearest to the whole text's.

    The score is one less the distance (0 to 1); a tie goes to the smaller name. A text that is null or has no letter gets ``und``
    and score 0, as does every text when there is no profile. Only id and text are read; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = profiles.select("lang", "gram", "rank")
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(sent.value, size)
        for part in slices(batches):
            langs, scores = [], []
            for text in part.column("text").to_pylist():
                d = known.distances(text)
                langs.append(UNKNOWN if d is None else known.langs[int(d.argmin())])
                scores.append(0.0 if d is None else 1.0 - float(d.min()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Rows that never teach: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def learned_profiles(docs: DataFrame) -> DataFrame:
    """Profiles from the documents that teach, written once."""
    from foldframe.llm.work import Work

    return Work(docs.sparkSession, "language").keep(learn_profiles(docs.where(~held_out(F.col("doc_id"))).select("text", "lang")), "profiles")
