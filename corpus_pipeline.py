"""The corpus pipeline: language, exact copies, near copies, benchmark passages, encoding, each stage over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.exact_dedup import drop_exact_copies
from foldframe.llm.jaccard_join import drop_near_copies
from foldframe.llm.merge_encoding import encode_decode
from foldframe.llm.queries import model_file
from foldframe.llm.rank_language import UNKNOWN, learned_profiles, predict_language
from foldframe.llm.suffix_decontam import drop_contaminated
from foldframe.llm.work import Work

#: SQL can't express the language and encoding stages; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: texts that are null or have no letter. All others stay, whatever their language."""
    text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = predict_language(docs.select(text, F.col("text")), learned_profiles(docs), "row", "text")
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest id."""
    return drop_exact_copies(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more stays: the one with the smallest id."""
    return drop_near_copies(docs, words=5, num=80, den=100)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty lies in a benchmark passage of 13 words go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids: doc_id, lang, source, n_tokens, ids (with the end id) and whether they decode to the text."""
    rest = F.struct("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).alias("row")
    coded = encode_decode(docs.select(rest, "text"), model_file(), "row", "text")
    return coded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("row.text")).alias("round_trip"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            work.drop(str(k - 1))
    return docs
