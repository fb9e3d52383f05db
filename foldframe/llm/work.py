"""Shared helpers of the text operators: intermediate tables, words, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_AT_ONCE = 256
#: Bits of the filter sent to every task by ``among`` (64 in a row); fewer let more rows through, never fewer.
FILTER_BITS = 1 << 25


class Work:
    """Intermediate tables of one run, below the cluster's shared folder (``spark.checkpoint.dir``).

    A written table cuts lineage, survives the loss of any executor and is read again instead of being computed again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark's cleaner free the shuffles behind all that is written."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        jvm.System.gc()


def among(rows: DataFrame, wanted: DataFrame, *keys: str, out: bool = False) -> DataFrame:
    """The rows whose keys occur in ``wanted``, and a few others whose keys share their bit: an exact join has to follow. ``out``: all other rows.

    The join then deals out little more than the rows it needs, not all of them. What is sent to the tasks has a fixed bound.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    slot, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marks = wanted.groupBy(slot.alias("__slot")).agg(F.bit_or(bit).alias("__bits"))
    return rows.join(F.broadcast(marks), (slot == F.col("__slot")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_anti" if out else "left_semi")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return) of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python objects of few rows exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)
