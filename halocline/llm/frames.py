"""Spark helpers the operators share: slim tables in the shared folder, row keys and fixed-size membership filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from halocline import session
from halocline.session import scratch

__all__ = ["filter_words", "kept", "lower_ascii", "might_hold", "read", "row_key", "same_key", "tune"]

#: Bits of a membership filter: 2**24, at most 2**18 rows of 64 bits whatever the size of the data.
FILTER_BITS = 24

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of one Arrow batch between Spark and its Python workers: both sides hold some of them at a time.
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches of texts that are cut by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return session.tune(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


def row_key(*columns):
    """64-bit key of a row's content; equal rows have equal keys on any executor."""
    return F.xxhash64(*columns)


def same_key(left: DataFrame, right: DataFrame, *names: str):
    """Null-safe equality on these columns."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def filter_words(df: DataFrame, column: str) -> DataFrame:
    """A membership filter for a column of longs: rows (w, bits), at most 2**18 of them."""
    hashed = df.select(F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS).alias("_h"))
    return (hashed.select(F.shiftright("_h", 6).alias("w"), F.expr("shiftleft(1L, cast(_h & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("bits")))


def might_hold(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows whose value may be in the filter; all that are in it stay. The broadcast side is at most 2**18 rows."""
    return (df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS))
            .join(F.broadcast(words), F.expr("shiftright(_h, 6) = w AND shiftleft(1L, cast(_h & 63 as int)) & bits != 0"))
            .drop("_h", "w", "bits"))
