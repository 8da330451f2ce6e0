"""Expressions and joins that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, staged

__all__ = ["WORD_GAP", "lower_ascii", "read", "rounded", "staged", "stored", "words"]

#: A word is a longest run of characters other than these (Java regular expression).
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of ``text`` in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rounded(value: Column, digits: int = 9) -> Column:
    """Keep ``digits`` significant digits, so that the order in which parts were summed leaves no trace."""
    size = F.floor(F.log10(F.abs(value)))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / F.pow(F.lit(10.0), size), digits - 1) * F.pow(F.lit(10.0), size))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder with the tighter codec, for tables that are large and stay, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
