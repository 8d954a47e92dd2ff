"""Pieces that several text operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else. The same class in Java's, Python's and DuckDB's patterns.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files of public tokenizers have ``name``; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, so that columns of the input are never overwritten."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def told_apart(key: str | Column) -> Column:
    """The key as text that is never null, so that equal keys, null ones too, can be joined and grouped by plain equality."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), key.cast("string")))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; of an empty text for a null key."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def buckets(rows: int, each: int = 50_000, least: int = 64) -> int:
    """A power of two such that ``rows`` even shares hold about ``each`` rows."""
    return max(least, 1 << math.ceil(math.log2(max(1, rows / each))))


#: Rows of a few short columns that may be sent to all tasks; more are joined by a shuffle.
BROADCAST = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """``keys``, which should be cheap to count, marked to be sent to all tasks if there are at most ``BROADCAST`` of them."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys
