"""Telling apart, where they lie, rows that a shuffled join with many narrow keys can concern from all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a filter, at most: a broadcast of some 40 MB.
FILTER_WORDS = 1 << 19


def sieved(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key may be in the long column name of keys, all other rows), columns as they were.

    All rows with such a key are among the first. A filter bounded by FILTER_WORDS is broadcast in place of the keys, which
    may be many; the fuller it is, the more other rows it admits. Null keys are in no set. rows are read twice.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * FILTER_WORDS))
    word, mask = F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, CAST(_bit % 64 AS INT)) AS _mask")
    words = keys.filter(F.col(name).isNotNull()).select(bit(F.col(name)).alias("_bit")).select(word, mask).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    told = rows.select(*rows.columns, F.when(key.isNotNull(), bit(key)).alias("_bit")).select(*rows.columns, word, mask)
    told = told.join(F.broadcast(words), "_word", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) != 0, F.lit(False)))
    return told.filter("_maybe").select(*rows.columns), told.filter("not _maybe").select(*rows.columns)
