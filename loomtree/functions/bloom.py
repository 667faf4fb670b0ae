"""A Bloom filter as a table: built by aggregates, asked by an equi-join, both from public functions only.

A key is a well mixed 64-bit hash. Its lower 40 bits choose a 64-bit word and its upper 24 bits four bits of it. Words lie in rows of ``ROW`` of them, so the filter is split by hash: a small one
is broadcast, a large one meets the keys that ask by the hash of their row, and no task or driver ever needs the whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a row of the table: 8 KB.
ROW = 1024
#: Bits set aside for a key: some three in a hundred keys that are not in the filter pass it.
BITS_A_KEY = 12
#: A larger filter is not broadcast.
BROADCAST_BYTES = 32 << 20


def n_rows(keys: int) -> int:
    """Rows of a filter for so many keys."""
    return max(1, -(-keys * BITS_A_KEY // (64 * ROW)))


def _word(hashed: Column, rows: int) -> Column:
    return F.pmod(hashed.bitwiseAND((1 << 40) - 1), F.lit(rows * ROW))


def _mask(hashed: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(hashed, 40 + 6 * k).bitwiseAND(63).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def hits(hashed: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The places of an array of uint64 hashes that may be in the filter given as one array of its words."""
    word = words[(hashed & np.uint64((1 << 40) - 1)) % np.uint64(len(words))]
    found = np.arange(len(hashed))
    for k in range(4):  # each bit leaves fewer to be asked for the next
        bit = (hashed[found] >> np.uint64(40 + 6 * k)) & np.uint64(63)
        found = found[(word[found] >> bit) & np.uint64(1) != 0]
    return found


def bloom_array(table: DataFrame, rows: int) -> np.ndarray:
    """The words of a filter of a bounded number of rows, on the driver, for ``hits``."""
    out = np.zeros(rows * ROW, np.uint64)
    for row, words in table.collect():
        out[row * ROW : (row + 1) * ROW] = np.array(words, np.int64).view(np.uint64)
    return out


def bloom_table(keys: DataFrame, hashed: Column, rows: int) -> DataFrame:
    """(bloom_row, bloom_words): the filter of ``hashed`` (a BIGINT hash) over all rows of ``keys``; every word is there."""
    spark = keys.sparkSession
    every = spark.range(rows * ROW).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("m"))
    words = keys.select(_word(hashed, rows).alias("w"), _mask(hashed).alias("m")).unionByName(every).groupBy("w").agg(F.bit_or("m").alias("m"))
    listed = F.sort_array(F.collect_list(F.struct("w", "m")))
    return words.groupBy(F.floor(F.col("w") / ROW).alias("bloom_row")).agg(F.transform(listed, lambda x: x["m"]).alias("bloom_words"))


def with_maybe(df: DataFrame, bloom: DataFrame, hashed: Column, rows: int, name: str = "maybe") -> DataFrame:
    """``df`` with ``name``: false only where ``hashed`` is certainly not among the filter's keys, or is null."""
    asked = df.withColumn("bloom_at", F.coalesce(_word(hashed, rows), F.lit(0).cast("bigint"))).withColumn("bloom_mask", _mask(hashed))
    asked = asked.withColumn("bloom_row", F.floor(F.col("bloom_at") / ROW))
    small = rows * ROW * 8 <= BROADCAST_BYTES
    met = asked.join(F.broadcast(bloom) if small else bloom, "bloom_row")
    word = F.get("bloom_words", F.pmod("bloom_at", F.lit(ROW)).cast("int"))
    hit = F.coalesce(word.bitwiseAND(F.col("bloom_mask")) == F.col("bloom_mask"), F.lit(False))
    return met.withColumn(name, hit & hashed.isNotNull()).drop("bloom_row", "bloom_at", "bloom_mask", "bloom_words")
