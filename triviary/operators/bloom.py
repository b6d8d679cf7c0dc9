"""Bloom filters as tables: a large side loses the rows whose keys can't be on the other side, before it is shuffled for a join.

A filter is a set of bits in chunks of 4 KB, one row each. Bits are gathered in words of 64, whose aggregates hold fixed-size values and so are hashed and not sorted: a task holds a
word once however many keys set its bits. A filter's size follows the number of keys up to `MOST` bits (16 MB, two million words), so a task that makes one has bounded memory
and it can always be sent to all executors; with more keys than that it lets more rows pass, never fewer: the join behind it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key, bits of a chunk, and the most bits of a filter.
PER_KEY, CHUNK, MOST = 12, 1 << 15, 1 << 27
#: Bits of a word, a bigint.
WORD = 64
#: Hashes per key; each is a lookup.
HASHES = 2


def _place(key: Column, i: int, bits: int) -> Column:
    """The bit of a key, from 0 on."""
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits))


def made(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(chunk, bits) of the keys, bits: the words of the chunk in order; and how many bits there are."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = min(MOST, (max(1, n) * PER_KEY // CHUNK + 1) * CHUNK)
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*(_place(F.col(key), i, bits) for i in range(HASHES)))).alias("at"))
    said = at.select(F.floor(F.col("at") / WORD).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % WORD).cast("int")).alias("bits"))
    none = keys.sparkSession.range(bits // WORD).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))  # so that a chunk has all of its words
    words = said.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunk = words.groupBy(F.floor(F.col("word") / (CHUNK // WORD)).alias("chunk"))
    return chunk.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits")), bits


def possible(rows: DataFrame, key: str, chunks: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be among the filter's; a null key isn't."""
    out = rows
    for i in range(HASHES):
        at = _place(F.col(key), i, bits)
        word = F.get("_bits", F.floor(at % CHUNK / WORD).cast("int"))
        here = F.broadcast(chunks.select(F.col("chunk").alias("_chunk"), F.col("bits").alias("_bits")))  # MOST bits at most
        out = out.join(here, F.col(key).isNotNull() & (F.floor(at / CHUNK) == F.col("_chunk"))).where(F.getbit(word, (at % WORD).cast("int")) == 1).drop("_chunk", "_bits")
    return out


def joinable(rows: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """The rows of a large table that a join with keys[other] may need."""
    return possible(rows, key, *made(keys, other))
