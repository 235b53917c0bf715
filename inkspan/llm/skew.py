"""Joins that keep a hot key from landing in one task, and shuffles of few rows of a large table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that stay together at least, and keys of more rows than their share that are broadcast at most.
LEAST, MOST_KEYS = 500, 100_000
#: Bits of a filter of wanted keys for each key, and of one filter at most: 2**20 words of 64 bits, 16 MB broadcast.
BITS_A_KEY, MOST_BITS = 16, 1 << 26


def limit(total: int) -> int:
    """Rows of one key from which it is dealt out in parts: so few keys have more that they may be broadcast."""
    return max(LEAST, -(-total // MOST_KEYS))


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: str, total: int, largest: int | None = None) -> DataFrame:
    """`rows` joined by `key` with `keyed`, which has each key once and its number of rows, `count`.

    total: rows of `rows`; largest: most rows of one key, if known. Keys of over `limit(total)` rows, at most MOST_KEYS
    of them, are dealt by a hash of the column `spread` into as many parts as
    their rows need, and their row of `keyed` is copied to each part.
    """
    most = limit(total)
    if (total if largest is None else largest) <= most:
        return rows.join(keyed, key)
    parts = F.ceil(F.col(count) / most).cast("int")
    heavy = keyed.filter(F.col(count) > most).select(F.col(key).alias("__heavy"), parts.alias("__parts"))
    dealt = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    dealt = dealt.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0)).cast("int")).drop("__heavy", "__parts")
    copied = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > most, parts - 1).otherwise(0))))
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


def likely_in(rows: DataFrame, wanted: DataFrame, keys: list[Column], wanted_keys: list[Column], name: str) -> DataFrame:
    """`rows` with the boolean `name`: true for all whose keys are among those of `wanted`, and by chance for a few others.

    A bit field, filled by the executors and of bounded size, is broadcast. If
    `wanted` is so large that the field is full, all rows are true: then the
    exact join that follows shuffles them all, and nothing is lost.
    """
    bits = 1 << 12
    while bits < min(MOST_BITS, BITS_A_KEY * wanted.count()):
        bits *= 2
    place = lambda columns: F.pmod(F.xxhash64(F.lit(71), *columns), F.lit(bits).cast("long"))
    bit = F.expr("shiftleft(1L, cast(__at % 64 as int))")
    field = wanted.select(place(wanted_keys).alias("__at")).groupBy(F.expr("__at div 64").alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    found = rows.withColumn("__at", place(keys)).withColumn("__own", F.expr("__at div 64"))
    found = found.join(F.broadcast(field), F.col("__own") == F.col("__word"), "left")
    return found.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__at", "__own", "__word", "__bits")
