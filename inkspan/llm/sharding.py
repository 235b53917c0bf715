"""Longest-processing-time scheduling of groups that must stay together.

Groups (equal texts) are summed on the executors. The driver needs no group,
only how many there are of each size: groups of one size are alike, so the
schedule is a number of groups of each size for each shard. Sizes are taken
from the largest down and each group goes to the least loaded shard through a
heap; many groups of one size are given out at once, by the level up to which
they fill the loads, with the same result. Executors then number the groups of
a size and read off their shards.

Sizes that occur are few beside the groups: n different sizes take at least
n * n / 2 bytes of text, so a corpus of 100 TB has 14 million at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkspan.llm.common import checkpointed, table, text_or_empty
from inkspan.llm.skew import salted_join

#: Groups of one size, and rows of one shard, that one task numbers, about.
PART_ROWS = 100_000
#: Groups of one size from which they are given out at once.
MANY = 64
#: Up to so many sizes their schedule is broadcast (some MB); beyond, Spark joins by size.
BROADCAST_SIZES = 100_000


def at_once(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard gets from least-loaded-first, ties to the lower shard.

    Shard k takes a group at the loads loads[k], loads[k] + size, ...; the
    groups go to the `count` least of all these, in order of load and shard.
    """
    low, high = min(loads), min(loads) + size * (count + 1)

    def below(level: int) -> list[int]:
        return [max(0, -((load - level) // size)) for load in loads]

    while low < high:  # the highest level below which no more than `count` groups begin
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle - 1)
    taken = below(low)
    for k, load in enumerate(loads):
        if sum(taken) == count:
            break
        if load <= low and (low - load) % size == 0:
            taken[k] += 1
    return taken


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """For each (size, groups of it), how many of its groups each shard gets: largest first, to the least loaded, ties to the lower shard."""
    heap, placed = [(0, shard) for shard in range(shards)], {}
    for size, count in sorted(sizes, reverse=True):
        if count < MANY:
            taken = [0] * shards
            for _ in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                taken[shard] += 1
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            taken = at_once(loads, size, count)
            heap = [(load + size * n, shard) for shard, (load, n) in enumerate(zip(loads, taken, strict=True))]
            heapq.heapify(heap)
        placed[size] = taken
    return placed


def placed_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, size) of groups, each key once, to (key, shard), and rows, if groups have it."""
    spark = groups.sparkSession
    classes = [(r["size"], r["count"]) for r in groups.groupBy("size").count().toLocalIterator()]  # a row a size
    plan, counts = schedule(classes, shards), dict(classes)
    rows = []
    for size, taken in plan.items():
        ends, total = [], 0
        for n in taken:
            total += n
            ends.append(total)
        rows.append((size, -(-counts[size] // PART_ROWS), ends))
    plan = spark.createDataFrame(rows, "size long, parts long, ends array<long>")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SIZES else plan
    # Groups of a very common size are numbered in parts, each after the parts before it.
    dealt = groups.join(plan, "size").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")))
    several = dealt.filter("parts > 1").groupBy("size", "part").count()  # PART_ROWS groups a row
    before = W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = several.select("size", "part", F.sum("count").over(before).alias("start"))
    within = W.partitionBy("size", "part").orderBy("key")
    rank = F.coalesce("start", F.lit(0)) + F.row_number().over(within)
    more = [c for c in groups.columns if c == "rows"]
    numbered = dealt.join(F.broadcast(starts), ["size", "part"], "left").select("key", "ends", *more, rank.alias("rank"))
    return numbered.select("key", *more, F.size(F.filter("ends", lambda end: end < F.col("rank"))).alias("shard"))


def measured(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with size, text_crc32 and __key, by which equal texts are told."""
    text = text_or_empty()
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary")), "__key": F.xxhash64(text)})


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows of `docs` with size, text_crc32, shard and slot (gapless from 0 in each shard).

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty and
    shares the group of empty texts. Groups of one size take their shards in
    order of a hash of the text, so equal input gives equal shards in any
    order. Rows repeated in the input stay repeated. An empty table gives no
    rows. Texts of any length are only hashed and measured. Columns of the
    input with the names of the new ones are replaced.
    """
    return sharded(measured(docs), shards)


def sharded(rows: DataFrame, shards: int = 16) -> DataFrame:
    """The same of rows that are `measured`."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    groups = checkpointed(rows.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    total, most = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    placed = checkpointed(placed_groups(groups, shards).withColumnsRenamed({"key": "__key", "rows": "__rows"}))
    return numbered(salted_join(rows, placed, "__key", "__rows", "doc_id", total, most).drop("__key", "__rows"), max(1, -(-total // (shards * PART_ROWS))))


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """Add slot: each shard's rows numbered in so many parts, each part after the parts before it."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    before = W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "__part")
        .count()
        .select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    )  # a row for PART_ROWS rows
    within = W.partitionBy("shard", "__part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("__at", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "__part"])
        .withColumn("slot", (F.col("__start") + F.col("__at") - 1).cast("long"))
        .drop("__part", "__start", "__at")
    )


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    out = sharded(checkpointed(rows))  # sizes, checksums and keys are read off the texts once
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
