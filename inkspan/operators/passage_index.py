"""A stored index of a corpus' windows, for overlap without reading or shuffling the corpus again.

The windows are written once as a table bucketed and sorted by window, and a
bit field of them beside it. A document's window is looked up in the broadcast
bit field first, so of windows that the corpus lacks only a few leave their
document's task. The rest is shuffled into the index' buckets; the index is
read bucket by bucket and never shuffled. A window that very many documents
quote would land in one bucket with all of them: such windows are counted
first, and dealt out in parts, with the index' rows of it copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.sources.shared import HOT_KEY, checkpointed, in_parts

#: Buckets of an index; bits of the field a window, and of the whole field at most (2**22 rows of 64 bits, 64 MB broadcast).
BUCKETS, BITS_A_WINDOW, MOST_BITS = 32, 16, 1 << 28


def place(bits: int) -> tuple[Column, Column]:
    """Word of 64 bits and bit of a window in a field of so many bits."""
    at = f"pmod(xxhash64(gram, 5), {bits}L)"
    return F.expr(f"{at} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({at} % 64 as int))")


class PassageIndex:
    """An index by the name of its table; `bits` is the size of its field."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def build(self, windows: DataFrame, path: str, buckets: int = BUCKETS) -> PassageIndex:
        """Write `windows` (src, j, gram, eligible) under `path`, replacing what is there."""
        rows = windows.select("gram", "src", "j", "eligible")
        rows.write.mode("overwrite").option("path", f"{path}/windows").bucketBy(buckets, "gram").sortBy("gram").saveAsTable(f"{self.name}_windows")
        stored = self.spark.table(f"{self.name}_windows")
        count, bits = stored.count(), 1 << 12
        while bits < min(MOST_BITS, BITS_A_WINDOW * count):
            bits *= 2
        word, bit = place(bits)
        field = stored.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("field"))
        field.withColumn("bits", F.lit(bits).cast("long")).write.mode("overwrite").option("path", f"{path}/field").saveAsTable(f"{self.name}_field")
        return self

    def exists(self) -> bool:
        return all(self.spark.catalog.tableExists(f"{self.name}_{part}") for part in ("windows", "field"))

    def windows(self) -> DataFrame:
        return self.spark.table(f"{self.name}_windows")

    def likely(self, windows: DataFrame) -> DataFrame:
        """The rows of `windows` whose gram may be in the index: all that are, and by chance a few others; all, if the field is too full to tell."""
        field = self.spark.table(f"{self.name}_field")
        first = field.agg(F.max("bits").alias("bits"), F.sum(F.bit_count("field")).alias("set")).first()
        if not first.bits:
            return windows.limit(0)
        if 2 * first.set > first.bits:
            return windows
        word, bit = place(first.bits)
        return windows.withColumn("__bit", bit).withColumn("__word", word).join(F.broadcast(field.select(F.col("word").alias("__word"), "field")), "__word").filter(F.col("field").bitwiseAND(F.col("__bit")) != 0).drop("__bit", "__word", "field")

    def hits(self, windows: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
        """Equal windows of `windows` (doc_id, i, gram) and the index: doc_id, src, i, j, eligible."""
        near = checkpointed(self.likely(windows))
        counts = near.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > hot_key)
        hot = checkpointed(counts.select("gram", F.ceil(F.col("n") / hot_key).cast("int").alias("parts")))
        index, out = self.windows(), ["doc_id", "src", "i", "j", "eligible"]
        if not hot.head(1):
            return near.join(index.hint("merge"), "gram").select(*out)
        plain = near.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(index.hint("merge"), "gram").select(*out)
        dealt, copied = in_parts(near, hot, "gram", F.struct("doc_id", "i"), "dealt"), in_parts(index, hot, "gram", F.col("src"), "copied")
        return plain.unionByName(dealt.join(copied, ["gram", "part"]).select(*out))
