"""Pairs of similar word sets, found through their rare words.

Two sets of Dice similarity t or more share so many words that the rarest few
of each, its prefix, have one in common. So sets meet on prefix words only,
within lengths that can reach t; a pair counts at the first word that its
prefixes share, and is checked on the full sets. Equal sets are compared once.
Words that are frequent are seldom in a prefix; one that still is in very many
is dealt out in parts.

Where one side has few sets, as a corpus has, its words and prefixes are sent
to all tasks, and the other side, however large, stays where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions.numbers import scaled
from inkspan.sources.shared import HOT_KEY, checkpointed, in_parts

#: Prefix words of the right side up to which it is sent to all tasks: some tens of megabytes.
FEW = 200_000


def dice_pairs(left: DataFrame, right: DataFrame, percent: int, hot_key: int = HOT_KEY) -> DataFrame:
    """(left_words, right_words, shared): every pair of distinct sets `words` (arrays of distinct strings) with 200 * shared >= percent * (sizes added up).

    percent is above 0; empty sets are similar to none.
    """
    sides = {name: rows.filter(F.size("words") > 0).select(F.array_sort("words").alias("words")).distinct() for name, rows in (("left", left), ("right", right))}
    every = sides["left"].unionByName(sides["right"])
    often = every.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

    def prefixes(name: str) -> DataFrame:
        """word, its place from rare to frequent words, the words in that order and their number."""
        ranked = sides[name].select("words", F.explode("words").alias("word")).join(often, "word").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).getField("word").alias("ordered"))
        size = F.size("ordered")
        # A partner has at least percent / (200 - percent) times as many words, which bounds from below what they share.
        least = F.ceil(F.lit(percent) * size / F.lit(200 - percent))
        return ranked.select("ordered", size.alias("size"), F.posexplode(F.slice("ordered", F.lit(1), (size - least + 1).cast("int"))).alias("at", "word"))

    a, b = checkpointed(prefixes("left")), checkpointed(prefixes("right"))
    counts = a.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > hot_key)
    hot = counts.select("word", F.ceil(F.col("n") / hot_key).cast("int").alias("parts"))
    named = lambda rows, mark: rows.select("word", *(F.col(c).alias(f"{mark}_{c}") for c in ("ordered", "size", "at")), *(["part"] if "part" in rows.columns else []))
    if counts.head(1):
        hot = checkpointed(hot)
        cold = lambda rows: rows.join(F.broadcast(hot.select("word")), "word", "left_anti")
        met = named(cold(a), "a").join(named(cold(b), "b"), "word").select("a_ordered", "a_size", "a_at", "b_ordered", "b_size", "b_at")
        dealt = named(in_parts(a, hot, "word", F.col("ordered"), "dealt"), "a").join(named(in_parts(b, hot, "word", F.col("ordered"), "copied"), "b"), ["word", "part"])
        met = met.unionByName(dealt.select(*met.columns))
    else:
        met = named(a, "a").join(named(b, "b"), "word")
    sizes = F.col("a_size") + F.col("b_size")
    # All earlier words of one prefix are missing in what the other has up to here: the first common word.
    first = ~F.arrays_overlap(F.slice("a_ordered", F.lit(1), F.col("a_at")), F.slice("b_ordered", F.lit(1), F.col("b_at")))
    met = met.filter((200 * F.least("a_size", "b_size") >= percent * sizes) & first)
    shared = F.size(F.array_intersect("a_ordered", "b_ordered"))
    return met.select(F.array_sort("a_ordered").alias("left_words"), F.array_sort("b_ordered").alias("right_words"), shared.alias("shared"), sizes.alias("sizes")).filter(200 * F.col("shared") >= percent * F.col("sizes"))


def similar_sets(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], percent: int) -> DataFrame:
    """Keys of both sides, shared and dice (percent, one digit) of every pair of rows with similar `words`, distinct or equal; no key is in both lists."""
    a, b = left.withColumn("left_words", F.array_sort("words")), right.withColumn("right_words", F.array_sort("words"))
    few = prefixed(right, percent)
    if few.count() <= FEW:
        rows = met_in_place(left, few, left_keys, percent)
    else:
        rows = dice_pairs(left, right, percent).join(a.select("left_words", *left_keys), "left_words")
    rows = rows.join(b.select("right_words", *right_keys), "right_words")
    return rows.select(*left_keys, *right_keys, F.col("shared").cast("long").alias("shared"), scaled(200 * F.col("shared") / F.col("sizes"), 1).alias("dice"))


def prefixed(sets: DataFrame, percent: int) -> DataFrame:
    """word, at, ordered, size of the prefixes of all distinct sets, whose words are ordered by their number of sets; stored."""
    kept = checkpointed(sets.filter(F.size("words") > 0).select(F.array_sort("words").alias("words")).distinct().select("words", F.monotonically_increasing_id().alias("n")))
    each = kept.select("n", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    ordered = each.join(often, "word").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("o"))
    size = F.size("o")
    head = F.slice("o", F.lit(1), (size - F.ceil(F.lit(percent) * size / F.lit(200 - percent)) + 1).cast("int"))
    return checkpointed(ordered.select("n", F.col("o.word").alias("ordered"), "o", size.alias("size"), F.posexplode(head).alias("at", "x")).select("x.word", "x.often", "at", "n", "ordered", "o", "size"))


def met_in_place(left: DataFrame, few: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """keys, right_words, shared and sizes of the rows of `left` that are similar to sets of `few` (see `prefixed`), which all tasks get; `left` isn't shuffled.

    Words that no set of `few` has are the rarest. A row is told its prefix in
    its task, and meets the sets whose prefixes have one of those words.
    """
    known = few.select("n", "o").distinct().select(F.explode("o").alias("x")).select("x.*").distinct().orderBy("often", "word")
    vocabulary = pa.array([r.word for r in known.collect()], pa.string())
    heads = pa.array([r.word for r in few.select("word").distinct().collect()], pa.string())
    shown = np.asarray(pc.is_in(vocabulary, value_set=heads)) if len(vocabulary) else np.zeros(0, bool)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(batch.num_columns - 1)
            size = np.asarray(pc.list_value_length(words)).astype(np.int64)
            row, rank = np.repeat(np.arange(len(size)), size), np.asarray(pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1))
            order = np.lexsort((rank, row))
            row, rank = row[order], rank[order]
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            keep = (place < (size - -(-percent * size // (200 - percent)) + 1)[row]) & (rank >= 0)
            keep[keep] = shown[rank[keep]]
            row, rank = row[keep], rank[keep]
            there, count = np.unique(row, return_counts=True)
            head = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), vocabulary.take(pa.array(rank)))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(there)).columns, head], names=[*batch.schema.names, "head"])

    rows = left.filter(F.size("words") > 0).select(*keys, "words")
    schema = T.StructType([*rows.schema.fields, T.StructField("head", T.ArrayType(T.StringType()))])
    rows = rows.mapInArrow(cut, schema).withColumn("word", F.explode("head")).drop("head")
    met = rows.join(F.broadcast(few.select("word", "at", "ordered", F.col("size").alias("b_size"))), "word")
    sizes = F.size("words") + F.col("b_size")
    first = ~F.arrays_overlap(F.slice("ordered", F.lit(1), F.col("at")), F.col("words"))
    met = met.filter((200 * F.least(F.size("words"), F.col("b_size")) >= percent * sizes) & first).withColumn("shared", F.size(F.array_intersect("words", "ordered")))
    return met.select(*keys, F.array_sort("ordered").alias("right_words"), "shared", sizes.alias("sizes")).filter(200 * F.col("shared") >= percent * F.col("sizes"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
