"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

1. A bit of a document's fingerprint is 1 if over half of its shingles' hashes
   have it. Documents of one fingerprint are one class; only classes go on.
2. Classes are dealt out by bits: two fingerprints that differ in at most d
   bits agree on one of d + 1 bands of any set of bits. Classes that share a
   band's value are a group. A group of over GROUP classes is split by the
   bands of its other bits in the same way, and so on: a group with r bits
   left has at most 2**r classes, so groups are bounded whatever the data.
3. In each group classes are sorted by Gray rank, in which neighbours share
   most bits. Nodes of FAN neighbours keep the bits that all below them have
   in common, as an AND and an OR, nodes of FAN nodes likewise up to a root.
   The join goes down from the root: two nodes are taken apart only if the
   bits on which they surely differ are at most d; the rest is pruned as a
   whole. Leaves are compared in full.
4. Links become stars inside each task; large-star and small-star rounds join
   them to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import checkpointed, table, text_or_empty, utf8
from inkspan.llm.components import components
from inkspan.llm.skew import salted_join

U = np.uint64
BITS, SEED = 64, 42
#: Classes of a group that are compared in one task, children of a node, pairs of nodes looked at at once, and classes a bucket holds about.
GROUP, FAN, PAIRS, BUCKET = 1 << 13, 8, 1 << 18, 1 << 16
#: Shingles that are hashed at once.
SHINGLES = 1 << 16


def majority(text: bytes, k: int) -> int:
    """The fingerprint of one text: bits that more than half of its shingles' hashes have; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII spaces alone
    count = max(1, len(words) - k + 1) if words else 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, SHINGLES):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(at, min(at + SHINGLES, count))]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, bits) of each row of `docs`: the SimHash of its word shingles as a signed long; null texts are empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            found = np.array([majority(data[a:b].tobytes(), k) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(hashed, "doc_id long, bits long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number among the binary reflected Gray codes."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(shift))
    return x


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the number of a row of the same component) after links a-b: every component under its least."""
    while len(a):
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(labels, high, low)
        while True:
            above = labels[labels]
            if (above == labels).all():
                break
            labels = above
    return labels


class GrayIndex:
    """Distinct fingerprints, sorted by `group` (an integer each) and Gray rank, under nodes of common bits."""

    def __init__(self, bits: np.ndarray, group: np.ndarray) -> None:
        order = np.lexsort((gray_rank(bits), group))
        self.bits, self.order = bits[order], order
        group = group[order]
        self.levels = [(self.bits, self.bits, group, group)]
        while len(self.levels[-1][0]) > FAN:
            all_, any_, low, high = self.levels[-1]
            cuts = np.arange(0, len(all_), FAN)
            self.levels.append((np.bitwise_and.reduceat(all_, cuts), np.bitwise_or.reduceat(any_, cuts), low[cuts], np.maximum.reduceat(high, cuts)))

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the same group that differ in at most `most` bits, each pair once, as numbers in sorted order."""
        top = len(self.levels) - 1
        size = len(self.levels[top][0])
        stack = [(top, *np.triu_indices(size))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > PAIRS:
                stack += [(level, i[at : at + PAIRS], j[at : at + PAIRS]) for at in range(0, len(i), PAIRS)]
                continue
            all_, any_, low, high = self.levels[level]
            differ = (all_[i] & ~any_[j]) | (all_[j] & ~any_[i])
            kept = (np.bitwise_count(differ) <= most) & (low[i] <= high[j]) & (low[j] <= high[i])
            i, j = i[kept], j[kept]
            if not level:
                yield i[i < j], j[i < j]
                continue
            if len(i):
                below, step = len(self.levels[level - 1][0]), np.arange(FAN)
                a = np.broadcast_to(i[:, None, None] * FAN + step[:, None], (len(i), FAN, FAN)).ravel()
                b = np.broadcast_to(j[:, None, None] * FAN + step, (len(i), FAN, FAN)).ravel()
                real = (a <= b) & (b < below)
                stack.append((level - 1, a[real], b[real]))


def stars(group: pa.Table, most: int) -> pa.Table:
    """Links inside groups (mask, bits & mask) as stars: fingerprints and the least of their component here."""
    bits, mask = (np.asarray(group.column(c).combine_chunks()).view(U) for c in ("bits", "mask"))
    found_u, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(mask):
        own = np.unique(bits[mask == m])
        _, place = np.unique(own & m, return_inverse=True)
        index = GrayIndex(own, place)
        labels = np.arange(len(own))
        for a, b in index.links(most):
            labels = merged(labels, a, b)
        linked = np.flatnonzero(labels != np.arange(len(own)))
        found_u.append(index.bits[linked].view(np.int64))
        found_v.append(index.bits[labels[linked]].view(np.int64))
    return pa.table({"u": np.concatenate(found_u), "v": np.concatenate(found_v)})


def bands(mask: int, count: int) -> list[int]:
    """`mask` with each of `count` bands of the bits outside it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def groups(classes: DataFrame, most: int, limit: int) -> list[DataFrame]:
    """(mask, bits) of every fingerprint that isn't alone in its group, that of equal bits & mask.

    Two that differ in at most `most` bits share a group. None is over `limit`,
    unless so few bits are left that it can't be over 2 to their number.
    """
    out, rows, masks = [], classes.select(F.lit(0).cast("long").alias("mask"), "bits"), [0]
    while True:
        further = {m: bands(m, most + 1) for m in masks}
        split = F.create_map(*(x for m, after in further.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(a)) for a in after)))))
        rows = rows.select(F.explode(split[F.col("mask")]).alias("mask"), "bits")
        rows = (rows.distinct() if out else rows).withColumn("group", F.struct("mask", F.col("bits").bitwiseAND(F.col("mask"))))
        # Two masks may have a further one in common.
        masks = sorted({a for after in further.values() for a in after})
        small = 1 << BITS - min(m.bit_count() for m in masks) <= limit
        sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
        rows = checkpointed(salted_join(rows, sizes, "group", "size", "bits", rows.count()).filter("size > 1").select("mask", "bits", "size"))
        done = F.lit(small) | (F.col("size") <= limit)
        out.append(rows.filter(done).select("mask", "bits"))
        rows = rows.filter(~done)
        if small or not rows.head(1):
            return out


def near_fingerprints(docs: DataFrame, k: int = 3, most: int = 2, limit: int = GROUP) -> DataFrame:
    """doc_id, bits (the SimHash as a signed long) and component_id for each row of `docs`.

    Words are runs of other characters than ASCII spaces, A-Z lower-cased; a
    text of fewer than k words is one shingle, and one without words, a null
    text too, has the fingerprint zero and is linked like any other. Documents
    whose fingerprints differ in at most `most` bits are linked; their
    component is the least doc_id that links lead to (null if all ids are
    null). Repeated rows stay, texts of any length are hashed whole, other
    columns are ignored, an empty table gives no rows.
    """
    seen = checkpointed(fingerprints(docs, k))
    classes = checkpointed(seen.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    found, count = None, classes.count()
    for rows in groups(classes, most, limit):
        bucket = F.pmod(F.xxhash64("mask", F.col("bits").bitwiseAND(F.col("mask"))), F.lit(max(8, (most + 1) * count // BUCKET))).alias("bucket")
        links = rows.groupBy(bucket).applyInArrow(lambda g: stars(g, most), "u long, v long")
        found = links if found is None else found.unionByName(links)
    joined = components(found).withColumnRenamed("node", "bits").join(classes.select("bits", "least"), "bits")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = salted_join(joined.select("root", "bits"), least, "root", "size", "bits", count).select("bits", "component_id", F.lit(True).alias("linked"))
    known = classes.join(named, "bits", "left").select("bits", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "size")
    return salted_join(seen, known, "bits", "size", "doc_id", seen.count()).select("doc_id", "bits", "component_id")


def op13_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near duplicates of all documents."""
    rows = near_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
