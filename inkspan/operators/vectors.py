"""Hashed vectors of texts and blockwise top-k search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from inkspan.functions.scans import bound

DIMENSIONS = 128
#: Queries that a task holds, and rows at most that it reads for them; tasks a core, of no fewer rows than LEAST_ROWS.
QUERY_BLOCK, ROW_BLOCK, LEAST_ROWS, TASKS = 32_768, 262_144, 4_096, 3
#: Queries and rows whose products are made at once, and pairs that are looked at once more.
QUERY_TILE, ROW_TILE, PAIRS = 1_024, 2_048, 16_384
#: Bytes of texts whose words are held at once; words of up to so many bytes have a table for their place behind another.
HELD, TABLED = 1 << 22, 64


def plain_text(text: Column) -> Column:
    """In lower case, with spaces for all signs that aren't of words."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")


def shifts() -> np.ndarray:
    """What n zero bytes make of each byte of a CRC32, by n (up to TABLED + 1), the byte's place and its value: CRC32 is linear in its bits."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((TABLED + 2, 4, 256), dtype=np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(TABLED + 1):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ table[out[n] & 255]
    return out


def term_sums(texts: pa.Array, dimensions: int, table: np.ndarray) -> np.ndarray:
    """Weights of a text's words and of its pairs of neighbours by dimension, a row a text. The CRC32 of a pair is made of its words'."""
    split = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
    words = split.flatten()
    there = np.asarray(pc.binary_length(words)) > 0
    row, coded = row[there], words.filter(pa.array(there)).dictionary_encode()
    code, known = np.asarray(coded.indices), coded.dictionary.cast(pa.binary()).to_pylist()
    own = np.array([zlib.crc32(w) for w in known], dtype=np.uint32)
    behind = np.array([zlib.crc32(b"_" + w) for w in known], dtype=np.uint32)
    length = np.array([len(w) + 1 for w in known], dtype=np.int64)
    first = np.flatnonzero(row[1:] == row[:-1])
    a, b = code[first], code[first + 1]
    before, n = own[a], np.minimum(length[b], TABLED + 1)
    pair = behind[b]
    for k in range(4):
        pair = pair ^ table[n, k, (before >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(length[b] > TABLED + 1):
        pair[i] = zlib.crc32(b"_" + known[b[i]], int(before[i]))
    out = np.zeros(len(texts) * dimensions)
    for h, at, weight in ((own[code], row, 1.0), (pair, row[first], 1.5)):
        out += np.bincount(at * dimensions + h % dimensions, np.where(h % 2 == 0, weight, -weight), len(out))
    return out.reshape(-1, dimensions)


def numbers(column: pa.Array, count: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(count, -1)


def listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def as_before(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first is the one before it."""
    if pa.types.is_struct(keys.type):
        return np.logical_and.reduce([as_before(x) for x in keys.flatten()])
    a, b = keys[:-1], keys[1:]
    return np.asarray(pc.fill_null(pc.equal(a, b), False)) | (np.asarray(pc.is_null(a)) & np.asarray(pc.is_null(b)))


def hashed_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector): words of weight 1 and pairs of neighbours of weight 1.5 by CRC32, odd hashes negative, to unit length.

    Terms are counted in their text's own row; only a row's sums are shuffled,
    to meet those of other texts of its key. A text without words has the zero
    vector.
    """
    names = [key, "sums"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shifts()
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64))
            start = 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, "right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), listed(term_sums(part.column(1), dimensions, table))], names=names)
                start = stop

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in (b for b in batches if len(b)):
            keys, sums = batch.column(0), numbers(batch.column(1), len(batch))
            if last is not None:
                keys, sums = pa.concat_arrays([last[0], keys]), np.concatenate([last[1], sums])
            starts = np.flatnonzero(np.append(True, ~as_before(keys)))
            keys, sums = keys.take(pa.array(starts)), np.add.reduceat(sums, starts)
            last = keys[-1:], sums[-1:]
            yield pa.RecordBatch.from_arrays([keys[:-1], listed(sums[:-1])], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([last[0], listed(last[1])], names=names)

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    sums = docs.select(key, plain_text(F.col(text)).alias("text")).mapInArrow(summed, schema)
    sums = sums.repartition(key).sortWithinPartitions(key).mapInArrow(merged, schema)
    norm = F.sqrt(F.aggregate("sums", F.lit(0.0), lambda s, x: s + x * x))
    return sums.select(key, bound(norm, lambda norm: F.transform("sums", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).alias("vector"))


class Nearest:
    """The k rows most similar to each of some queries by cosine in percent, ties to the smaller id, of all rows added so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.queries, self.vectors, self.light = k, ids, unit(vectors), unit(vectors).astype(np.float32)
        self.ids, self.similarity = np.zeros((len(ids), k), dtype=np.int64), np.full((len(ids), k), -1.0)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        kept = self.apart(ids, vectors)
        ids, vectors = ids[kept], unit(vectors[kept])
        light = vectors.astype(np.float32)
        for low in range(0, len(ids), ROW_TILE):
            rows = slice(low, low + ROW_TILE)
            least = np.argpartition(ids[rows], self.k)[: self.k + 1] if len(ids[rows]) > self.k else np.arange(len(ids[rows]))
            for first in range(0, len(self.queries), QUERY_TILE):
                likely = self.likely(slice(first, first + QUERY_TILE), light[rows], least)
                # Few queries at once where many pairs are left, as in near copies.
                step = len(likely) if np.count_nonzero(likely) <= PAIRS else max(1, PAIRS // likely.shape[1])
                for i in range(0, len(likely), step):
                    q, r = np.nonzero(likely[i : i + step])
                    self.meet(q + first + i, ids[rows], vectors[rows], r)

    def apart(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Places of the rows without those of which k + 1 equal ones have smaller ids."""
        copies: dict[bytes, int] = {}
        kept = []
        for i in np.argsort(ids, kind="stable").tolist():
            same = vectors[i].tobytes()
            copies[same] = copies.get(same, 0) + 1
            if copies[same] <= self.k + 1:
                kept.append(i)
        return np.array(kept, dtype=np.int64)

    def likely(self, part: slice, light: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Pairs of some queries and rows that may be among the k best: by products of half the digits, less all that these and rounding may be wrong by."""
        products = self.light[part] @ light.T
        wrong = 100 * (light.shape[1] + 16) * 2.0**-24
        worst = self.similarity[part, -1].copy()  # -1 where fewer than k are known
        new = worst < 0
        if new.any() and len(light) > self.k:
            worst[new] = 100.0 * np.partition(products[new], -self.k - 1, axis=1)[:, -self.k - 1] - wrong - 0.005
        none = worst < 0.01  # rows of no similarity may be among the best: those of the smallest ids
        out = products >= (np.where(none, 0.005 - wrong, worst - 0.005 - wrong) / 100).astype(np.float32)[:, None] - np.float32(1e-7)
        out[np.ix_(np.flatnonzero(none), least)] = True
        return out

    def meet(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, r: np.ndarray) -> None:
        """Keep the best of these pairs and those known."""
        other = self.queries[q] != ids[r]
        q, r = q[other], r[other]
        if not len(q):
            return
        products = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[i : i + PAIRS]], vectors[r[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)])
        touched = np.unique(q)
        held = self.similarity[touched] >= 0
        q = np.concatenate([q, np.repeat(touched, held.sum(axis=1))])
        found = np.concatenate([ids[r], self.ids[touched][held]])
        similarity = np.concatenate([np.round(np.clip(100 * products, 0, 100), 2), self.similarity[touched][held]])
        order = np.lexsort((found, -similarity, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.ids[q[best], place[best]], self.similarity[q[best], place[best]] = found[order[best]], similarity[order[best]]

    def rows(self) -> pa.RecordBatch:
        there = self.similarity >= 0
        owner = np.repeat(self.queries, there.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(self.ids[there]), pa.array(self.similarity[there])], names=["query_id", "id", "similarity"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, counts: tuple[int, int] | None = None) -> DataFrame:
    """query_id, id, similarity and place of the k rows most similar to each query by cosine in percent; ties to the smaller id.

    Every query meets every row: a task holds a block of queries, reads its part
    of the rows behind them and keeps k rows a query, so its memory is bounded
    and little is shuffled afterwards. counts: about how many queries and rows
    there are, where that is known; else both are counted.
    """
    asked, there = counts or (queries.count(), rows.count())
    groups = max(1, -(-asked // QUERY_BLOCK))
    parts = max(1, min(-(-TASKS * rows.sparkSession.sparkContext.defaultParallelism // groups), -(-there // LEAST_ROWS)), -(-there // ROW_BLOCK))

    def dealt(vectors: DataFrame, side: int, own: int, copies: int) -> DataFrame:
        named = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias("own"))
        copied = named.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        group, part = ("copy", "own") if side else ("own", "copy")
        return copied.select((F.col(group) * parts + F.col(part)).alias("cell"), F.lit(side).alias("side"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, nearest = -1, [], None
        for batch in (b for b in batches if len(b)):
            cells, sides, ids = (np.asarray(batch.column(i)) for i in range(3))
            vectors = numbers(batch.column(3), len(batch))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if cells[i] != cell:
                    if nearest is not None:
                        yield nearest.rows()
                    cell, held, nearest = cells[i], [], None
                if not sides[i]:
                    held.append((ids[i:j].copy(), vectors[i:j].copy()))
                    continue
                if held:
                    nearest, held = Nearest(*(np.concatenate(x) for x in zip(*held, strict=True)), k), []
                if nearest is not None:
                    nearest.add(ids[i:j], vectors[i:j])
        if nearest is not None:
            yield nearest.rows()

    cells = dealt(queries, 0, groups, parts).unionByName(dealt(rows, 1, parts, groups)).repartitionById(groups * parts, F.col("cell")).sortWithinPartitions("cell", "side")
    found = cells.mapInArrow(search, "query_id long, id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
