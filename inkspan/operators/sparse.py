"""Products of sparse term vectors, block against block.

Texts of two tables are dealt out once and meet as blocks, so a frequent word makes no rows of its own:
a task multiplies two sparse matrices and hands on only the pairs that count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of either side.
LEFT_BLOCK, RIGHT_BLOCK = 256, 512


def packed(rows: DataFrame, words: str, size: int) -> DataFrame:
    """(id, text) to blocks of at most `size` ids: ids, how many words each has, and the words, repeats included.

    Texts are dealt out once, by id, and cut into words (`words` says how, in
    SQL of a column `text`) where they then lie; a task's rows make its blocks.
    """
    own = rows.filter("id IS NOT NULL").groupBy("id").agg(F.collect_list("text").alias("texts")).selectExpr("CAST(id AS BIGINT) AS id", f"flatten(transform(texts, text -> {words})) AS words")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                values = part.column(0), part.column(1).value_lengths(), part.column(1).flatten()
                columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "words"])

    return own.mapInArrow(blocks, "ids array<long>, sizes array<int>, words array<string>")


def products(left: DataFrame, right: DataFrame, words: str, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(left_id, right_id, dot, left_square, right_square) of the pairs that `keep` says.

    Both tables are (id, text); rows of one id are one text, null ids none.
    `weigh` gets words and how often an id has each, and returns their numbers.
    `keep` gets the dot products of two blocks and the squared lengths of their
    rows, and returns a matrix of booleans.
    """
    side = lambda rows, size, mark: packed(rows, words, size).select(*(F.col(c).alias(f"{mark}_{c}") for c in ("ids", "sizes", "words")))
    pairs = side(left, LEFT_BLOCK, "l").crossJoin(side(right, RIGHT_BLOCK, "r"))

    def counted(sizes: np.ndarray, codes: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word and number of each word that a row has."""
        key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(listed) + codes, return_counts=True)
        row, code = np.divmod(key, max(1, len(listed)))
        return row, code, weigh(listed[code], count)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = [batch.column(i).slice(row, 1).flatten() for i in range(6)]
                l_ids, l_sizes, l_words, r_ids, r_sizes, r_words = own
                coded = pa.concat_arrays([l_words, r_words]).dictionary_encode()
                codes, listed = np.asarray(coded.indices).astype(np.int64), np.asarray(coded.dictionary.to_pylist(), dtype=object)
                l_row, l_code, l_n = counted(np.asarray(l_sizes), codes[: len(l_words)], listed)
                r_row, r_code, r_n = counted(np.asarray(r_sizes), codes[len(l_words) :], listed)
                order = np.argsort(r_code, kind="stable")
                r_code, r_at, r_w = r_code[order], r_row[order], r_n[order]
                low, high = np.searchsorted(r_code, l_code, "left"), np.searchsorted(r_code, l_code, "right")
                span = high - low
                at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
                cell = np.repeat(l_row, span) * len(r_ids) + r_at[at]
                dot = np.bincount(cell, np.repeat(l_n, span) * r_w[at], len(l_ids) * len(r_ids)).reshape(len(l_ids), len(r_ids))
                l_square, r_square = np.bincount(l_row, l_n * l_n, len(l_ids)), np.bincount(r_row, r_n * r_n, len(r_ids))
                i, j = np.nonzero(keep(dot, l_square, r_square) & (dot > 0))
                columns = [np.asarray(l_ids)[i], np.asarray(r_ids)[j], dot[i, j], l_square[i], r_square[j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["left_id", "right_id", "dot", "left_square", "right_square"])

    return pairs.mapInArrow(multiply, "left_id long, right_id long, dot double, left_square double, right_square double")
