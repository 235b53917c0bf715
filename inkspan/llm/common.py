"""Shared helpers: reading inputs, checkpoints, Arrow text buffers and column hygiene."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that numpy code expands at once: arrays of eight bytes a character stay small. Code whose steps are
#: long vectors of few numbers a text takes more.
CHUNK_BYTES, LARGE_CHUNK_BYTES = 1 << 18, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that setting is unset a folder of this machine serves a local master,
    as in tests; on a cluster executors would not see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function for executors that returns a broadcast copy of `value`.

    Broadcasts name classes by module; the bytes broadcast here hold the
    classes themselves, so executors need no copy of this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of `df` with the columns of a DDL string behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def aside(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """`df` with all columns but those `used` under names that no operator has, and what selects its columns again."""
    quoted = {c: F.col(f"`{c.replace('`', '``')}`") for c in df.columns}
    renamed = {c: c if c.lower() in used else f"__own_{i}" for i, c in enumerate(df.columns)}
    return df.select(*(quoted[c].alias(new) for c, new in renamed.items())), [F.col(new).alias(c) for c, new in renamed.items()]


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id falls in fold 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column, nulls as empty texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
