"""A bounded, hash-chosen sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """(doc_id, text, y) of about `rows` labelled documents at most for which `keep`, a condition on doc_id, holds.

    Labels that are null, or whose doc_id is, are left out; of several labels
    of one document the largest counts, of several texts under one doc_id the
    least by hash, so the rows are bounded however often an id is repeated.
    The ids, at most about `rows`, are broadcast, so only the sample's texts
    are shuffled.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    share = min(1.0, rows / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(own), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
