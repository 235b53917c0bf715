"""From raw documents to sharded training data: five operators, each on what its predecessor kept.

Every stage takes any table with doc_id, text and source. Columns beside them
pass through all stages but the last, whatever their names. A null or empty
text is scored by the classifier like any other, is near no other document, is
never contaminated, counts no words in the mix and one byte in its shard; very long texts are read whole. Ties and repeated rows have the same
result in each run: of rows equal in doc_id and text the near-duplicate stage
keeps one, and rows of one doc_id with unlike texts are documents of their own.
An empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import decontamination, mixing, neardup, quality, sharding
from inkspan.llm.common import aside, checkpointed, shared_folder, table, text_or_empty
from inkspan.llm.skew import likely_in


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled raw documents, doesn't reject.

    Without any label every score is 0.5 and all stay. Rows keep their columns,
    one named score among them, and repeated rows stay.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, own = aside(docs, "doc_id", "text")
    return quality.with_quality(rows, model).filter(F.col("score") >= quality.THRESHOLD).select(*own)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the row of the group's least id; of equal rows one.

    Wordless texts are near nothing and stay, as do rows of one group that
    share its least id but not their text.
    """
    rows, own = aside(docs, "doc_id", "text")
    rows = rows.withColumns(dict(zip(neardup.PLACE, neardup.place(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty())), strict=True)))
    found = checkpointed(neardup.near_duplicates(rows, k=5).select(*neardup.place(F.col("doc_id"), F.col("check")), "kept"))
    repeated = found.groupBy(*neardup.PLACE).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 or not kept")
    # Rows that go, or are repeated, are few: only they, and a few that a filter can't tell from them, are shuffled.
    keys = [F.col(c) for c in neardup.PLACE]
    rows = likely_in(rows, repeated, keys, keys, "__some")
    some = rows.filter("__some").join(repeated.filter("not kept"), neardup.PLACE, "left_anti").dropDuplicates(neardup.PLACE)
    return rows.filter("not __some").unionByName(some).select(*own)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Rows without words, and all rows if the benchmark has none, stay."""
    rows, own = aside(docs, "doc_id", "text")
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*own)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in doc_id and text equally often."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and slot. Copies share a shard and have slots of their own."""
    rows = sharding.measured(docs.select("doc_id", "source", "text")).drop("text")
    return sharding.sharded(rows).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier's trees and the hashed components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents; each stage's rows are written as Parquet and read again.

    A stage's folder is deleted when its successor has written its own.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
