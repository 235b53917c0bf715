"""Tables of a folder, read for plans that work text by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows; documents that come in fewer pieces than there are cores are dealt out by id.

    Only an input of less than one file split a core is moved so. A larger one
    keeps its splits and isn't shuffled.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, "doc_id")
    return rows
