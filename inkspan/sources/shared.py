"""The folder that the driver and all executors share: checkpoints and stored indexes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that stay together; keys of more are dealt out in parts.
HOT_KEY = 10_000


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a folder of this machine for a local master, as in tests, and else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def in_parts(rows: DataFrame, hot: DataFrame, key: str, spread: Column, side: str) -> DataFrame:
    """`rows` whose `key` is in `hot` (key, parts), with `part`: each in one part by a hash of `spread` (side "dealt"), or in every part (side "copied").

    `hot` has a key for each HOT_KEY rows of the larger table at most, so it is broadcast.
    """
    found = rows.join(F.broadcast(hot), key)
    if side == "dealt":
        return found.withColumn("part", F.pmod(F.xxhash64(spread), F.col("parts")).cast("int")).drop("parts")
    return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
