"""Streams of submissions against a corpus, and windowed counts of events; both go beyond what the batch engine needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def four_word_windows(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    own = rows.withColumn("w", words).filter(F.size("w") >= 4)
    return own.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - 4))).withColumn("gram", F.concat_ws(" ", *(F.get("w", F.col("i") + k) for k in range(4))))


def stream_overlap(submissions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each arriving document's windows that occur in the static corpus, by corpus item: a stream-static join without state."""
    known = four_word_windows(corpus, "item_id").select(F.col("item_id"), "gram").distinct()
    return four_word_windows(submissions, "doc_id").join(known, "gram").select("doc_id", "item_id", "i", "gram")


def windowed_events(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of events by type and tumbling window; events later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("window"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )
