"""Results as files: JSON lines and HTML reports with highlighted passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def united(spans: Column) -> Column:
    """Sorted (start, end) spans with overlapping and touching ones made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(spans), empty, step)


def highlighted(text: Column, spans: Column) -> Column:
    """Escaped text with <mark> around the united spans."""
    whole = united(spans)
    zero = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        plain = escaped(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        marked = escaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.struct(F.concat(acc["html"], plain, F.lit("<mark>"), marked, F.lit("</mark>")).alias("html"), s["end"].alias("at"))

    return F.aggregate(whole, zero, step, lambda acc: F.concat(acc["html"], escaped(F.substring(text, acc["at"] + 1, F.length(text)))))


def html_reports(rows: DataFrame, title: str = "Overlap report") -> DataFrame:
    """doc_id and html of rows with doc_id, text, spans and overall_similarity."""
    head = F.lit(f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>")
    html = F.concat(head, F.format_string("Document %s: %.2f %%", F.col("doc_id").cast("string"), "overall_similarity"), F.lit("</h1><p>"), highlighted(F.col("text"), F.col("spans")), F.lit("</p>"))
    return rows.select("doc_id", html.alias("html"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
