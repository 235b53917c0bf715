"""Running results over the items of one array, inside its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items whose results are merged one by one; above them stands one merged result a stretch.
STRETCH = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, wherever the body's own lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each item the merged items before it; `merge` is associative and `zero` its neutral value.

    A fold that appends to an array copies it with every item. Here each item
    merges at most STRETCH items and one result of all stretches before, so an
    array of n items takes n * STRETCH merges at most and no text leaves its row.
    """
    def stretch(v: Column, k: Column) -> Column:
        return F.aggregate(F.slice(v, k * STRETCH + 1, F.lit(STRETCH)), zero, merge)

    def heads(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), last), F.array(zero), lambda h, k: F.concat(h, F.array(merge(F.element_at(h, -1), stretch(v, k)))))

    def item(v: Column, h: Column, i: Column) -> Column:
        k = F.floor(i / STRETCH).cast("int")
        return merge(F.get(h, k), F.aggregate(F.slice(v, k * STRETCH + 1, i - k * STRETCH), zero, merge))

    return bound(values, lambda v: bound(heads(v), lambda h: F.transform(v, lambda _, i: item(v, h, i))))


def starts(lengths: Column) -> Column:
    """Where each of the pieces of these lengths begins."""
    return scanned(lengths, F.lit(0), lambda a, b: a + b)


def matches(text: Column, regex: Column) -> Column:
    """Starts and lengths, in code points, of all matches of a pattern in a text: behind the pieces and the matches before."""
    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
        spans = bound(lengths, lambda x: F.zip_with(starts(F.transform(x, lambda p: p["gap"] + p["own"])), x, lambda at, p: F.struct((at + p["gap"]).alias("start"), p["own"].alias("length"))))
        return F.slice(spans, F.lit(1), F.size(found))

    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))), 1, 0)
    return bound(F.regexp_extract_all(text, regex, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(F.split(text, regex, -1), found)))
