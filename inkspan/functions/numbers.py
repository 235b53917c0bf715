"""Rounding to the nearest decimal of the number itself, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(x: Column, digits: int) -> Column:
    """A double rounded to a whole number of its multiple, as `Spark.round` of the dialects."""
    return F.round(x * float(10**digits)) / float(10**digits)


def rounded(x: str, digits: int) -> str:
    """SQL of a number of 0 or more rounded as its exact binary value lies, to 1 or 2 digits.

    `round` looks at the shortest decimal that stands for a number, so 2.05,
    which is a little less, goes up. The two differ only where the number is
    the nearest to a half: there n - 2 * 10**digits * x, taken in powers of
    two so that no step rounds, tells on which side it lies.
    """
    scale = 10**digits
    up = f"round(x, {digits})"
    k = f"(CAST(round({up} * {scale}) AS BIGINT) - 1)"
    half = f"((2 * {k} + 1) / {2 * scale}D)"
    left = f"CAST(2 * {k} + 1 AS DOUBLE)" + "".join(f" - {half} * {power}D" for power in {1: (16, 4), 2: (128, 64, 8)}[digits])
    body = f"CASE WHEN x <> {half} THEN {up} WHEN {left} > 0 THEN {k} / {scale}D WHEN {left} < 0 THEN {up} WHEN {k} % 2 = 0 THEN {k} / {scale}D ELSE {up} END"
    return f"get(transform(array(CAST({x} AS DOUBLE)), x -> {body}), 0)"
