"""Ordered values dealt to ranges, natively: bounds at percentiles, and the number of a value's range by a search in two steps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most ranges: their bounds pass the driver.
MOST = 1 << 16


def whole(rows: DataFrame, column: str) -> Column:
    """A time or whole number as a bigint of the same order."""
    kind = rows.schema[column].dataType.simpleString()
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column).cast("bigint")


def bounds(rows: DataFrame, value: Column, size: int) -> list[int]:
    """Where ranges of about `size` rows begin."""
    n = min(MOST, rows.count() // size + 1)
    if n < 2:
        return []
    at = F.percentile_approx(value, [i / n for i in range(1, n)], F.lit(8 * n))
    return sorted(set(rows.agg(at).first()[0] or []))


def number(value: Column, cuts: list[int]) -> Column:
    """How many cuts are not above the value; 0 for null."""
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    below = lambda x: F.size(F.filter(x, lambda c: c <= value))
    part = below(F.from_json(F.lit(json.dumps([p[0] for p in parts[1:]])), "array<bigint>"))
    inside = below(F.element_at(F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>"), part + 1))
    return F.when(value.isNull(), 0).otherwise(part * step + inside)
