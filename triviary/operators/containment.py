"""Which keys hold which: an index of anchors instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No anchor is longer; what lies behind it is compared where anchors agree.
WIDEST = 64


def _width(key: str):
    """The greatest power of two that isn't above the key's length."""
    return F.least(F.lit(WIDEST), F.expr(f"shiftleft(1, cast(floor(log2(length({key}))) as int))"))


def holds(outer: DataFrame, inner: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """(by, outer, inner): the pairs of different keys of one group `by` where a key of `outer` holds a key of `inner`.

    A key is known by its anchor, its first 1, 2, 4 ... characters, as many as fit. Whoever holds the key has the anchor at some place, so every key gives its pieces of these
    lengths (seven for each of its characters at most) and pieces meet anchors in an equi-join; the rest of the key is compared there. Rows grow with the characters of all keys and with the pairs
    whose anchors agree, not with the product. A pair comes once, as a key has one anchor and pieces are distinct. Keys that are null or empty are in no pair; repeated keys count once.
    The join is a merge of sorted shares of both sides: pieces are far more than the size of the keys' files lets Spark expect, so it would send all of them to every executor.
    """
    o = outer.select(*by, F.col(key).alias("outer")).where("outer <> ''").distinct().withColumn("_most", _width("outer"))
    i = inner.select(*by, F.col(key).alias("inner")).where("inner <> ''").distinct().withColumn("_w", _width("inner"))
    i = i.withColumn("_piece", F.expr("substring(inner, 1, _w)"))
    widths = F.expr("transform(sequence(0, cast(log2(_most) as int)), e -> shiftleft(1, e))")
    pieces = o.select(*by, "outer", F.explode(widths).alias("_w")).select(*by, "outer", "_w", F.explode(F.expr("array_distinct(transform(sequence(1, length(outer) - _w + 1), p -> substring(outer, p, _w)))")).alias("_piece"))
    same = F.lit(True)
    for c in [*by, "_w", "_piece"]:
        same = same & pieces[c].eqNullSafe(i[c])
    j = pieces.hint("merge").join(i, same & (F.col("outer") != F.col("inner")) & F.contains("outer", F.col("inner")))
    return j.select(*[pieces[c] for c in by], "outer", "inner")
