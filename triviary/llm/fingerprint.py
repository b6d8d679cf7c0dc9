"""Document fingerprints: a canonical exact digest, in DataFrame functions alone.

The canonical text is the compatibility caseless form of Unicode (NFD, case folding, NFKD, case folding, NFKC), with every run of white space as one space and
none at the ends. ICU, which Spark brings along for its collations, is called by `reflect`. Two texts are alike if their canonical texts are equal, byte by byte.

1. `wide`: 128 bits of xxhash of the canonical text name its bucket; hashes alone are counted, with partial aggregation, so a group of copies of any size costs
   a few rows per task.
2. Inside a bucket that several texts fall into, their canonical bytes are compared: equal ones collapse to one per task before they move, so a hot group is no
   hot task. Buckets with one row need no comparison and their texts stay where they are.
3. A bucket of different texts (a collision) numbers these in byte order, and the number is added to the fingerprint. So equal fingerprints always mean equal canonical texts.

`edited_and_next` brings every document together with its follower in descending order of keys. Documents are dealt to ranges of keys, cut at percentiles, of a few MB each;
the first row of each range is also put behind the last row of the range before it, so that the follower is a plain window function within a range: texts move
once, and no range or task holds more than its share however many documents there are.

Nulls: a null text is empty; null keys come last; rows of one key follow each other in the byte order of their texts; repeated rows follow each other. A single document follows
itself. An empty table gives no rows. Keys are integers. Only key and text are read, so other columns can have any name; the key mustn't be named like a result (ValueError).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, remove, swept, written

#: Bytes of text in a range of keys, and the most ranges: their bounds pass the driver.
RANGE, RANGES = 8 << 20, 1 << 16
#: Rows of the wanted texts up to which these (24 bytes each) are sent to all executors; beyond it they are joined by a shuffle.
SMALL = 1 << 20
RESULTS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def icu(kind: str, method: str, x: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), x, F.lit(True))


def canonical(text: Column) -> Column:
    """The form in which texts are compared: the same for texts that differ in Unicode composition, compatibility forms, case and white space alone."""
    folded = icu("lang.UCharacter", "foldCase", F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(False)))
    again = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "decompose", folded)))
    return F.trim(F.regexp_replace(again, r"(?U)\s+", " "))


def wide(canon: Column, bits: int = 128) -> Column:
    """The bucket of a canonical text: 128 bits of xxhash; fewer `bits` (up to 64) make texts collide, for tests."""
    first = F.xxhash64(canon)
    if bits < 128:
        return F.struct(F.shiftrightunsigned(first, 64 - bits).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(first.alias("a"), F.xxhash64(F.lit("wide"), canon).alias("b"))


def shown(h: Column) -> Column:
    """A bucket as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(h[c])), 16, "0") for c in "ab"))


def ranged(docs: DataFrame, key: str, text: str, size: int = RANGE) -> tuple[Column, list[int]]:
    """The number of each row's range of keys, and the ranges that have rows; null keys are in the lowest."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = min(RANGES, max(total // size, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1)
    at = F.percentile_approx(key, [i / n for i in range(1, n)], F.lit(8 * n))
    cuts = sorted(set(docs.agg(at).first()[0] or []))
    # two steps of search, each among the square root of the cuts
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    k = F.col(key).cast("long")
    heads = F.from_json(F.lit(json.dumps([p[0] for p in parts[1:] if p])), "array<bigint>")
    tails = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    below = lambda x: F.size(F.filter(x, lambda c: c <= k))
    part = below(heads)
    bucket = F.when(k.isNull(), 0).otherwise(part * step + below(F.element_at(tails, part + 1)))
    full = sorted(r[0] for r in docs.select(bucket.alias("b")).distinct().collect())  # RANGES numbers at most
    return bucket, full


def following(docs: DataFrame, key: str, text: str, more: list[str], size: int = RANGE) -> DataFrame:
    """(range, rn, key, text, *more, next, next_<c> for c in more): each row with the text of its follower; (range, rn) names a row."""
    bucket, full = ranged(docs, key, text, size)
    rows = docs.select(bucket.alias("range"), key, text, *more)
    full = full or [0]
    # the range that comes before each in descending order; before the highest comes the lowest, as the first document follows the last
    before = {b: z for b, z in zip(full, full[1:] + full[:1])}
    after = F.element_at(F.from_json(F.lit(json.dumps([before.get(b, b) for b in range(full[-1] + 1)])), "array<int>"), F.col("range") + 1)
    order = [F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first()]
    tops = F.broadcast(rows.groupBy("range").agg(F.max(key).alias("top")).withColumnRenamed("range", "of"))  # RANGES rows at most
    heads = rows.join(tops, (F.col("range") == F.col("of")) & F.col(key).eqNullSafe(F.col("top"))).drop("of", "top")
    first = heads.withColumn("rn", F.row_number().over(Window.partitionBy("range").orderBy(*order))).where("rn = 1").drop("rn")
    both = rows.withColumn("extra", F.lit(False)).unionByName(first.withColumn("range", after).withColumn("extra", F.lit(True)))
    w = Window.partitionBy("range").orderBy("extra", *order)
    led = both.select("*", F.row_number().over(w).alias("rn"), F.lead(F.coalesce(text, F.lit(""))).over(w).alias("next"), *(F.lead(c).over(w).alias(f"next_{c}") for c in more))
    return led.where("not extra").drop("extra")


def edited_and_next(docs: DataFrame, key: str, text: str, bits: int = 128, size: int = RANGE) -> DataFrame:
    """(range, rn, key, text, h, next, next_h, n_chars, edited): h is the bucket of a text; the last third of an edited text is the follower's beginning."""
    own = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).withColumn("canon", canonical(F.col("text"))).withColumn("h", wide(F.col("canon"), bits)).drop("canon")
    rows = following(own, key, "text", ["h"], size).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    return rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next", third)))


def alike(a: str, b: str, ha: str, hb: str) -> Column:
    """1.0 if the canonical texts are equal, which are made and compared where the buckets are equal only."""
    return F.when(F.col(ha) == F.col(hb), canonical(F.col(a)) == canonical(F.col(b))).otherwise(F.lit(False)).cast("double")


def clashes(rows: DataFrame, marks: DataFrame, bits: int = 128, small: int = SMALL) -> DataFrame | None:
    """(range, rn, side, variant) of the texts in buckets of different texts; None if no bucket has several.

    marks: (range, rn, h, edited_h, near_edited); rows: the same rows with their texts. side: 0 for text, 1 for edited (if it isn't alike).
    """
    spark, paths = rows.sparkSession, []
    sides = F.filter(F.array(F.struct(F.lit(0).alias("side"), "h", F.lit(0.0).alias("near")), F.struct(F.lit(1).alias("side"), F.col("edited_h").alias("h"), F.col("near_edited").alias("near"))), lambda s: s["near"] < 1)
    each = marks.select("range", "rn", F.explode(sides).alias("s")).select("range", "rn", "s.side", F.col("s.h.a").alias("a"), F.col("s.h.b").alias("b"))
    # a table of its own, so that Spark can split the join at a hot bucket
    shared = written(each.groupBy("a", "b").count().where("count > 1").select("a", "b"), "shared", paths)
    wanted = written(each.join(shared, ["a", "b"]).groupBy("range", "rn").agg(F.collect_set("side").alias("sides")), "wanted", paths)
    n = wanted.count()
    swept(spark)  # the pass that made the marks has ended: its copy of the texts goes before they move again
    found = None
    if n:
        here = rows.select("range", "rn", "text", "edited").join(F.broadcast(wanted) if n <= small else wanted, ["range", "rn"])
        here = here.select("range", "rn", F.explode("sides").alias("side"), "text", "edited").withColumn("canon", canonical(F.when(F.col("side") == 0, F.col("text")).otherwise(F.col("edited"))))
        here = here.withColumn("h", wide(F.col("canon"), bits)).select("range", "rn", "side", F.col("h.a").alias("a"), F.col("h.b").alias("b"), "canon")
        mixed = written(here.groupBy("a", "b", "canon").agg(F.lit(1)).groupBy("a", "b").count().where("count > 1").select("a", "b"), "mixed", paths)
        if not mixed.isEmpty():
            texts = written(here.join(mixed, ["a", "b"]), "collisions", paths)
            variants = texts.select("a", "b", "canon").distinct().withColumn("variant", F.row_number().over(Window.partitionBy("a", "b").orderBy("canon")) - 1)
            found = written(texts.join(variants, ["a", "b", "canon"]).select("range", "rn", "side", "variant"), "variants")
    for p in paths:
        remove(spark, p)
    return found


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", *, bits: int = 128, size: int = RANGE, small: int = SMALL) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text's last floor(n_chars / 3) code points are the first ones (as many, or all) of the follower. near_edited, near_next: 1.0 if the edited
    text or the follower has the same canonical text, else 0.0.
    """
    free(docs.select(key), *RESULTS)
    k, t = "key", "text"  # names of this module's own tables
    rows = edited_and_next(docs.select(F.col(key).alias(k), F.col(text).alias(t)), k, t, bits, size)
    marks = rows.withColumn("canon", canonical(F.col("edited"))).withColumn("edited_h", wide(F.col("canon"), bits))
    marks = marks.select("range", "rn", k, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "h", "edited_h", alike(t, "edited", "h", "edited_h").alias("near_edited"), alike(t, "next", "h", "next_h").alias("near_next"))
    marks = written(marks, "marks")
    swept(docs.sparkSession)
    clash = clashes(rows, marks, bits, small)
    own, edited = F.lit(0), F.lit(0)
    if clash is not None:
        for side, name in ((0, "own"), (1, "other")):
            marks = marks.join(clash.where(f"side = {side}").select("range", "rn", F.col("variant").alias(name)), ["range", "rn"], "left")
        own = F.coalesce("own", F.lit(0))
        edited = F.when(F.col("near_edited") == 1, own).otherwise(F.coalesce("other", F.lit(0)))
    named = lambda h, v: F.concat(shown(F.col(h)), F.when(v > 0, F.concat(F.lit("-"), v.cast("string"))).otherwise(F.lit("")))
    return marks.select(F.col(k).alias(key), "n_chars", "edited_sha256", named("h", own).alias("fingerprint"), named("edited_h", edited).alias("edited_fingerprint"), "near_edited", "near_next")
