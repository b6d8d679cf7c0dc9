"""The question bank: dedupe, validation, overlays, golden facts and anchors, export."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import written

# What a question must have.
REQUIRED = "category type difficulty question correct_answer incorrect_answers options source".split()
CATEGORIES = ["Characters", "Devil Fruits", "Arcs & Story", "Crews & Organizations", "Bounties", "Geography"]
DIFFICULTIES = ["easy", "medium", "hard"]


def first_wins(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in the given order; all empty keys are one.

    Rows travel under the key's 128-bit hash, as keys may be as long as texts.
    """
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", F.md5(F.coalesce(key, F.lit("")))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def fault(q: DataFrame, url: str = r"^https://[a-z0-9.-]+/wiki/.", categories: list[str] = CATEGORIES) -> Column:
    """The first rule that a question breaks, in order; null if it is valid."""
    has = lambda c: F.col(c).isNotNull()
    missing = F.filter(F.array(*[F.when(~has(c), F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    o, right, wrong = F.col("options"), F.col("correct_answer"), F.col("incorrect_answers")
    # the keys are bound once for all six pairs; four options are certain where this rule is reached
    pairs = lambda k: reduce(or_, [X.near_dupe(F.get(k, i), F.get(k, j)) for i, j in combinations(range(4), 2)])
    near = F.get(F.transform(F.array(F.transform(o, X.norm_key)), pairs), 0)
    each = F.filter(F.transform(o, lambda x: F.when(X.norm_key(x).isin(X.META_NOISE), F.concat(F.lit("noise option: "), x)).when(F.contains(x, F.lit(", ")) & ~F.contains(x, F.lit(", Model:")), F.concat(F.lit("comma in option: "), x))), lambda e: e.isNotNull())
    blank = lambda c: F.trim(c) == ""
    rules = [
        (F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        (F.col("type") != "multiple", F.lit("type")),
        (~F.col("difficulty").isin(DIFFICULTIES), F.lit("difficulty")),
        (~F.col("category").isin(categories), F.lit("category")),
        (blank(F.col("question")), F.lit("blank question")),
        (~F.col("source").rlike(url), F.lit("source")),
        (F.size(o) != 4, F.lit("not four options")),
        (F.exists(o, blank), F.lit("blank option")),
        (F.size(F.filter(o, lambda x: x == right)) != 1, F.lit("answer not once among options")),
        (F.size(wrong) != 3, F.lit("not three incorrect answers")),
        (F.array_contains(F.transform(wrong, X.norm_key), X.norm_key(right)), F.lit("answer among incorrect")),
        (near, F.lit("near-duplicate options")),
        (F.col("explainer").isNotNull() & blank(F.col("explainer")), F.lit("blank explainer")),
        (F.col("image").isNotNull() & ~F.startswith(F.col("image"), F.lit("http")), F.lit("image")),
        (F.size(each) > 0, F.get(each, 0)),
    ]
    out = F.when(F.lit(False), F.lit(""))
    for broken, said in rules:
        out = out.when(broken, said)
    return out


def faults(rows: DataFrame, reason: Column, order: str) -> DataFrame:
    """How many rows each reason drops, and the first of them."""
    return rows.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def with_difficulty(rows: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """rows with the overlay's tier as difficulty where there is one; the authored one is kept beside it and isn't overwritten by a second run."""
    o = overlay.select(F.col(key).alias("_key"), F.col("tier"), F.col("score"))
    joined = rows.join(o, rows[key] == o["_key"], "left")
    if "authored" not in rows.columns:
        joined = joined.withColumn("authored", F.col("difficulty"))
    return joined.withColumn("difficulty", F.coalesce("tier", "difficulty")).drop("_key")


def transitions(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.concat_ws(" -> ", "authored", F.coalesce("tier", F.lit("kept"))).alias("change")).agg(F.count("*").alias("n"))


def with_images(rows: DataFrame, cache: DataFrame, title: str) -> DataFrame:
    """rows with image and image_state: 'found', 'none' (asked, there is none) or 'not asked'."""
    c = cache.select(F.col("title").alias("_title"), F.col("url").alias("_url"), F.lit(True).alias("_asked"))
    state = F.when(F.col("_asked").isNull(), "not asked").when(F.col("_url").isNull(), "none").otherwise("found")
    return rows.join(c, rows[title] == c["_title"], "left").withColumn("image", F.col("_url")).withColumn("image_state", state).drop("_title", "_url", "_asked")


def golden(facts: DataFrame, bank: DataFrame) -> DataFrame:
    """Each golden fact (question, answer) with 'missing', 'wrong' or 'ok'."""
    b = bank.select(X.norm_key(F.col("question")).alias("_k"), X.norm_key(F.col("correct_answer")).alias("_a"), F.lit(True).alias("_in"))
    f = facts.withColumn("_key", X.norm_key(F.col("question")))
    state = F.when(F.col("_in").isNull(), "missing").when(F.col("_a") != X.norm_key(F.col("answer")), "wrong").otherwise("ok")
    return f.join(b, f["_key"] == b["_k"], "left").withColumn("state", state).drop("_k", "_a", "_in", "_key")


def anchors(wanted: DataFrame, bank: DataFrame, overlay: DataFrame) -> DataFrame:
    """Each anchor (key, allowed) with 'missing', 'ok', 'failure' (rated, but not allowed) or 'pending'; only raters bind."""
    b = bank.select(F.col("key").alias("_k"), F.col("difficulty").alias("_d"))
    o = overlay.select(F.col("key").alias("_o"), F.col("basis").alias("_basis"))
    joined = wanted.join(b, wanted["key"] == b["_k"], "left").join(o, wanted["key"] == o["_o"], "left")
    state = F.when(F.col("_k").isNull(), "missing").when(F.array_contains("allowed", F.col("_d")), "ok").when(F.col("_basis") == "raters", "failure").otherwise("pending")
    return joined.withColumn("state", state).drop("_k", "_d", "_o", "_basis")


def batches(rows: DataFrame, order: list, size: int = 20) -> DataFrame:
    """rows with their batch ('b00', ...) and number in it from 1, in a total order.

    Ranks come from a range-partitioned sort, written once with its partitions' numbers, and the partitions' counts, so no task holds all rows.
    """
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "batches")
    w = Window.partitionBy("_p").orderBy(*order)
    local = sorted_.withColumn("_i", F.row_number().over(w))
    counts = local.groupBy("_p").agg(F.count("*").alias("_c"))  # one row per partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    n = (F.col("_before") + F.col("_i") - 1).cast("long")
    joined = local.join(F.broadcast(before), "_p").withColumn("_n", n)
    number = F.floor(F.col("_n") / size)
    return joined.withColumn("batch", F.concat(F.lit("b"), F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")))).withColumn("n", F.col("_n") % size + 1).drop("_p", "_i", "_before", "_n")


def combined(sources: list[DataFrame], key: Column, order: str) -> DataFrame:
    """The rows of all sources, of each key the one of the first source that has it, in that source's order: curated questions come before generated ones."""
    out = None
    for rank, rows in enumerate(sources):
        rows = rows.withColumn("_src", F.lit(rank))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return first_wins(out, key, ["_src", order]).drop("_src")


def manifest(batched: DataFrame, raters: list[str]) -> DataFrame:
    """(batch, items, raters): what each exported batch holds, so verdicts can be brought back to their questions."""
    listed = F.array_sort(F.collect_list(F.struct("n", "hash", "key")))
    return batched.groupBy("batch").agg(listed.alias("items")).withColumn("raters", F.array(*map(F.lit, raters)))


def unasked(rows: DataFrame, cache: DataFrame, title: str, limit: int | None = None) -> DataFrame:
    """The distinct titles that a cache (title, url) doesn't hold, not even as one without an image, by name; the first `limit` of them."""
    t = rows.select(F.col(title).alias("title")).where("title is not null and title <> ''").distinct()
    left = t.join(cache.select("title"), "title", "left_anti").orderBy("title")
    return left if limit is None else left.limit(limit)


def counted(rows: DataFrame, by: str) -> DataFrame:
    """Rows by value, most first."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def rendered(n: Column, question: Column, options: Column) -> Column:
    """A numbered question with lettered options, as raters read it."""
    lines = F.transform(options, lambda o, i: F.concat(F.lit("   "), F.element_at(F.array(*map(F.lit, "ABCDEFGH")), i + 1), F.lit(") "), o))
    return F.concat(n.cast("string"), F.lit(". "), question, F.lit("\n"), F.array_join(lines, "\n"))
