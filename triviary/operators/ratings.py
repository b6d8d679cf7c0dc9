"""Raters' verdicts: merge with signals into scores and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.tables import written
from .bank import batches


def merged(ratings: DataFrame, item: str = "item") -> DataFrame:
    """Per item: raters, median score (halves to even), spread, guess votes and the penalty for them."""
    one = ratings.groupBy(item).agg(
        F.count("*").alias("raters"),
        F.bround(F.median("knowledge_score"), 0).cast("int").alias("median"),
        (F.max("knowledge_score") - F.min("knowledge_score")).alias("spread"),
        F.count_if("guessable").alias("votes"),
    )
    return one.withColumn("penalty", F.bround(30 * F.col("votes") / F.col("raters"), 0).cast("int"))


def quoted(c: Column) -> Column:
    """In single quotes, or double ones if it holds single ones alone, as names are shown in reports."""
    plain = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def scored(items: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """items (key, authored, guessability_flags, must_know and, if there is one, subject) with score, tier, basis and the reasons for it."""
    r = merged(ratings, key)
    rated = F.col("raters").isNotNull()
    joined = items.join(r, key, "left")
    base = F.coalesce("median", scores.prior(F.col("authored")))
    signal = scores.signal_penalty(F.col("guessability_flags"))
    raw = scores.clamp(base - F.coalesce("penalty", F.lit(0)) - signal)
    ceiling = F.col("must_know") & (raw > scores.MEDIUM) & ~(rated & (F.col("median") >= 70))
    # The sentences that explain a score.
    flags = F.col("guessability_flags")
    named = F.lit("None") if "subject" not in items.columns else F.coalesce(quoted(F.col("subject")), F.lit("None"))
    reasons = F.array_compact(
        F.array(
            F.when(~rated, F.lit("no ratings; holding the authored tier pending a rating pass")),
            F.when(F.col("votes") > 0, F.concat(F.col("votes"), F.lit("/"), F.col("raters"), F.lit(" raters called it guessable"))),
            F.when(signal > 0, F.concat(F.lit("signals: "), F.array_join(flags, ", "), F.lit(" (-"), signal.cast("int"), F.lit(")"))),
            F.when(ceiling, F.concat(F.lit(f"capped at {scores.MEDIUM}: headline subject ("), named, F.lit(") without strong rater support"))),
        )
    )
    score = F.when(ceiling, scores.MEDIUM).otherwise(raw)
    return joined.select(key, "authored", score.cast("int").alias("score"), scores.tier(score).alias("tier"), F.when(rated, "raters").otherwise("authored").alias("basis"), F.coalesce("spread", F.lit(0)).alias("spread"), reasons.alias("reasons"))


def review(rows: DataFrame, least: int = 30) -> DataFrame:
    """Items on which raters differ by `least` or more."""
    return rows.where(F.col("spread") >= least)


def crosstab(rows: DataFrame) -> DataFrame:
    """Authored against new tier, and the share that moved."""
    n = F.count("*")
    return rows.groupBy("authored").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in ("easy", "medium", "hard")], F.round(100 * F.count_if(F.col("tier") != F.col("authored")) / n, 1).alias("moved")
    )


def flag_counts(rows: DataFrame, flags: str = "flags") -> DataFrame:
    return rows.select("authored", F.explode(flags).alias("flag")).groupBy("flag", "authored").agg(F.count("*").alias("n"))


#: Raters in one word of a set of bits.
WORD = 62


def numbered(names: DataFrame, name: str) -> DataFrame:
    """Distinct names with a number n from 0 on, in their order."""
    first = names.select(name).where(F.col(name).isNotNull()).distinct()
    return batches(first, [name], WORD).select(name, (F.substring("batch", 2, 20).cast("bigint") * WORD + F.col("n") - 1).alias("n"))


def unrated(items: DataFrame, raters: DataFrame, ratings: DataFrame) -> DataFrame:
    """(item, rater) pairs that are missing.

    The raters of an item are a set of bits, 62 of them to a word, made by bitwise aggregates with partial aggregation; what is missing are the bits of the full set that
    it lacks. So a pair that is rated costs a bit and no row, and raters are known by their numbers alone until the missing ones get their names.
    """
    names = written(numbered(raters, "rater"), "raters")
    count = names.count()
    if not count:
        return items.select("item").limit(0).withColumn("rater", F.lit(None).cast(raters.schema["rater"].dataType))
    own = ratings.join(names, "rater").groupBy("item", F.floor(F.col("n") / WORD).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(n % {WORD}))")).alias("bits"))
    sets = own.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("sets"))
    words = F.sequence(F.lit(0).cast("bigint"), F.lit((count - 1) // WORD).cast("bigint"))
    each = items.select("item").distinct().join(sets, "item", "left").select("item", "sets", F.explode(words).alias("w"))
    # the last word may be shorter
    full = F.when(F.col("w") == (count - 1) // WORD, (1 << ((count - 1) % WORD + 1)) - 1).otherwise((1 << WORD) - 1)
    lacking = F.coalesce(F.try_element_at("sets", F.col("w")), F.lit(0).cast("bigint")).bitwiseXOR(full)
    bits = each.select("item", "w", lacking.alias("lacking")).where("lacking <> 0")
    place = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("lacking", b) == 1)
    return bits.select("item", F.explode(place).alias("b"), "w").select("item", (F.col("w") * WORD + F.col("b")).alias("n")).join(names, "n").select("item", "rater")


def cost(pending: DataFrame, batch: int = 20) -> DataFrame:
    """Per rater: pending ratings, requests, and estimated tokens in and out."""
    per = pending.groupBy("rater").agg(F.count("*").alias("pending"))
    requests = F.ceil(F.col("pending") / batch)
    return per.withColumn("requests", requests).withColumn("tokens_in", F.col("pending") * 250 + F.col("requests") * 1500).withColumn("tokens_out", F.col("pending") * 60)


def imported(verdicts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Verdicts (rater, batch, n, ...) under the hash that the manifest (batch, n, hash) gives; others fall out."""
    clean = verdicts.withColumn("knowledge_score", scores.clamp(F.col("knowledge_score")))
    return clean.join(manifest.select("batch", "n", "hash"), ["batch", "n"]).select("hash", "rater", "knowledge_score", "guessable", "reason")


def skipped(verdicts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per rater the verdicts that the manifest doesn't know and that are left out of imported()."""
    return verdicts.join(manifest.select("batch", "n"), ["batch", "n"], "left_anti").groupBy("rater").agg(F.count("*").alias("skipped"))


def chosen(items: DataFrame, ratings: DataFrame, raters: list[str], grep: str | None = None, difficulty: str | None = None, unrated: bool = False, order: str = "hash", limit: int | None = None) -> DataFrame:
    """The items to rate: whose question matches a pattern in any case, of one difficulty, not yet rated by all; the limit comes last."""
    if grep:
        items = items.where(F.col("question").rlike(f"(?i){grep}"))
    if difficulty:
        items = items.where(F.col("authored") == difficulty)
    if unrated:
        done = ratings.where(F.col("rater").isin(raters)).groupBy("hash").agg(F.count_distinct("rater").alias("_n")).where(F.col("_n") == len(set(raters)))
        items = items.join(done, "hash", "left_anti")
    return items.orderBy(order).limit(limit) if limit else items


def unknown(asked: Column, known: Column) -> Column:
    """The raters asked for that there aren't, in order."""
    return F.array_sort(F.array_except(asked, known))


def stale(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings whose hash no item has."""
    return ratings.join(items.select("hash").distinct(), "hash", "left_anti")
