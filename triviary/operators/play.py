"""Answers and play requests: progress, statistics, mastery, review, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges, scores


def category_stats(answers: DataFrame, by: list[str]) -> DataFrame:
    """Correct answers, answers and accuracy (halves up) by `by`, for rows with a category."""
    rows = answers.where((F.col("category") != "") & F.col("category").isNotNull())
    out = rows.groupBy(*by).agg(F.sum("point").alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", scores.half_up(F.col("correct") * 100 / F.col("total")))


def weakest(stats: DataFrame, by: list[str]) -> DataFrame:
    """The category of least accuracy; of equals the first by name."""
    return stats.groupBy(*by).agg(F.min_by("category", F.struct("accuracy", "category")).alias("weakest"), F.min("accuracy").alias("weakest_accuracy"))


#: Answers in a range of time; a question's answers in one range are summarised together.
CHUNK = 1 << 16


def summarised(answers: DataFrame, keys: tuple[str, ...] = ("profile", "qid"), size: int = CHUNK) -> DataFrame:
    """(*keys, chunk, s): the answers of each question in each range of time, as a summary that can be merged with those before and after it.

    s: seen, correct, lead and trail (right answers before the first and after the last wrong one; all of them if none is wrong), inner (runs in between that are
    long enough for mastery) and last_seen. Ranges are cut at percentiles of the time, so a question with any number of answers is spread over tasks.
    """
    at = ranges.whole(answers, "ts")
    cuts = ranges.bounds(answers.select("ts"), at, size)
    rows = answers.select(*keys, ranges.number(at, cuts).alias("chunk"), "ts", "seq", "point")
    said = rows.groupBy(*keys, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "point"))), lambda x: F.when(x["point"] == 1, "1").otherwise("0")), "").alias("p"), F.max("ts").alias("last_seen"))
    p, one = F.col("p"), F.lit("1")
    lead, trail = F.length(p) - F.length(F.ltrim(p, one)), F.length(p) - F.length(F.rtrim(p, one))
    inner = F.regexp_count(F.btrim(p, one), F.lit("1{%d,}" % scores.MASTERED))
    whole = [F.length(p).alias("seen"), (F.length(p) - F.length(F.replace(p, one, F.lit("")))).alias("correct"), lead.alias("lead"), trail.alias("trail"), inner.alias("inner")]
    return said.select(*keys, "chunk", F.struct(*(c.cast("bigint").alias(n) for c, n in zip(whole, ("seen", "correct", "lead", "trail", "inner"))), F.col("last_seen")).alias("s"))


def merged_summaries(a: Column, b: Column) -> Column:
    """The summary of the answers of a followed by those of b. Associative, so summaries can be merged in any grouping."""
    all_a, all_b = a["lead"] == a["seen"], b["lead"] == b["seen"]
    # the run over the border counts if it is inside, that is, if both sides have a wrong answer
    border = F.when(~all_a & ~all_b & (a["trail"] + b["lead"] >= scores.MASTERED), 1).otherwise(0).cast("bigint")
    return F.struct(
        (a["seen"] + b["seen"]).alias("seen"),
        (a["correct"] + b["correct"]).alias("correct"),
        F.when(all_a, a["seen"] + b["lead"]).otherwise(a["lead"]).alias("lead"),
        F.when(all_b, a["trail"] + b["seen"]).otherwise(b["trail"]).alias("trail"),
        (a["inner"] + b["inner"] + border).alias("inner"),
        F.greatest(a["last_seen"], b["last_seen"]).alias("last_seen"),
    )


def folded(summaries: DataFrame, keys: tuple[str, ...] = ("profile", "qid")) -> DataFrame:
    """(*keys, s): one summary per question, of its summaries in the order of their chunks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"])
    return summaries.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.aggregate(F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1)), F.get("parts", 0), merged_summaries).alias("s"))


def states(rows: DataFrame, keys: tuple[str, ...] = ("profile", "qid")) -> DataFrame:
    """The state of every question from its summary s."""
    s = F.col("s")
    enough = lambda n: (n >= scores.MASTERED).cast("bigint")
    # the runs at both ends; one run is both if nothing was wrong
    times = s["inner"] + F.when(s["lead"] == s["seen"], enough(s["seen"])).otherwise(enough(s["lead"]) + enough(s["trail"]))
    return rows.select(*keys, s["seen"].alias("seen"), s["correct"].alias("correct"), (s["seen"] - s["correct"]).alias("wrong"), s["trail"].alias("streak"), (s["trail"] >= scores.MASTERED).alias("mastered"), s["last_seen"].alias("last_seen"), times.alias("times_mastered"))


def progress(answers: DataFrame, keys: tuple[str, ...] = ("profile", "qid"), size: int = CHUNK) -> DataFrame:
    """The state of every question of every profile after all its answers."""
    return states(folded(summarised(answers, keys, size), keys), keys)


def summary(answers: DataFrame, state: DataFrame) -> DataFrame:
    """Per profile: mastered questions, answers, right ones and the accuracy to two places."""
    a = answers.groupBy("profile").agg(F.count("*").alias("answered"), F.sum("point").alias("correct"))
    m = state.groupBy("profile").agg(F.sum(F.col("mastered").cast("int")).alias("mastered"))
    return a.join(m, "profile").withColumn("accuracy", scores.percent(F.col("correct"), F.col("answered")))


def missed(state: DataFrame) -> DataFrame:
    """Questions missed and not mastered, ranked per profile: most wrong first, then longest unseen."""
    rows = state.where((F.col("wrong") > 0) & ~F.col("mastered"))
    w = Window.partitionBy("profile").orderBy(F.desc("wrong"), "last_seen", "qid")
    return rows.withColumn("place", F.row_number().over(w))


def matching(bank: DataFrame, category: str | None = None, difficulty: str | None = None, saga: int | None = None) -> DataFrame:
    """Questions of a category ('0' or none: any), difficulty ('adaptive' or none: any) and saga at most (null and 0 pass)."""
    if category not in (None, "0"):
        bank = bank.where(F.col("category") == category)
    if difficulty not in (None, "any", "adaptive"):
        bank = bank.where(F.col("difficulty") == difficulty)
    if saga:
        bank = bank.where(F.col("saga").isNull() | (F.col("saga") <= saga))
    return bank


def unmastered(asked: DataFrame, state: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Per profile the questions not mastered, or all if fewer than `least` are left; `fresh` says which, `enough` whether there are `least` at all."""
    done = state.where("mastered").select("profile", *keys)
    all_ = asked.join(done.withColumn("_done", F.lit(True)), ["profile", *keys], "left")
    w = Window.partitionBy("profile")
    counted = all_.withColumn("n_fresh", F.count(F.when(F.col("_done").isNull(), 1)).over(w)).withColumn("n_all", F.count("*").over(w))
    kept = counted.where((F.col("n_fresh") < least) | F.col("_done").isNull())
    return kept.select("profile", *keys, F.col("_done").isNull().alias("fresh"), (F.col("n_all") >= least).alias("enough"))


def sample(bank: DataFrame, n: int, mix: dict[str, float], key: Column, order: Column) -> DataFrame:
    """n rows: of each difficulty its share, then others, in the order of `order`, a hash of the seed and `key`.

    The ranks within a difficulty need only each difficulty's first rows, so these are cut per partition before the shuffle.
    """
    rows = bank.withColumn("_o", order).withColumn("_k", key)
    w = Window.partitionBy("difficulty").orderBy("_o", "_k")
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    quota = F.lit(0)
    for level, share in mix.items():
        quota = F.when(F.col("difficulty") == level, int(n * share + 0.5)).otherwise(quota)
    ranked = ranked.withColumn("priority", F.when(F.col("_r") <= quota, 0).otherwise(1))
    return ranked.orderBy("priority", "_o", "_k").limit(n).drop("_o", "_k", "_r")


def shuffled(rows: DataFrame, order: Column, n: int | None = None) -> DataFrame:
    """rows in the order of a hash (or rand(), if none need come out the same again), or the first n of them: a uniform sample."""
    out = rows.orderBy(order)
    return out if n is None else out.limit(n)


def with_options(rows: DataFrame, seed: Column) -> DataFrame:
    """rows with the right and the wrong answers as options, in an order that the seed gives."""
    every = F.array_append("incorrect_answers", F.col("correct_answer"))
    keyed = F.array_sort(F.transform(every, lambda o: F.struct(F.md5(F.concat(seed, F.lit("|"), o)).alias("h"), o.alias("o"))))
    return rows.withColumn("options", F.transform(keyed, lambda s: s["o"]))


def recorded(rows: DataFrame) -> DataFrame:
    """A finished quiz: a question without an answer says so and counts as missed."""
    said = F.coalesce("user_answer", F.lit("No answer"))
    return rows.withColumn("user_answer", said).withColumn("point", F.when(said == F.col("correct_answer"), 1).otherwise(0))


def created(names: DataFrame, name: str, place: str) -> DataFrame:
    """Profiles with their shown name and, in turn, their colour."""
    return names.withColumn("name", scores.profile_name(F.col(name))).withColumn("color", scores.profile_color(F.col(place)))


def removed(profiles: DataFrame, gone: DataFrame, key: str = "profile") -> DataFrame:
    """What is left of profiles, or of their answers or progress, once some are deleted."""
    return profiles.join(gone.select(key), key, "left_anti")


def active(profiles: DataFrame, chosen: DataFrame, by: str, order: str) -> DataFrame:
    """Per `by` the chosen profile if there still is one of that name, else the first, else none; chosen: (by, profile)."""
    there = profiles.groupBy(by).agg(F.min_by("profile", order).alias("first"), F.collect_set("profile").alias("_all"))
    joined = chosen.withColumnRenamed("profile", "_c").join(there, by, "left")
    return joined.select(by, F.when(F.array_contains("_all", F.col("_c")), F.col("_c")).otherwise(F.col("first")).alias("active"))


def defaulted(profiles: DataFrame, saved: DataFrame, levels: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """The counters (profile, difficulty, correct, total) of every profile; those that an old or partial save lacks are 0."""
    every = profiles.select("profile").withColumn("difficulty", F.explode(F.array(*map(F.lit, levels))))
    zero = F.lit(0).cast("long")
    return every.join(saved, ["profile", "difficulty"], "left").select("profile", "difficulty", F.coalesce("correct", zero).alias("correct"), F.coalesce("total", zero).alias("total"))


def settled(turns: DataFrame, group: str, key: str, order: str, learn: bool) -> DataFrame:
    """One row per group and key: the first in learn mode, which locks answers, else the last."""
    pick = F.min_by if learn else F.max_by
    return turns.groupBy(group, key).agg(pick("text", order).alias("text"), F.count("*").alias("n"))
