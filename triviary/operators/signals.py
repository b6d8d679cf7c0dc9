"""Signals of guessability: a flag cascade over a question's text and options."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..functions import text as X
from . import bloom

# The flags that mean that a question can be answered without knowing the fact.
GUESSABILITY = ["stem_leak", "lone_canon_option", "weak_distractors", "meta_noise_option", "numeric_ladder", "answer_len_outlier"]


def vocabulary(facts: DataFrame, answers: DataFrame, titles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(vkey, kinds, page, entity): what is known of every key.

    kinds: what facts and answers know the key as, sorted: the kinds of the facts of this title, `field:name` for each field with a part of this key, `answer`.
    page: titles (key) of all pages hold it; entity: a page or a fact has it as its title. asked: questions; keys that none of their options has are left out early.
    """
    part = F.btrim(F.regexp_replace("p", r"\s*\([^()]*\)", ""), F.lit(" ;,."))
    of = lambda key, kind, page, entity: (key.alias("vkey"), kind.alias("kind"), F.lit(page).alias("page"), F.lit(entity).alias("entity"))
    titled = facts.select(*of(X.norm_key(F.col("title")), F.col("kind"), False, True))
    values = facts.select(F.explode("fields").alias("name", "vs")).select("name", F.explode("vs").alias("v")).select("name", F.explode(F.split("v", "[;,]")).alias("p")).select("name", part.alias("part"))
    parts = values.where(F.length("part") >= 2).select(*of(X.norm_key(F.col("part")), F.concat(F.lit("field:"), "name"), False, False))
    said = answers.select(*of(X.norm_key(F.col("correct_answer")), F.lit("answer"), False, False))
    rows = titled.unionByName(parts).unionByName(said)
    if titles is not None:
        rows = rows.unionByName(titles.where("key <> ''").select(*of(F.col("key"), F.lit(None).cast("string"), True, True)))
    rows = rows.where("vkey is not null")
    if asked is not None:
        rows = bloom.joinable(rows, "vkey", _probes(asked), "vkey")
    return rows.groupBy("vkey").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("page").alias("page"), F.max("entity").alias("entity"))


def _probes(questions: DataFrame) -> DataFrame:
    """(id, pos, vkey, own): the key of each option, and that without a leading 'the', which names pages alone."""
    key = X.norm_key(F.col("o"))
    both = F.array(F.struct(key.alias("vkey"), F.lit(True).alias("own")), F.struct(F.when(F.startswith(key, F.lit("the")), F.substring(key, 4, 1 << 30)).alias("vkey"), F.lit(False).alias("own")))
    each = questions.select("id", F.posexplode("options").alias("pos", "o")).select("id", "pos", F.explode(both).alias("p"))
    return each.select("id", "pos", "p.*").where("own or vkey is not null")


def attested(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """questions with known: array<struct<known, kinds, page>> in the order of the options; page: whether the option has a page or fact of its own."""
    own = F.col("own")
    # a key of some kind or of a page is known; without its article only a page counts
    named = F.when(own, (F.size("kinds") > 0) | F.col("page")).otherwise(F.col("page"))
    hit = _probes(questions).join(vocab, "vkey", "left").groupBy("id", "pos")
    hit = hit.agg(F.coalesce(F.max(named), F.lit(False)).alias("known"), F.coalesce(F.max(F.when(own, F.col("kinds"))), F.array().cast("array<string>")).alias("kinds"), F.coalesce(F.max(own & F.col("entity")), F.lit(False)).alias("page"))
    known = hit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "known", "kinds", "page"))).alias("known"))
    return questions.join(known, "id")


def flags(q: DataFrame, apart: str = f"{X.SPACE}+") -> DataFrame:
    """q (id, question, correct_answer, incorrect_answers, options, known, gloss) with flags and guessability_flags.

    apart: the pattern that parts the words of an answer whose length is judged.
    """
    o, right, wrong = F.col("options"), F.col("correct_answer"), F.col("incorrect_answers")
    ladder = X.is_numeric_ladder(o)
    named = X.is_entity_like(o) & ~ladder & ~X.is_parallel_enumeration(o)
    pairs = F.arrays_zip(o.alias("o"), F.col("known").alias("k"))
    others = F.filter(pairs, lambda p: p["o"] != right)
    lost = F.size(F.filter(others, lambda p: ~p["k"]["known"]))
    own = F.get(F.filter(pairs, lambda p: p["o"] == right), 0)["k"]
    lone = named & (lost == 3) & own["page"]
    kinds = F.transform(others, lambda p: p["k"]["kinds"])
    on = lambda c, name: F.when(c, F.lit(name))
    all_ = F.array_compact(
        F.array(
            on(named & X.stem_leak(F.col("question"), right, wrong), "stem_leak"),
            on(named & X.gloss_leak(F.col("question"), right, F.col("gloss")), "gloss_leak"),
            F.when(lone, F.lit("lone_canon_option")).when(named & (lost >= 2), F.lit("weak_distractors")).when(named & (lost > 0), F.lit("unattested_option")),
            on(F.exists(o, lambda x: X.norm_key(x).isin(X.META_NOISE)), "meta_noise_option"),
            on(ladder, "numeric_ladder"),
            on(X.answer_len_outlier(right, wrong, apart), "answer_len_outlier"),
            on(X.cross_domain(own["kinds"], kinds), "cross_domain"),
        )
    )
    return q.withColumn("flags", all_).withColumn("guessability_flags", F.array_intersect("flags", X.literals(GUESSABILITY)))


def with_subjects(questions: DataFrame, facts: DataFrame, subject: str = "subject", order: str | None = None) -> DataFrame:
    """questions with article_len, prominence, must_know of their subject, and the gloss of their answer, from facts of the same key.

    Of several facts of one key the last in `order` counts, for all of its fields; without an order keys must be unique.
    """
    part = lambda name: F.array_join(F.coalesce(F.try_element_at("fields", F.lit(name)), F.array().cast("array<string>")), " ")
    own = facts.select(X.norm_key(F.col("title")).alias("_k"), F.struct(F.coalesce("article_len", F.lit(0)).alias("article_len"), F.concat_ws(" ", part("ename"), part("meaning"), part("translation")).alias("gloss")).alias("_f"), *([F.col(order).alias("_o")] if order else []))
    last = own.groupBy("_k").agg((F.max_by("_f", "_o") if order else F.max("_f")).alias("_f"))
    known = X.must_know(F.col(subject))
    q = questions.join(last.select("_k", "_f.article_len"), X.norm_key(F.col(subject)) == F.col("_k"), "left").drop("_k").withColumn("must_know", known)
    q = q.withColumn("prominence", F.when(F.col("article_len").isNotNull(), scores.prominence(known, F.col("article_len"))).when(known, 2))
    return q.join(last.select(F.col("_k").alias("_a"), "_f.gloss"), X.norm_key(F.col("correct_answer")) == F.col("_a"), "left").drop("_a")


def guessable_share(rows: DataFrame) -> DataFrame:
    """Per authored difficulty: questions, those that can be guessed, and their share in percent."""
    n, some = F.count("*"), F.count_if(F.size("guessability_flags") > 0)
    return rows.groupBy("authored").agg(n.alias("total"), some.alias("guessable"), F.round(100 * some / n, 0).alias("share"))


def offenders(rows: DataFrame, limit: int, flag: str | None = None, order: str = "id") -> DataFrame:
    """The first questions with a flag; without one the hard questions that can be guessed, those of most flags first."""
    if flag:
        return rows.where(F.array_contains("flags", flag)).orderBy(order).limit(limit)
    return rows.where((F.col("authored") == "hard") & (F.size("guessability_flags") > 0)).orderBy(F.desc(F.size("guessability_flags")), order).limit(limit)


@F.pandas_udf(T.DoubleType())
def option_similarity(options: pd.Series) -> pd.Series:
    """Mean Ratcliff-Obershelp ratio of all pairs of keys; 0 for fewer than two."""

    def one(values) -> float:
        keys = ["".join(c for c in str(v).lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789") for v in values] if values is not None else []
        ratios = [SequenceMatcher(None, a, b).ratio() for a, b in combinations(keys, 2)]
        return sum(ratios) / len(ratios) if ratios else 0.0

    return options.map(one)


@F.pandas_udf(T.StringType())
def html_decoded(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from html import unescape

    for s in values:
        yield s.map(unescape, na_action="ignore")
