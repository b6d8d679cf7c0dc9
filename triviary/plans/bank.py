"""From pages to facts and from facts to a bank: canon filter, pools, templates, distractors, leak test, caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as X
from ..operators import items, markup
from ..sources.tables import written

# Marks of titles that aren't canon; other works, as they stand in a debut, beside which only a bare chapter counts.
OTHER_TITLES = ["(non-canon)", "(novel)", "one piece in love"]
OTHER_WORKS = [r"One Piece Film", r"Film:", r"\bMovie\b", r"Odyssey", r"One Piece Party", r"One Piece in Love", r"One Piece Short", r"One Piece School", r"Chin Piece", r"Fischer's", r"Shokugeki no Sanji", r"One Piece novel", r"\bnovel\b", r"Chopperman", r"MiraBato", r"Dream Adventure Log", r"Stampede", r"Heart of Gold", r"Strong World", r"Dance Carnival", r"Live Attraction", r"Omake Manga Corner", r"episode A\b", r"3D2Y", r"Glorious Island", r"Cross Epoch", r"Romance Dawn Story"]
BARE_CHAPTER = r"^Chapter\s+\d+\.?$"
KIND_ORDER = ["character", "devil_fruit", "location"]
#: Templates of which an entity of the kind is asked by prominence first; the others by length alone.
BY_PROMINENCE = "character"


def facts_of(pages: DataFrame, base: str) -> DataFrame:
    """Facts of a wiki's pages (title, ns, text) in their order."""
    rows = written(markup.ordered(pages), "pages")
    return markup.facts(markup.infoboxes(rows), base, markup.articles(rows))


def field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def is_canon() -> Column:
    """Whether an entity debuts in a chapter and belongs to the story proper."""
    first = F.coalesce(field("first"), F.array().cast("array<string>"))
    bare = F.exists(F.flatten(F.transform(first, lambda v: F.split(v, ";"))), lambda c: F.trim(c).rlike(BARE_CHAPTER))
    elsewhere = F.exists(first, lambda v: v.rlike(f"(?i){'|'.join(OTHER_WORKS)}"))
    title = F.exists(X.literals(OTHER_TITLES), lambda t: F.contains(F.lower("title"), t))
    return ~title & scores.saga_of_first(first).isNotNull() & (bare | ~elsewhere)


def canon(facts: DataFrame) -> DataFrame:
    return facts.where(is_canon())


def clauses(values: Column) -> Column:
    """The trimmed clauses of all values without their qualifiers."""
    return F.transform(F.flatten(F.transform(values, lambda v: F.split(X.strip_quals(v), "[;,]"))), lambda c: F.trim(c))


def prepared(facts: DataFrame, must_multi: list[str] = X.MUST_KNOW_MULTI, must_single: list[str] = X.MUST_KNOW_SINGLE) -> DataFrame:
    """Canon facts with one clean column per template field; an affiliation that is a character's name is passed over."""
    f = canon(facts).where(F.col("kind").isin(KIND_ORDER))
    if "ord" not in f.columns:  # facts read from a file are in the order of their titles
        f = f.withColumn("ord", F.struct("title", "kind"))
    length = F.coalesce("article_len", F.lit(0))
    origin, affiliation = X.primary(field("origin")), X.primary(field("affiliation"))
    homes = F.transform(X.residences(field("residence")), lambda r: X.norm_key(r["place"]))
    kingdoms = F.filter(F.array(affiliation, origin), X.is_kingdom)
    f = f.select(
        "title",
        "kind",
        "source",
        "summary",
        "ord",
        length.alias("article_len"),
        scores.prominence(X.must_know(F.col("title"), list(must_multi), list(must_single)), length).alias("prominence"),
        scores.saga_of_first(field("first")).alias("saga"),
        X.combined_name(field("dfename"), field("dfname")).alias("df_name"),
        X.combined_name(field("ename"), F.coalesce(field("rname"), F.array("title"))).alias("fruit_name"),
        X.clean_bounty(field("bounty")).alias("bounty"),
        X.primary(field("occupation")).alias("occupation"),
        origin.alias("origin"),
        X.current_residence(field("residence")).alias("residence"),
        F.array_append(F.coalesce(homes, F.array().cast("array<string>")), F.coalesce(X.norm_key(origin), F.lit(""))).alias("homes"),
        X.clean_name(field("user")).alias("user"),
        X.primary(field("region")).alias("region"),
        F.when(X.is_kingdom(affiliation), affiliation).alias("kingdom"),
        F.get(kingdoms, 0).alias("any_kingdom"),
        clauses(field("affiliation")).alias("_aff"),
    )
    f = f.withColumn("saga_name", scores.saga_name(F.col("saga")))
    named = f.select("title", "kind", F.posexplode("_aff").alias("pos", "c")).where("c <> '' and lower(c) <> 'none'")
    names = f.where("kind = 'character'").select(X.norm_key(F.col("title")).alias("k")).distinct()
    free = named.withColumn("k", X.norm_key(F.col("c"))).join(names, "k", "left_anti")
    f = f.join(free.groupBy("title", "kind").agg(F.min_by("c", "pos").alias("affiliation")), ["title", "kind"], "left")
    for column, kind in (("occupation", "character"), ("origin", "character"), ("region", "location")):
        n = f.where(F.col("kind") == kind).where(F.col(column).isNotNull()).groupBy(X.norm_key(F.col(column)).alias("_k")).agg(F.count("*").alias(f"{column}_n"))
        f = f.join(n, X.norm_key(F.col(column)) == F.col("_k"), "left").drop("_k")
    return f


def pools(f: DataFrame) -> DataFrame:
    """All value pools in one table; occupations, origins and regions occur twice or more."""
    chars, places, fruits = (f.where(F.col("kind") == k) for k in ("character", "location", "devil_fruit"))
    both = f.where(F.col("kind").isin("character", "location")).withColumn("ord", F.struct(F.col("kind") == "character", "ord"))
    parts = [items.pool(chars, n, n, "ord") for n in ("df_name", "affiliation", "bounty", "residence")]
    parts += [items.pool(chars.where(f"{n}_n >= 2"), n, n, "ord") for n in ("occupation", "origin")]
    parts += [items.pool(places.where("region_n >= 2"), "region", "region", "ord"), items.pool(both, "kingdom", "any_kingdom", "ord"), items.pool(fruits, "fruit_user", "user", "ord")]
    parts += [items.pool(chars, "name", "title", "ord"), items.pool(chars.where("bounty is not null"), "bounty_holder", "title", "ord")]
    none = F.lit(None).cast("int")
    out = f.sparkSession.range(1).select(F.explode(X.literals(scores.SAGA_NAMES)).alias("v")).select(F.lit("saga").alias("pool"), "v", X.norm_key(F.col("v")).alias("norm_v"), none.alias("tier"), none.alias("saga"))
    for p in parts:
        out = out.unionByName(p.drop("ord"))
    return out


def asked(f: DataFrame) -> DataFrame:
    """One row per entity and template whose guard holds and whose answer is no noise, in emission order."""
    out = None
    for k, (kind, shapes) in enumerate((kind, items.TEMPLATES[kind]) for kind in KIND_ORDER):
        for n, t in enumerate(shapes):
            subject, answer, plain = F.col(t.subject), F.col(t.answer), t.pool == "saga"
            first = -F.col("prominence") if kind == BY_PROMINENCE else F.lit(0)
            rows = f.where((F.col("kind") == kind) & F.expr(t.guard) & subject.isNotNull() & answer.isNotNull() & ~X.is_noise(answer)).select(
                F.lit(t.name).alias("template"),
                F.lit(t.category).alias("category"),
                items.filled(t.text, subject, answer).alias("question"),
                answer.alias("answer"),
                F.lit(t.pool).alias("pool"),
                subject.alias("leak_ref"),
                "title",
                "source",
                X.lead(items.filled(t.fact, subject, answer), F.col("summary")).alias("explainer"),
                (F.lit(None).cast("int") if plain else F.col("prominence")).alias("tier"),
                (F.lit(None).cast("int") if plain else F.col("saga")).alias("saga"),
                F.col("saga").alias("own_saga"),
                scores.difficulty(F.col("prominence"), F.lit(t.depth)).alias("difficulty"),
                F.lit(t.cap).alias("answer_cap"),
                F.lit(items.TEMPLATE_CAP).alias("template_cap"),
                F.when(F.col("prominence") == 2, items.ENTITY_CAPS[2]).when(F.col("prominence") == 1, items.ENTITY_CAPS[1]).otherwise(items.ENTITY_CAPS[0]).alias("entity_cap"),
                F.struct(F.lit(k).alias("k"), first.alias("p"), (-F.col("article_len")).alias("l"), F.col("ord").alias("o"), F.lit(n).alias("n")).alias("ord"),
                F.lit(t.saga_bound).alias("saga_bound"),
                (F.col(t.own) if t.own else F.array().cast("array<string>")).alias("own"),
                F.lit(t.members).alias("members"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out.withColumn("id", F.xxhash64("template", "title", "answer"))


def memberships(facts: DataFrame) -> DataFrame:
    """(_crew, _member): the keys of everyone and of all that they are affiliated with."""
    rows = canon(facts).where("kind = 'character'").select(X.norm_key(F.col("title")).alias("_member"), F.explode(clauses(field("affiliation"))).alias("c"))
    return rows.select(X.norm_key(F.col("c")).alias("_crew"), "_member").where("_crew <> ''").distinct()


def _askable(facts: DataFrame, seed: str, must_multi: list[str], must_single: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All questions, not written yet, with the keys of their caps; what gives those of some of them that stand: with three distractors, and not giving their answer away."""
    f = written(prepared(facts, must_multi, must_single), "facts")
    p, m = items.values_of(pools(f)), written(memberships(facts), "members")
    # questions that agree in all that is hashed are still questions of their own, each with its own tier and saga
    q = asked(f).withColumnRenamed("id", "salt").withColumn("id", F.monotonically_increasing_id())
    q = q.withColumn("answer_key", F.concat_ws("|", "category", X.norm_key(F.col("answer")))).withColumn("entity", F.col("title"))

    def fit(c: DataFrame) -> DataFrame:
        c = c.where(~F.col("saga_bound") | F.col("p_saga").isNull() | F.col("saga").isNull() | (F.col("p_saga") <= F.col("saga")))
        c = c.where(~F.array_contains("own", F.col("norm_v")))
        # who belongs to the crew can't stand beside the answer; members are many, so they are never sent to all executors
        return c.join(m.hint("merge"), F.col("members") & (X.norm_key(F.col("leak_ref")) == m["_crew"]) & (F.col("norm_v") == m["_member"]), "left_anti")

    def standing(some: DataFrame) -> DataFrame:
        # what ranking and fit() need of a question: each meets many values
        asks = some.select("id", "salt", "pool", "answer", "leak_ref", "tier", "saga", "saga_bound", "own", "members")
        d = items.nearest(asks, p, seed, keep=fit).where(F.size("distractors") == 3)
        return some.join(d, "id").where(items.unleaked(F.col("answer"), F.col("leak_ref"), F.col("distractors")))

    return q, standing


def generated(facts: DataFrame, seed: str = "bank|", must_multi: list[str] = X.MUST_KNOW_MULTI, must_single: list[str] = X.MUST_KNOW_SINGLE) -> DataFrame:
    """Every question that has three distractors and doesn't give its answer away, before the caps."""
    q, standing = _askable(facts, seed, must_multi, must_single)
    return standing(written(q, "asked"))


def bank(facts: DataFrame, seed: str = "bank|", must_multi: list[str] = X.MUST_KNOW_MULTI, must_single: list[str] = X.MUST_KNOW_SINGLE) -> DataFrame:
    """The generated questions within their caps, with options in hash order.

    Distractors are looked for as caps are spent: a question behind a full cap can't enter the bank whatever stands beside it, so it meets no values.
    """
    q, standing = _askable(facts, seed, must_multi, must_single)
    kept = items.capped(q, {"answer_key": "answer_cap", "entity": "entity_cap", "template": "template_cap"}, "ord", check=standing)
    options = items.shuffled(F.array_append("distractors", F.col("answer")), F.concat(F.lit(seed), F.col("question")))
    return kept.select(
        "category", F.lit("multiple").alias("type"), "difficulty", "question", F.col("answer").alias("correct_answer"), F.col("distractors").alias("incorrect_answers"), options.alias("options"), "source",
        "explainer", scores.saga_name(F.col("own_saga")).alias("saga"), F.col("own_saga").alias("sagaOrder"), F.lit(None).cast("string").alias("image"), "template",
    )
