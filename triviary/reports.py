"""Queries from pages to facts and from facts to a bank, over the driver's tables; of profiles, requests and raters; of formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import AUTHORED, SAGA_SQL, _authored, _flags, K, NOISE_SQL, SEED
from .functions import scores
from .functions import text as X
from .operators import bank as checks
from .operators import play, ratings, signals, views
from .operators.views import answers, table, with_views
from .plans import bank, quiz
from .registry import query
from .sources import tables
from .sources.tables import shared_dir, written
from .streaming import mastery

SAGA = "[" + ", ".join(f"'{s}'" for s in scores.SAGA_NAMES) + "]"
KIND = "CASE WHEN ord % 10 < 6 THEN 'character' WHEN ord % 10 < 9 THEN 'location' ELSE 'devil_fruit' END"
BOUNTY = "CAST(CAST(FLOOR(ABS(bounty) * 1000) AS BIGINT) AS VARCHAR)"
#: What is left of views.facts() once it is cleaned, canon alone.
PREPARED = f"""prepared AS (SELECT *, {SAGA}[saga] AS saga_name, COUNT(*) FILTER (kind = 'character') OVER (PARTITION BY {K('occupation')}) AS occupation_n, COUNT(*) FILTER (kind = 'character') OVER (PARTITION BY {K('origin')}) AS origin_n, COUNT(*) FILTER (kind = 'location') OVER (PARTITION BY {K('region')}) AS region_n FROM (
 SELECT ord, title, kind, article_len, prominence::INT AS prominence, {SAGA_SQL} AS saga, CASE WHEN ord % 2 = 0 THEN 'About ' || title END AS summary, 'https://site.example/wiki/' || ord AS source,
 CASE WHEN kind = 'character' THEN CASE WHEN ord % 8 = 1 THEN origin || ' Fruit / ' || origin || ' no Mi' WHEN ord % 4 = 1 THEN origin || ' Fruit' WHEN ord % 8 = 3 THEN origin || ' no Mi' END END AS df_name,
 CASE WHEN kind = 'devil_fruit' AND ord % 20 = 9 THEN origin || ' Rare' ELSE title END AS fruit_name,
 CASE WHEN kind = 'character' AND length({BOUNTY}) >= 4 THEN {BOUNTY} || ' Berries' END AS bounty,
 CASE WHEN kind = 'character' THEN occupation END AS occupation, CASE WHEN kind = 'character' THEN origin || CASE WHEN ord % 5 = 0 THEN ' Kingdom' ELSE '' END END AS origin,
 CASE WHEN kind = 'character' THEN origin || ' Town' END AS residence, CASE WHEN kind = 'devil_fruit' THEN origin || ' Eater' END AS user, CASE WHEN kind = 'location' THEN region || ' Sea' END AS region,
 CASE WHEN kind = 'location' AND ord % 3 = 0 THEN region || ' Kingdom' END AS kingdom, CASE WHEN kind = 'location' AND ord % 3 = 0 THEN region || ' Kingdom' WHEN kind = 'character' AND ord % 5 = 0 THEN origin || ' Kingdom' END AS any_kingdom,
 CASE WHEN kind = 'location' AND ord % 3 = 0 THEN region || ' Kingdom' WHEN kind <> 'devil_fruit' THEN origin || ' Guild' END AS affiliation
 FROM (SELECT *, {KIND} AS kind, ord % 1200 AS chapter FROM entities WHERE ord % 13 <> 0 AND ord % 17 <> 0 AND ord % 23 <> 0)))"""
COLUMNS = ["title", "kind", "prominence", "article_len", "saga", "saga_name", "df_name", "fruit_name", "bounty", "occupation", "origin", "residence", "user", "region", "kingdom", "any_kingdom", "affiliation"]


def _prepared(spark, sf_dir):
    return written(bank.prepared(views.facts(spark, sf_dir)), "facts")


@query(with_views("entities", body=f", {PREPARED} SELECT {', '.join(COLUMNS)}, CASE WHEN kind = 'character' THEN occupation_n END AS occupation_n, CASE WHEN kind = 'character' THEN origin_n END AS origin_n, CASE WHEN kind = 'location' THEN region_n END AS region_n FROM prepared"))
def canon_facts(spark, sf_dir):
    """Canon filter, cleaned fields and value frequencies."""
    return _prepared(spark, sf_dir).select(*COLUMNS, "occupation_n", "origin_n", "region_n")


def _asked_sql(name: str, kind: str, category: str, text: str, fact: str, answer: str, depth: int, cap: int = 6, guard: str = "TRUE") -> str:
    level = f"CASE WHEN prominence - {depth} >= 2 THEN 'easy' WHEN prominence - {depth} = 1 THEN 'medium' ELSE 'hard' END"
    return f"SELECT '{name}' AS template, '{category}' AS category, title, {text} AS question, {answer} AS answer, {fact} || '.' || COALESCE(' ' || summary, '') AS explainer, {level} AS difficulty, {cap} AS answer_cap, CASE prominence WHEN 2 THEN 10 WHEN 1 THEN 5 ELSE 2 END AS entity_cap FROM prepared WHERE kind = '{kind}' AND {answer} IS NOT NULL AND {guard}"


CREW, ARC, GEO, NOTED = "Crews & Organizations", "Arcs & Story", "Geography", "prominence >= 1"
ASKED = " UNION ALL ".join(
    [
        _asked_sql("char_df", "character", "Devil Fruits", "'Which Devil Fruit did ' || title || ' eat?'", "title || '''s Devil Fruit is the ' || df_name", "df_name", 0),
        _asked_sql("char_affiliation", "character", CREW, "'Which crew or organization is ' || title || ' affiliated with?'", "title || ' is affiliated with the ' || affiliation", "affiliation", 0),
        _asked_sql("char_bounty", "character", "Bounties", "'What is ' || title || '''s known bounty?'", "title || '''s known bounty is ' || bounty", "bounty", 0),
        _asked_sql("char_occupation", "character", "Characters", "'What is ' || title || '''s occupation?'", "title || '''s occupation is ' || occupation", "occupation", 0, guard="occupation_n >= 2"),
        _asked_sql("char_origin", "character", "Characters", "'Where does ' || title || ' originate from?'", "title || ' originates from ' || origin", "origin", 1, guard="origin_n >= 2"),
        _asked_sql("char_residence", "character", GEO, "'Where does ' || title || ' reside?'", "title || ' resides in ' || residence", "residence", 1),
        _asked_sql("crew_member", "character", CREW, "'Which of these characters is a member of the ' || affiliation || '?'", "title || ' is a member of the ' || affiliation", "title", 1, guard=NOTED),
        _asked_sql("bounty_reverse", "character", "Bounties", "'Which character has a known bounty of ' || bounty || '?'", "title || ' has a known bounty of ' || bounty", "title", 1, guard=f"bounty IS NOT NULL AND {NOTED}"),
        _asked_sql("char_saga", "character", ARC, "'In which saga does ' || title || ' first appear?'", "title || ' first appears in the ' || saga_name || ' Saga'", "saga_name", 1, 14, NOTED),
        _asked_sql("fruit_user", "devil_fruit", "Devil Fruits", "'Who is the user of the ' || fruit_name || '?'", "'The ' || fruit_name || ' is eaten by ' || user", "user", 0),
        _asked_sql("loc_region", "location", GEO, "'In which region of the world is ' || title || ' located?'", "title || ' is located in ' || region", "region", 1, guard="region_n >= 2"),
        _asked_sql("loc_kingdom", "location", GEO, "'Which kingdom does ' || title || ' belong to?'", "title || ' belongs to the ' || kingdom", "kingdom", 1),
        _asked_sql("loc_saga", "location", ARC, "'In which saga does ' || title || ' first appear?'", "title || ' first appears in the ' || saga_name || ' Saga'", "saga_name", 1, 14, NOTED),
    ]
)


@query(with_views("entities", body=f", {PREPARED} {ASKED}"))
def template_questions(spark, sf_dir):
    """All thirteen shapes over the canon facts, with their statements and levels."""
    return bank.asked(_prepared(spark, sf_dir)).select("template", "category", "title", "question", "answer", "explainer", "difficulty", "answer_cap", "entity_cap")


POOLED = [("df_name", "df_name", "character"), ("affiliation", "affiliation", "character"), ("bounty", "bounty", "character"), ("residence", "residence", "character"), ("occupation", "occupation", "character"), ("origin", "origin", "character"), ("region", "region", "location"), ("kingdom", "any_kingdom", None), ("fruit_user", "user", "devil_fruit"), ("name", "title", "character"), ("bounty_holder", "title", "character")]
LEAST = {"occupation": "occupation_n >= 2", "origin": "origin_n >= 2", "region": "region_n >= 2", "bounty_holder": "bounty IS NOT NULL"}
POOL_SQL = " UNION ALL ".join(f"SELECT '{p}' AS pool, {v} AS v, {K(v)} AS norm_v, prominence AS tier, saga FROM prepared WHERE {f'kind = {chr(39)}{k}{chr(39)}' if k else 'TRUE'} AND {v} IS NOT NULL AND {LEAST.get(p, 'TRUE')} QUALIFY ROW_NUMBER() OVER (PARTITION BY {K(v)} ORDER BY {'kind DESC' if not k else '1'}, ord) = 1" for p, v, k in POOLED)


@query(with_views("entities", body=f", {PREPARED} SELECT * FROM ({POOL_SQL}) UNION ALL SELECT 'saga', s, {K('s')}, NULL, NULL FROM (SELECT unnest({SAGA}) AS s)"))
def bank_pools(spark, sf_dir):
    return bank.pools(_prepared(spark, sf_dir))


@query()
def bank_questions(spark, sf_dir):
    """Facts to a bank with distractors, leak test and caps; without SQL, tests hold it against plain rules."""
    return bank.bank(views.facts(spark, sf_dir)).drop("image")


@query(
    with_views(
        "entities",
        body="""SELECT title, 'character' AS kind, 'w/' || replace(title, '#', '#') AS source, ord % 5 = 0 AS tabbed, CASE WHEN ord % 5 = 0 THEN origin ELSE origin || '|' || region END AS origin, occupation, CASE WHEN ord % 5 = 0 THEN 3 ELSE 2 END AS n_fields,
 (283 + length(title) + 2 * length(origin) + length(region) + length(occupation))::BIGINT AS article_len, title || ' is a merchant from ' || origin || '. Sells goods.' AS summary FROM entities""",
    )
)
def wiki_facts(spark, sf_dir):
    """Pages to facts: infoboxes, tabs, templates, fields, the article's length and its lead."""
    f = bank.facts_of(views.pages(spark, sf_dir), "w/")
    line = lambda k: F.array_join(F.try_element_at("fields", F.lit(k)), "|")
    return f.select("title", "kind", "source", "tabbed", line("origin").alias("origin"), line("occupation").alias("occupation"), F.size("fields").alias("n_fields"), "article_len", "summary")


@query("SELECT title, ns, text FROM (SELECT c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '10' ELSE '0' END AS ns, c_mktsegment || ' & <' || c_nationkey || '>' AS text FROM customer)")
def xml_pages(spark, sf_dir):
    """A dump written and scanned again."""
    from uuid import uuid4

    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "10").otherwise("0").alias("ns"), F.struct(F.concat("c_mktsegment", F.lit(" & <"), F.col("c_nationkey").cast("string"), F.lit(">")).alias("text")).alias("revision"))
    path = f"{shared_dir(spark)}/dump-{uuid4().hex}"
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return tables.pages(spark, path, 0)


@query(f"SELECT CASE WHEN c_custkey % 4 = 0 THEN 'talk' ELSE '' END || {K('c_name')} AS key FROM customer WHERE c_custkey % 8 <> 0")
def page_titles(spark, sf_dir):
    """The keys of a dump's titles; talk pages of the named namespaces fall out, those of articles are keys like others."""
    from uuid import uuid4

    k = F.col("c_custkey")
    name = F.when(k % 8 == 0, "User talk:").when(k % 4 == 0, "Talk:").otherwise("")
    path = f"{shared_dir(spark)}/titles-{uuid4().hex}"
    table(spark, sf_dir, "customer").select(F.concat(F.lit("  <title>"), name, F.col("c_name"), F.lit("</title>"))).write.text(path)
    return tables.titles(spark, path)


@query(with_views("entities", body="SELECT title, kind, origin, occupation FROM (SELECT title, 'character' AS kind, ord, origin || '|' || region AS origin, occupation FROM entities)"))
def json_facts(spark, sf_dir):
    """Facts written as JSON lines, a field as a string or as a list, and read again."""
    from uuid import uuid4

    e = views.entities(spark, sf_dir)
    path = f"{shared_dir(spark)}/facts-{uuid4().hex}"
    tables.write_json_lines(e.select("title", F.lit("character").alias("kind"), F.struct(F.array("origin", "region").alias("origin"), "occupation").alias("fields")), path)
    line = lambda k: F.array_join(F.try_element_at("fields", F.lit(k)), "|")
    return tables.facts(spark, path).select("title", "kind", line("origin").alias("origin"), line("occupation").alias("occupation"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS value FROM customer")
def checkpointed_upsert(spark, sf_dir):
    """A keyed table after three saved batches; later ones replace the rows of their keys."""
    from uuid import uuid4

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    path = f"{shared_dir(spark)}/upsert-{uuid4().hex}"
    return tables.upserted(spark, path, [c.withColumn("value", F.lit("first")), c.where("key % 2 = 0").withColumn("value", F.lit("second")), c.where("key % 3 = 0").withColumn("value", F.lit("third"))], ["key"])


@query("SELECT doc_id, COALESCE(quality, -1)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def keyed_lookup(spark, sf_dir):
    """A keyed store, written and read with a default."""
    from uuid import uuid4

    path = f"{shared_dir(spark)}/store-{uuid4().hex}"
    tables.write_keyed(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id", path)
    return tables.looked_up(table(spark, sf_dir, "documents").select("doc_id"), spark.read.parquet(path), "doc_id", "quality", F.lit(-1))


@query("SELECT kind, n FROM (SELECT lang AS kind, COUNT(*) AS n FROM documents GROUP BY lang)")
def count_by_kind(spark, sf_dir):
    return checks.counted(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind")), "kind")


@query(f"SELECT k AS key, src, doc_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY rank, doc_id) AS r FROM (SELECT {K('text')} AS k, 'curated' AS src, 0 AS rank, item_id AS doc_id FROM benchmark UNION ALL SELECT {K('text')}, 'generated', 1, doc_id FROM documents)) WHERE r = 1")
def curated_first(spark, sf_dir):
    """Two banks as one; a curated question wins over a generated one of the same key."""
    curated = table(spark, sf_dir, "benchmark").select(X.norm_key(F.col("text")).alias("key"), F.lit("curated").alias("src"), F.col("item_id").alias("doc_id"))
    made = table(spark, sf_dir, "documents").select(X.norm_key(F.col("text")).alias("key"), F.lit("generated").alias("src"), "doc_id")
    return checks.combined([curated, made], F.col("key"), "doc_id")


@query("SELECT title FROM (SELECT DISTINCT string_split(url, '/')[-1] AS title FROM pages) WHERE title <> '' AND title NOT IN (SELECT string_split(url, '/')[-1] FROM pages WHERE page_id % 3 = 0)")
def subjects_to_fetch(spark, sf_dir):
    """Distinct subjects that an image cache lacks; one that is known to have no image isn't asked for again."""
    p = table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("title"))
    cache = p.where("page_id % 3 = 0").select("title", F.when(F.col("page_id") % 2 == 0, "u").alias("url")).distinct()
    return checks.unasked(p, cache, "title")


@query("SELECT c_custkey AS hash FROM (SELECT *, ['easy', 'medium', 'hard'][1 + c_custkey % 3] AS authored FROM customer) WHERE regexp_matches(c_name, '(?i)customer#0*[1-9]+$') AND authored = 'hard' AND c_custkey % 4 <> 0")
def items_to_rate(spark, sf_dir):
    """Pattern, difficulty and missing ratings of three raters."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hash"), F.col("c_name").alias("question"), F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (1 + F.col("c_custkey") % 3).cast("int")).alias("authored"))
    names = ["a", "b", "c"]
    done = c.select("hash", F.explode(F.when(F.col("hash") % 4 == 0, X.literals(names)).when(F.col("hash") % 4 == 1, X.literals(names[:2])).otherwise(F.array().cast("array<string>"))).alias("rater"))
    return ratings.chosen(c, done, names, "CUSTOMER#0*[1-9]+$", "hard", True).select("hash")


@query("SELECT conv_id, array_to_string(list_sort(list_filter(list_distinct(list(role)), lambda r: r NOT IN ('user', 'system'))), ',') AS unknown FROM conversations GROUP BY conv_id")
def unknown_raters(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return asked.select("conv_id", F.array_join(ratings.unknown(F.col("r"), X.literals(["user", "system"])), ",").alias("unknown"))


@query("SELECT l_linenumber::VARCHAR AS rater, COUNT(*) AS skipped FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_linenumber")
def verdicts_skipped(spark, sf_dir):
    """Verdicts of batches that the manifest doesn't have."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.lit(1).alias("n"), F.col("l_linenumber").cast("string").alias("rater"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("batch"), F.lit(1).alias("n"))
    return ratings.skipped(v, known)


@query("SELECT rater, COUNT(*) AS n, SUM(score)::BIGINT AS total FROM (SELECT l_linenumber::VARCHAR AS rater, LEAST(100, l_quantity::INT * 3) AS score FROM lineitem WHERE l_orderkey % 5 <> 0) GROUP BY rater")
def verdicts_imported(spark, sf_dir):
    """Verdicts under the hash of their item, scores held between 0 and 100."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.lit(1).alias("n"), F.col("l_linenumber").cast("string").alias("rater"), (F.col("l_quantity").cast("int") * 3).alias("knowledge_score"), F.lit(False).alias("guessable"), F.lit(None).cast("string").alias("reason"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("batch"), F.lit(1).alias("n"), F.col("o_orderkey").alias("hash"))
    return ratings.imported(v, known).groupBy("rater").agg(F.count("*").alias("n"), F.sum("knowledge_score").cast("bigint").alias("total"))


@query("SELECT l_partkey % 7 AS kind, COUNT(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY 1")
def stale_ratings(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), (F.col("l_partkey") % 7).alias("kind"))
    return ratings.stale(r, table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("hash"))).groupBy("kind").agg(F.count("*").alias("n"))


FLAGGED = f"flagged AS (SELECT doc_id AS id, {AUTHORED} AS authored, CASE WHEN doc_id % 5 = 0 THEN ['stem_leak', 'cross_domain'] WHEN doc_id % 7 = 0 THEN ['numeric_ladder'] WHEN doc_id % 11 = 0 THEN ['gloss_leak'] ELSE [] END AS flags, CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS guess FROM documents)"


def _flagged(spark, sf_dir):
    i = F.col("doc_id")
    flags = F.when(i % 5 == 0, X.literals(["stem_leak", "cross_domain"])).when(i % 7 == 0, X.literals(["numeric_ladder"])).when(i % 11 == 0, X.literals(["gloss_leak"])).otherwise(F.array().cast("array<string>"))
    return _authored(spark, sf_dir).select(i.alias("id"), F.col("difficulty").alias("authored"), flags.alias("flags")).withColumn("guessability_flags", F.array_intersect("flags", X.literals(signals.GUESSABILITY)))


@query(f"WITH {FLAGGED} SELECT authored, COUNT(*) AS total, COUNT(*) FILTER (guess > 0) AS guessable, ROUND(100 * COUNT(*) FILTER (guess > 0) / COUNT(*)::DOUBLE, 0) AS share FROM flagged GROUP BY authored")
def guessable_share(spark, sf_dir):
    return signals.guessable_share(_flagged(spark, sf_dir))


@query(f"WITH {FLAGGED} SELECT id, authored FROM flagged WHERE authored = 'hard' AND guess > 0 ORDER BY guess DESC, id LIMIT 15")
def worst_offenders(spark, sf_dir):
    """A report of the first fifteen."""
    return signals.offenders(_flagged(spark, sf_dir), 15).select("id", "authored")


@query(f"WITH {FLAGGED} SELECT f AS flag, authored, COUNT(*) AS n FROM (SELECT unnest(flags) AS f, authored FROM flagged) GROUP BY ALL")
def flag_counts(spark, sf_dir):
    return ratings.flag_counts(_flagged(spark, sf_dir))


@query(
    f"""WITH {FLAGGED}, rated AS (SELECT l_orderkey AS id, median(l_quantity::INT) AS m, MAX(l_quantity::INT) - MIN(l_quantity::INT) AS spread, COUNT(*) AS raters, COUNT(*) FILTER (l_discount > 0.05) AS votes FROM lineitem GROUP BY 1),
 base AS (SELECT f.id, authored, raters, COALESCE(spread, 0)::INT AS spread, COALESCE(round_even(m, 0), CASE authored WHEN 'easy' THEN 20 WHEN 'medium' THEN 50 ELSE 80 END)::INT AS b, COALESCE(round_even(30 * votes / raters::DOUBLE, 0), 0)::INT AS p, CASE WHEN f.id % 5 = 0 THEN 30 WHEN f.id % 7 = 0 THEN 25 ELSE 0 END AS s FROM flagged f LEFT JOIN rated r ON f.id = r.id),
 s AS (SELECT *, GREATEST(0, LEAST(100, b - p - s)) AS raw FROM base)
 SELECT id, score::INT AS score, CASE WHEN score <= 33 THEN 'easy' WHEN score <= 66 THEN 'medium' ELSE 'hard' END AS tier, CASE WHEN raters IS NULL THEN 'authored' ELSE 'raters' END AS basis, spread FROM (SELECT *, CASE WHEN id % 2 = 0 AND raw > 66 AND NOT (raters IS NOT NULL AND b >= 70) THEN 66 ELSE raw END AS score FROM s)"""
)
def difficulty_scores(spark, sf_dir):
    """Raters, priors, signals, clamps and the ceiling of headline facts."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rater"), F.col("l_quantity").cast("int").alias("knowledge_score"), (F.col("l_discount") > 0.05).alias("guessable"))
    items = _flagged(spark, sf_dir).withColumn("must_know", F.col("id") % 2 == 0)
    return ratings.scored(items, r, "id").select("id", "score", "tier", "basis", "spread")


# -- what is known of options

SET_QUIZ = """facts AS (SELECT title, ['character', 'location', 'devil_fruit'][1 + ord % 3] AS kind, origin || ' (former), The ' || region AS origin, occupation || '; ' || CASE WHEN ord % 2 = 0 THEN 'Cook' ELSE '.x' END AS occupation FROM entities),
 asked AS (SELECT ord AS id, CASE WHEN ord % 2 = 0 THEN title ELSE occupation END AS correct_answer,
  CASE ord % 4 WHEN 0 THEN [origin, 'NATION_1', 'NATION_2'] WHEN 1 THEN ['Zzz' || ord, 'The ' || region, 'Cook'] WHEN 2 THEN ['The Page ' || ord, 'the zzz', 'Yyy ' || ord] ELSE ['Customer#000000001', 'BUILDING', 'the the' || ord] END AS incorrect_answers FROM entities)"""
KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
PART = "trim(regexp_replace(p, '\\s*\\([^()]*\\)', '', 'g'), ' ;,.')"


@query(
    with_views(
        "entities",
        body=f""", {SET_QUIZ},
 titles AS (SELECT DISTINCT k FROM (SELECT {KEY.format("'Page ' || page_id")} AS k FROM pages) WHERE k <> ''),
 said AS (SELECT {KEY.format('title')} AS k, kind FROM facts UNION SELECT {KEY.format(PART)}, 'field:' || field FROM (SELECT 'origin' AS field, unnest(string_split_regex(origin, '[;,]')) AS p FROM facts UNION ALL SELECT 'occupation', unnest(string_split_regex(occupation, '[;,]')) FROM facts) WHERE length({PART}) >= 2 UNION SELECT {KEY.format('correct_answer')}, 'answer' FROM asked),
 kinds AS (SELECT k, list_sort(list(kind)) AS kinds FROM said GROUP BY k),
 entity AS (SELECT k FROM titles UNION SELECT {KEY.format('title')} FROM facts),
 o AS (SELECT id, i, options[i] AS o FROM (SELECT id, list_prepend(correct_answer, incorrect_answers) AS options, unnest(range(1, 5)) AS i FROM asked)),
 seen AS (SELECT id, i, COALESCE(kinds, []) AS kinds, kinds IS NOT NULL OR t.k IS NOT NULL OR b.k IS NOT NULL AS known, e.k IS NOT NULL AS page FROM o LEFT JOIN kinds ON {KEY.format('o')} = kinds.k LEFT JOIN titles t ON {KEY.format('o')} = t.k LEFT JOIN titles b ON regexp_replace({KEY.format('o')}, '^the', '') = b.k LEFT JOIN entity e ON {KEY.format('o')} = e.k),
 own AS (SELECT id, kinds, page FROM seen WHERE i = 1),
 others AS (SELECT id, COUNT(*) FILTER (NOT known) AS unattested, list(kinds) AS ks, string_agg(known::VARCHAR, ',' ORDER BY i) AS found FROM seen WHERE i > 1 GROUP BY id)
 SELECT id, unattested, found, page AS is_entity, array_to_string(kinds, ',') AS as_kinds, len(kinds) > 0 AND len(list_filter(ks, lambda k: len(k) = 0)) = 0 AND len(list_filter(ks, lambda k: len(list_intersect(k, kinds)) > 0)) = 0 AND len(list_intersect(list_intersect(ks[1], ks[2]), ks[3])) > 0 AS cross_domain FROM others JOIN own USING (id)""",
    )
)
def attestation(spark, sf_dir):
    """What facts, answers and the titles of all pages know of every option, and whether the wrong ones are of another kind."""
    e = views.entities(spark, sf_dir)
    o = F.col("ord")
    fields = F.create_map(F.lit("origin"), F.array(F.concat("origin", F.lit(" (former), The "), "region")), F.lit("occupation"), F.array(F.concat("occupation", F.lit("; "), F.when(o % 2 == 0, "Cook").otherwise(".x"))))
    f = e.select("title", F.element_at(X.literals(["character", "location", "devil_fruit"]), (1 + o % 3).cast("int")).alias("kind"), fields.alias("fields"))
    wrong = (
        F.when(o % 4 == 0, F.array("origin", F.lit("NATION_1"), F.lit("NATION_2")))
        .when(o % 4 == 1, F.array(F.concat(F.lit("Zzz"), o), F.concat(F.lit("The "), "region"), F.lit("Cook")))
        .when(o % 4 == 2, F.array(F.concat(F.lit("The Page "), o), F.lit("the zzz"), F.concat(F.lit("Yyy "), o)))
        .otherwise(F.array(F.lit("Customer#000000001"), F.lit("BUILDING"), F.concat(F.lit("the the"), o)))
    )
    q = e.select(o.alias("id"), F.when(o % 2 == 0, F.col("title")).otherwise(F.col("occupation")).alias("correct_answer"), wrong.alias("incorrect_answers"))
    q = q.withColumn("options", F.concat(F.array("correct_answer"), "incorrect_answers"))
    titles = table(spark, sf_dir, "pages").select(X.norm_key(F.concat(F.lit("Page "), "page_id")).alias("key")).distinct()
    seen = signals.attested(q, signals.vocabulary(f, q, titles, q))
    own, others = F.get("known", 0), F.slice("known", 2, 3)
    return seen.select(
        "id",
        F.size(F.filter(others, lambda k: ~k["known"])).cast("bigint").alias("unattested"),
        F.array_join(F.transform(others, lambda k: k["known"].cast("string")), ",").alias("found"),
        own["page"].alias("is_entity"),
        F.array_join(own["kinds"], ",").alias("as_kinds"),
        X.cross_domain(own["kinds"], F.transform(others, lambda k: k["kinds"])).alias("cross_domain"),
    )


@query(
    with_views(
        "entities",
        body="""SELECT d.doc_id AS id, e.article_len::BIGINT AS article_len, e.prominence::INT AS prominence, d.gloss FROM (SELECT doc_id, 'CUSTOMER 000000' || lpad((doc_id % 700)::VARCHAR, 3, '0') AS subject, CASE WHEN doc_id % 2 = 0 AND doc_id <= (SELECT MAX(ord) FROM entities) THEN 'word ' || doc_id END AS gloss FROM documents) d
 LEFT JOIN entities e ON regexp_replace(lower(e.title), '[^a-z0-9]', '', 'g') = regexp_replace(lower(d.subject), '[^a-z0-9]', '', 'g')""",
    )
)
def subject_facts(spark, sf_dir):
    """Questions with the length and prominence of their subject and the gloss of their answer."""
    i = F.col("doc_id")
    q = table(spark, sf_dir, "documents").select(i.alias("id"), F.concat(F.lit("CUSTOMER 000000"), F.lpad((i % 700).cast("string"), 3, "0")).alias("subject"), F.concat(F.lit("Customer#"), F.lpad(i.cast("string"), 9, "0")).alias("correct_answer"))
    e = views.entities(spark, sf_dir)
    f = e.select("title", F.col("article_len").cast("bigint").alias("article_len"), F.when(F.col("ord") % 2 == 0, F.map_from_arrays(F.array(F.lit("ename"), F.lit("meaning")), F.array(F.array(F.lit("word")), F.array(F.col("ord").cast("string"))))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))).alias("fields"))
    return signals.with_subjects(q, f).select("id", "article_len", "prominence", F.nullif(F.trim("gloss"), F.lit("")).alias("gloss"))


# -- profiles and requests


@query("SELECT c_custkey AS profile, CASE WHEN c_custkey % 9 = 0 THEN 'Player' WHEN c_custkey % 2 = 0 THEN substring(c_name || ' of the ' || c_mktsegment, 1, 24) ELSE c_name END AS name, ['#e03997', '#2185d0', '#21ba45', '#f2711c', '#6435c9', '#00b5ad', '#db2828', '#fbbd08'][1 + (c_custkey + 7) % 8] AS color FROM customer")
def profiles_created(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("profile"), (k - 1).alias("place"), F.when(k % 9 == 0, "   ").when(k % 2 == 0, F.concat(F.lit("  "), "c_name", F.lit(" of the "), "c_mktsegment")).otherwise(F.col("c_name")).alias("typed"))
    return play.created(c, "typed", "place").select("profile", F.rtrim("name").alias("name"), "color")


LEFT = "left_ AS (SELECT c_nationkey AS owner, c_custkey AS profile FROM customer WHERE c_custkey % 5 <> 0)"


@query(f"WITH {LEFT} SELECT c.owner, CASE WHEN c.profile % 5 <> 0 THEN c.profile ELSE f.first END AS active FROM (SELECT c_nationkey AS owner, MAX(c_custkey) AS profile FROM customer GROUP BY 1) c LEFT JOIN (SELECT owner, MIN(profile) AS first FROM left_ GROUP BY 1) f ON c.owner = f.owner")
def active_profiles(spark, sf_dir):
    """Profiles are deleted; who had one of them chosen falls back to the first that is left."""
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("profile"))
    chosen = p.groupBy("owner").agg(F.max("profile").alias("profile"))
    return play.active(play.removed(p, p.where("profile % 5 = 0")), chosen, "owner", "profile")


@query(with_views("answers", body="SELECT p.profile, d.difficulty, COALESCE(correct, 0)::BIGINT AS correct, COALESCE(total, 0)::BIGINT AS total FROM (SELECT DISTINCT profile FROM answers) p, (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty) d LEFT JOIN (SELECT profile, difficulty, SUM(point) AS correct, COUNT(*) AS total FROM answers WHERE profile % 2 = 0 AND difficulty <> 'hard' GROUP BY ALL) s ON s.profile = p.profile AND s.difficulty = d.difficulty"))
def progress_defaults(spark, sf_dir):
    """A partial save read with the counters that it lacks."""
    a = answers(spark, sf_dir)
    saved = a.where("profile % 2 = 0 and difficulty <> 'hard'").groupBy("profile", "difficulty").agg(F.sum("point").cast("bigint").alias("correct"), F.count("*").alias("total"))
    return play.defaulted(a.select("profile").distinct(), saved)


@query("SELECT event_id AS seq, CASE WHEN value < 5 THEN 'No answer' WHEN value < 15 THEN 'wrong' ELSE event_type END AS user_answer, CASE WHEN value >= 15 THEN 1 ELSE 0 END AS point FROM events")
def unanswered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("value") >= 15, F.col("event_type")).when(F.col("value") >= 5, "wrong")
    return play.recorded(e.select(F.col("event_id").alias("seq"), said.alias("user_answer"), F.col("event_type").alias("correct_answer"))).select("seq", "user_answer", "point")


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND {AUTHORED} = 'easy' AND (doc_id % 13 = 0 OR doc_id % 13 <= 4) ORDER BY md5('{SEED}' || doc_id), doc_id LIMIT 25")
def filtered_sample(spark, sf_dir):
    """Category, difficulty and spoiler bound (0 is no saga), then a uniform sample of 25."""
    i = F.col("doc_id")
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), (i % 13).alias("saga")).join(_authored(spark, sf_dir), "doc_id")
    return play.shuffled(play.matching(b, "en", "easy", 4), F.struct(F.md5(F.concat(F.lit(SEED), i.cast("string"))), i), 25).select("doc_id")


@query(f"WITH {quiz.SQL} SELECT id, array_to_string(list_transform(list_sort(list_transform(list_append(incorrect_answers, correct_answer), lambda o: {{'h': md5('{SEED}' || id || '|' || o), 'o': o}})), lambda s: s.o), '|') AS options FROM quiz WHERE len(incorrect_answers) = 3 AND correct_answer IS NOT NULL")
def rebuilt_options(spark, sf_dir):
    """Options made anew from the right and the wrong answers."""
    q = quiz.questions(spark, sf_dir).where((F.size("incorrect_answers") == 3) & F.col("correct_answer").isNotNull())
    return play.with_options(q.drop("options"), F.concat(F.lit(SEED), F.col("id").cast("string"))).select("id", F.array_join("options", "|").alias("options"))


def _streamed(spark, sf_dir, by):
    from uuid import uuid4

    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    out = f"{shared_dir(spark)}/counters-{uuid4().hex}"
    mastery.run_to_table(mastery.counters(views.answers_of(raw), by), f"{out}/rows", f"{out}/checkpoint")
    last = spark.read.parquet(f"{out}/rows").groupBy("profile", by).agg(F.max_by(F.struct("total", "correct"), "batch").alias("x"))
    return last.select("profile", by, "x.*")


@query(with_views("answers", body="SELECT profile, difficulty, COUNT(*) AS total, SUM(point)::BIGINT AS correct FROM answers GROUP BY ALL"))
def streaming_difficulty(spark, sf_dir):
    return _streamed(spark, sf_dir, "difficulty")


@query(with_views("answers", body="SELECT profile, category, COUNT(*) AS total, SUM(point)::BIGINT AS correct FROM answers WHERE category <> '' GROUP BY ALL"))
def streaming_category(spark, sf_dir):
    return _streamed(spark, sf_dir, "category")


@query(
    """SELECT o_orderkey AS id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS shown,
 CASE WHEN event AND chosen = 0 THEN 300 ELSE chosen END AS seconds, ['A.', 'B.', 'C.', 'D.', NULL][1 + (o_orderkey % 5)] AS letter, 'host/' || substring(lower(o_orderpriority), 1, 1) || '/' || substring(lower(o_orderpriority), 1, 2) || '/' || lower(o_orderpriority) || '_pages_current.xml.7z' AS dump
 FROM (SELECT *, o_orderkey * o_orderkey * 37 AS n, o_orderkey % 2 = 0 AS event, (o_orderkey % 3 * 60)::INT AS chosen FROM orders)"""
)
def formats(spark, sf_dir):
    """Bytes, clocks, letters and the address of a dump."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), scores.human_bytes(k * k * 37).alias("shown"), scores.quiz_seconds(k % 2 == 0, (k % 3 * 60).cast("int")).alias("seconds"), scores.letter((k % 5).cast("int")).alias("letter"), scores.dump_url("host", F.col("o_orderpriority")).alias("dump"))


@query("SELECT batch, 20 AS size, md5(string_agg(conv_id || ':' || turn, ',' ORDER BY i)) AS items FROM (SELECT *, 'b' || CASE WHEN i // 20 < 10 THEN '0' ELSE '' END || (i // 20) AS batch FROM (SELECT conv_id, turn, ROW_NUMBER() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)) GROUP BY batch")
def batch_manifest(spark, sf_dir):
    rows = checks.batches(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"]).select("batch", "n", F.concat_ws(":", "conv_id", "turn").alias("hash"), F.lit(None).cast("string").alias("key"))
    return checks.manifest(rows, ["a"]).select("batch", F.lit(20).alias("size"), F.md5(F.array_join(F.transform("items", lambda x: x["hash"]), ",")).alias("items"))


@query("SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'u' || page_id END AS image, CASE WHEN page_id % 5 < 2 THEN 'found' WHEN page_id % 5 < 4 THEN 'none' ELSE 'not asked' END AS image_state FROM pages")
def image_overlay(spark, sf_dir):
    """A known image, known to have none, never asked for."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("T"), "page_id").alias("t"))
    cache = p.where("page_id % 5 < 4").select(F.col("t").alias("title"), F.when(F.col("page_id") % 5 < 2, F.concat(F.lit("u"), "page_id")).alias("url"))
    return checks.with_images(p, cache, "t").select("page_id", "image", "image_state")


@query("SELECT 'A' || c_custkey AS title, CASE WHEN c_custkey % 2 = 0 THEN 'url' || (c_custkey + 1) WHEN c_custkey % 3 = 0 THEN 'url' || c_custkey END AS url FROM customer")
def alias_resolution(spark, sf_dir):
    """Titles that redirect to others, of several redirects the last, and titles that are found themselves."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("A"), k).alias("title"))
    to = c.where(k % 2 == 0)
    aliases = to.select(F.col("title").alias("alias"), F.lit("old").alias("title"), F.lit(1).alias("ord")).unionByName(to.select(F.col("title").alias("alias"), F.concat(F.lit("B"), k + 1).alias("title"), F.lit(2).alias("ord")))
    found = to.select(F.concat(F.lit("B"), k + 1).alias("title"), F.concat(F.lit("url"), k + 1).alias("url")).unionByName(c.where((k % 2 == 1) & (k % 3 == 0)).select("title", F.concat(F.lit("url"), k).alias("url")))
    return tables.resolved(c.select("title"), aliases, found)


@query(f"WITH {quiz.SQL} SELECT id, md5((id % 20 + 1) || '. ' || question || chr(10) || array_to_string(list_transform(options, lambda o, i: '   ' || ['A', 'B', 'C', 'D'][i] || ') ' || o), chr(10))) AS digest FROM quiz")
def rendered_items(spark, sf_dir):
    """Numbered questions with lettered options, as raters read them."""
    return quiz.questions(spark, sf_dir).select("id", F.md5(checks.rendered(F.col("id") % 20 + 1, F.col("question"), F.col("options"))).alias("digest"))


@query("SELECT event_id AS id, replace(trim(v), ',', '') AS number, CASE WHEN v LIKE '%twelve%' THEN TRUE ELSE FALSE END AS is_word, u AS unit FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1,' || (100 + event_id % 900) || ' Berries' WHEN 1 THEN 'twelve of them' ELSE (event_id % 50)::VARCHAR END AS said, CASE event_id % 3 WHEN 0 THEN '1,' || (100 + event_id % 900) WHEN 2 THEN (event_id % 50)::VARCHAR END AS v, CASE event_id % 3 WHEN 0 THEN 'berries' WHEN 2 THEN '' END AS u FROM events)")
def split_numbers(spark, sf_dir):
    """Values and units of answers, and whether these are words for numbers."""
    i = F.col("event_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("1,"), 100 + i % 900, F.lit(" Berries"))).when(i % 3 == 1, "twelve of them").otherwise((i % 50).cast("string"))
    e = table(spark, sf_dir, "events").select(i.alias("id"), said.alias("said"))
    n = X.split_number(F.col("said"))
    return e.select("id", n["value"].cast("bigint").cast("string").alias("number"), X.is_number_word(F.col("said")).alias("is_word"), n["unit"].alias("unit"))
