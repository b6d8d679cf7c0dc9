"""Queries that write files and read them again, and that show single rules on the driver's rows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from .catalog import STOP
from .functions import scores
from .functions import text as X
from .operators import ratings, views
from .operators.views import answers, table, with_views
from .registry import query
from .reports import FLAGGED, _flagged
from .sources import tables
from .sources.tables import shared_dir


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


@query("SELECT c_custkey::INT AS \"difficultyScore\", c_name AS question, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'say \"' || c_mktsegment || '\" {' || c_custkey || '}' END AS explainer, c_name || '|' || chr(92) || '|]' AS options FROM customer")
def json_array_bank(spark, sf_dir):
    """A bank written as one JSON array in many parts, joined to a file, and that file read by many tasks."""
    c = table(spark, sf_dir, "customer")
    said = F.concat(F.lit('say "'), "c_mktsegment", F.lit('" {'), F.col("c_custkey").cast("string"), F.lit("}"))
    rows = c.select(F.col("c_custkey").cast("int").alias("difficultyScore"), F.col("c_name").alias("question"), F.when(F.col("c_custkey") % 3 != 0, said).alias("explainer"), F.array("c_name", F.lit("\\"), F.lit("]")).alias("options"))
    parts, whole = _path(spark, "bank"), f"{_path(spark, 'bank')}.json"
    tables.write_json_array(rows, parts, ["difficultyScore"])
    tables.joined(spark, parts, whole)
    return tables.json_array(spark, whole).select("difficultyScore", "question", "explainer", F.array_join("options", "|").alias("options"))


@query("SELECT c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'https://x.example/' || c_custkey || '}' END AS url FROM customer")
def json_map_images(spark, sf_dir):
    """An image cache kept as JSON objects: a null url means that none exists."""
    c = table(spark, sf_dir, "customer")
    url = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("https://x.example/"), F.col("c_custkey").cast("string"), F.lit("}")))
    entry = F.concat(X.json_string(F.col("c_name")), F.lit(": "), F.coalesce(X.json_string(url), F.lit("null")))
    objects = c.groupBy("c_nationkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ",\n "), F.lit("}")).alias("value"))
    path = _path(spark, "images")
    objects.write.partitionBy("c_nationkey").text(path)
    return tables.json_map(spark, f"{path}/c_nationkey=*", "string").select(F.col("key").alias("title"), F.col("value").alias("url"))


@query("SELECT c_nationkey AS nation, md5(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS md5 FROM customer GROUP BY c_nationkey")
def file_digests(spark, sf_dir):
    """Digests of files, one per nation."""
    path = _path(spark, "names")
    table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    return tables.file_md5(spark, f"{path}/c_nationkey=*/*.txt").select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation"), "md5")


@query("SELECT COUNT(*) AS n, SUM(c_custkey)::BIGINT AS total, TRUE AS refused FROM customer")
def guarded_write(spark, sf_dir):
    """A table that is written since it has rows and no faults, and one that isn't."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    path = _path(spark, "guarded")
    tables.write_guarded(c, lambda df: df.write.parquet(path), c.where("c_custkey < 0"))
    try:
        tables.write_guarded(c, lambda df: df.write.mode("overwrite").parquet(path), c.where("c_custkey = 1"))
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total")).withColumn("refused", F.lit(refused))


@query("SELECT LEAST(50, COUNT(*)) AS n, LEAST(50, COUNT(*)) AS titles, 0::BIGINT AS untitled FROM customer")
def limited_pages(spark, sf_dir):
    """The first pages that a scan of a dump meets; the limit is the feature."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.lit("0").alias("ns"), F.struct(F.col("c_mktsegment").alias("text")).alias("revision"))
    path = _path(spark, "dump")
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return tables.pages(spark, path, 50, ("title",)).agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.count_if(F.col("title").isNull()).alias("untitled"))


@query(with_views("answers", body="SELECT category, COUNT(*) AS n, 2::BIGINT AS asked FROM answers GROUP BY category"))
def remembered_load(spark, sf_dir):
    """A table that two askers share; it is loaded once."""
    name = f"answers of {sf_dir}"
    ask = lambda: tables.remembered(spark, name, lambda: answers(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")))
    both = ask().unionByName(ask())
    return both.groupBy("category").agg(F.max("n").alias("n"), F.count("*").alias("asked"))


@query(
    f"""WITH {FLAGGED}, rated AS (SELECT l_orderkey AS id, median(l_quantity::INT) AS m, COUNT(*) AS raters, COUNT(*) FILTER (l_discount > 0.05) AS votes FROM lineitem GROUP BY 1),
 base AS (SELECT f.id, flags, raters, votes, m, COALESCE(round_even(m, 0), CASE authored WHEN 'easy' THEN 20 WHEN 'medium' THEN 50 ELSE 80 END)::INT AS b, COALESCE(round_even(30 * votes / raters::DOUBLE, 0), 0)::INT AS p, CASE WHEN f.id % 5 = 0 THEN 30 WHEN f.id % 7 = 0 THEN 25 ELSE 0 END AS s FROM flagged f LEFT JOIN rated r ON f.id = r.id),
 s AS (SELECT *, GREATEST(0, LEAST(100, b - p - s)) AS raw FROM base)
 SELECT id, array_to_string(list_filter([CASE WHEN raters IS NULL THEN 'no ratings; holding the authored tier pending a rating pass' END, CASE WHEN votes > 0 THEN votes || '/' || raters || ' raters called it guessable' END,
  CASE WHEN s > 0 THEN 'signals: ' || array_to_string(list_filter(flags, lambda x: x IN ('stem_leak', 'numeric_ladder')), ', ') || ' (-' || s || ')' END,
  CASE WHEN id % 2 = 0 AND raw > 66 AND NOT COALESCE(m >= 70, FALSE) THEN 'capped at 66: headline subject (' || CASE WHEN id % 4 = 0 THEN '"O''Nami ' || id || '"' ELSE '''Nami ' || id || '''' END || ') without strong rater support' END], lambda x: x IS NOT NULL), ' / ') AS reasons FROM s"""
)
def explained_scores(spark, sf_dir):
    """Why an item has its score."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rater"), F.col("l_quantity").cast("int").alias("knowledge_score"), (F.col("l_discount") > 0.05).alias("guessable"))
    i = F.col("id")
    subject = F.concat(F.when(i % 4 == 0, "O'Nami ").otherwise("Nami "), i.cast("string"))
    items = _flagged(spark, sf_dir).withColumn("must_know", i % 2 == 0).withColumn("subject", subject)
    return ratings.scored(items, r, "id").select("id", F.array_join("reasons", " / ").alias("reasons"))


WORD_SQL = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + STOP + ", w)))"
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) >= 3))"


@query(
    with_views(
        "entities",
        body=f""", q AS (SELECT ord AS id, CASE ord % 3 WHEN 0 THEN 'Who builds furnishings and machines?' WHEN 1 THEN 'Who is automatic?' ELSE 'Who said ' || lower(occupation) || '?' END AS question, CASE WHEN ord % 4 = 0 THEN occupation ELSE title END AS answer, occupation || ' ' || region AS gloss FROM entities)
 SELECT id, len(list_filter({WORD_SQL.format('gloss')}, lambda w: length(w) >= 4 AND NOT list_contains({WORD_SQL.format('answer')}, w) AND contains(lower(question), substring(w, 1, 5)))) > 0 AS leaks FROM q""",
    )
)
def gloss_leaks(spark, sf_dir):
    """Questions that translate their answer: a word of its gloss stands in them."""
    o = F.col("ord")
    question = F.when(o % 3 == 0, "Who builds furnishings and machines?").when(o % 3 == 1, "Who is automatic?").otherwise(F.concat(F.lit("Who said "), F.lower("occupation"), F.lit("?")))
    answer = F.when(o % 4 == 0, F.col("occupation")).otherwise(F.col("title"))
    return views.entities(spark, sf_dir).select(o.alias("id"), X.gloss_leak(question, answer, F.concat_ws(" ", "occupation", "region")).alias("leaks"))


@query(
    with_views(
        "entities",
        body=f""", q AS (SELECT ord AS id, lower(occupation) || ' of ' || region || ' and the ' || origin AS ref, CASE WHEN ord % 2 = 0 THEN occupation || 's' ELSE origin END AS v FROM entities)
 SELECT id, array_to_string(list_filter({TOKENS.format('ref')}, lambda t: list_contains({TOKENS.format('v')}, t) OR (length(t) >= 4 AND len(list_filter({TOKENS.format('v')}, lambda s: contains(s, t))) > 0)), ',') AS leaked FROM q""",
    )
)
def leaked_tokens(spark, sf_dir):
    """The tokens of a question that its answer shows again, whole or inside a longer one."""
    ref = F.concat(F.lower("occupation"), F.lit(" of "), "region", F.lit(" and the "), "origin")
    v = F.when(F.col("ord") % 2 == 0, F.concat("occupation", F.lit("s"))).otherwise(F.col("origin"))
    return views.entities(spark, sf_dir).select(F.col("ord").alias("id"), F.array_join(X.leaked(ref, v), ",").alias("leaked"))


NAMES = ["Nami", "Usopp's hat", "Big Mom", "The big mother", "Ace in the hole", "Placement", "monkey D. Luffy", "Trafalgar Law", "Nobody", "Sanjiro"]


@query(
    "SELECT c_custkey AS id, title, EXISTS (SELECT 1 FROM (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in X.MUST_KNOW_MULTI)
    + "]) AS m) WHERE contains(lower(title), m)) OR len(list_intersect(regexp_extract_all(lower(title), '[a-z]+'), ["
    + ", ".join(f"'{x}'" for x in X.MUST_KNOW_SINGLE)
    + "])) > 0 AS known, CASE WHEN (EXISTS (SELECT 1 FROM (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in X.MUST_KNOW_MULTI)
    + "]) AS m) WHERE contains(lower(title), m)) OR len(list_intersect(regexp_extract_all(lower(title), '[a-z]+'), ["
    + ", ".join(f"'{x}'" for x in X.MUST_KNOW_SINGLE)
    + "])) > 0) OR c_custkey * 100 >= 20000 THEN 2 WHEN c_custkey * 100 >= 6000 THEN 1 ELSE 0 END AS prominence FROM (SELECT c_custkey, ["
    + ", ".join("'" + x.replace("'", "''") + "'" for x in NAMES)
    + "][1 + c_custkey % 10] || ' ' || c_custkey AS title FROM customer)"
)
def must_know_names(spark, sf_dir):
    """Names that everyone is expected to know, as words or parts of titles, and the prominence that they give."""
    title = F.concat(F.element_at(X.literals(NAMES), (1 + F.col("c_custkey") % 10).cast("int")), F.lit(" "), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), title.alias("title"))
    known = X.must_know(F.col("title"))
    return rows.select("id", "title", known.alias("known"), scores.prominence(known, F.col("id") * 100).cast("int").alias("prominence"))
