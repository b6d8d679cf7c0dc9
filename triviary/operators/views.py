"""The driver's tables as the engine's: answers, entities, ratings and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers_of(events: DataFrame) -> DataFrame:
    """The answer log: (profile, qid, category, difficulty, point, ts, seq)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        F.col("user_id").alias("profile"),
        (k % 10).alias("qid"),
        F.col("event_type").alias("category"),
        F.when(k % 3 == 0, "easy").when(k % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
        F.when(F.col("value") >= 15, 1).otherwise(0).alias("point"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_of(table(spark, sf_dir, "events"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities; nations and regions are fixed, small tables, orders are counted before the join."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, sf_dir, "customer")
    joined = c.join(nation, c.c_nationkey == nation.n_nationkey).join(orders, c.c_custkey == orders.o_custkey, "left")
    return joined.select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("occupation"),
        F.col("n_name").alias("origin"),
        F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("bounty"),
        (1000 * F.coalesce("n_orders", F.lit(0))).alias("article_len"),
        (1 + F.col("c_nationkey") % 11).alias("saga"),
    ).withColumn("prominence", scores.prominence(F.lit(False), F.col("article_len")))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater"), scores.clamp(F.floor(F.col("l_quantity") * 2)).cast("int").alias("knowledge_score"), (F.col("l_discount") > 0.05).alias("guessable"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as facts of a wiki: characters, places and fruits with the fields of their infoboxes; some aren't canon."""
    o, none = F.col("ord"), F.lit(None).cast("array<string>")
    kind = F.when(o % 10 < 6, "character").when(o % 10 < 9, "location").otherwise("devil_fruit")
    said = lambda *parts: F.array(F.concat(*[F.col(p[1:]) if p[0] == "$" else F.lit(p) for p in parts]))
    chapter = (o % 1200).cast("string")
    first = (
        F.when(o % 13 == 0, F.array(F.lit("Episode 5")))
        .when(o % 17 == 0, F.array(F.lit("One Piece Film: Z; Chapter 691 (cover)")))
        .when(o % 19 == 0, F.array(F.lit("Odyssey cameo"), F.concat(F.lit("Chapter "), chapter, F.lit("; Episode 3"))))
        .otherwise(F.array(F.lit("Episode 9"), F.concat(F.lit("Chapter "), chapter, F.lit(" (flashback)"))))
    )
    is_char, is_place, is_fruit = kind == "character", kind == "location", kind == "devil_fruit"
    fields = {
        "first": first,
        "affiliation": F.when(is_char & (o % 4 == 0), F.concat(F.array(F.lit("none")), said("Customer#000000001 (friend); ", "$origin", " Guild (former), ", "$region", " Kingdom")))
        .when(is_place & (o % 3 == 0), said("$region", " Kingdom (east)"))
        .when(~is_fruit, said("$origin", " Guild (former), ", "$region", " Kingdom")),
        "origin": F.when(is_char & (o % 5 == 0), said("$origin", " Kingdom")).when(is_char, F.concat(F.array(F.lit("None")), said("$origin", " (East)"))),
        "dfename": F.when(is_char & (o % 4 == 1), said("$origin", " Fruit (Paramecia)")),
        "dfname": F.when(is_char & (o % 8).isin(1, 3), said("$origin", " no Mi")),
        "bounty": F.when(is_char, F.array(F.lit("Unknown"), F.floor(F.abs("bounty") * 1000).cast("bigint").cast("string"))),
        "occupation": F.when(is_char, said("$occupation", " (retired), Other")),
        "residence": F.when(is_char, said("$region", " Port (former); ", "$origin", " Town")),
        "user": F.when(is_fruit, said("$origin", " Eater; Second")),
        "rname": F.when(is_fruit & (o % 20 == 9), said("$origin", " Rare (x)")),
        "region": F.when(is_place, said("$region", " Sea")),
    }
    made = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    title = F.concat("title", F.when(o % 23 == 0, " (Non-Canon)").otherwise(""))
    return entities(spark, sf_dir).select(title.alias("title"), kind.alias("kind"), F.concat(F.lit("https://site.example/wiki/"), o).alias("source"), F.lit(False).alias("tabbed"), made.alias("fields"), F.col("article_len").cast("long").alias("article_len"), F.when(o % 2 == 0, F.concat(F.lit("About "), "title")).alias("summary"), "ord")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as pages of a wiki: articles with an infobox and prose, and for some a tabbed box on a page of its own; talk pages have none."""
    o = F.col("ord")
    e = entities(spark, sf_dir)
    box = F.concat(F.lit("{{For|other uses}}\n{{Char Box\n|name=x\n|image=y.png\n|origin=[[Place|"), "origin", F.lit("]]<br/>{{Nihongo|{{Ruby|"), "region", F.lit("|r}}|k}}{{Qref|1}}\n|empty={{Ref|a}}\n|Occupation='''"), "occupation", F.lit("''';\n}}\n"))
    prose = F.concat(F.lit("'''"), "title", F.lit("''' is a {{w|Merchant|merchant}} from [["), "origin", F.lit("]] , also known as {{Ref|b}}. Sells goods () .\n\n== More ==\nOther text that isn't the lead."))
    article = e.select("title", F.lit("0").alias("ns"), F.concat(box, prose).alias("text"), (o * 2).alias("ord"))
    tabbed = e.where("ord % 5 = 0").select(F.concat(F.lit("Template:"), "title").alias("title"), F.lit("10").alias("ns"), F.concat(F.lit("{{Char Box|root=[["), "title", F.lit("]]|origin="), "origin", F.lit("|region="), "region", F.lit("|occupation="), "occupation", F.lit("}}")).alias("text"), (o * 2 + 1).alias("ord"))
    talk = e.select(F.concat(F.lit("Talk:"), "title").alias("title"), F.lit("1").alias("ns"), F.lit("{{Char Box|origin=x}}").alias("text"), (o * 2).alias("ord"))
    return article.unionByName(tabbed).unionByName(talk)


#: The same views for DuckDB.
SQL = {
    "answers": "answers AS (SELECT user_id AS profile, k % 10 AS qid, event_type AS category, CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN value >= 15 THEN 1 ELSE 0 END AS point, ts, event_id AS seq FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))",
    "entities": "entities AS (SELECT *, CASE WHEN article_len >= 20000 THEN 2 WHEN article_len >= 6000 THEN 1 ELSE 0 END AS prominence FROM (SELECT c_custkey AS ord, c_name AS title, c_mktsegment AS occupation, n_name AS origin, r_name AS region, c_acctbal AS bounty, 1000 * COALESCE(n_orders, 0) AS article_len, 1 + c_nationkey % 11 AS saga FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey))",
    "ratings": "ratings AS (SELECT l_orderkey AS item, l_linenumber AS rater, CAST(GREATEST(0, LEAST(100, FLOOR(l_quantity * 2))) AS INTEGER) AS knowledge_score, l_discount > 0.05 AS guessable FROM lineitem)",
}


def with_views(*names: str, body: str) -> str:
    """SQL over the views; a body that begins with a comma goes on with further ones."""
    return "WITH " + ", ".join(SQL[n] for n in names) + ("" if body.startswith(",") else " ") + body
