"""The driver's documents as quiz questions, for the queries on validation, signals and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.views import table

CATEGORIES = ["Characters", "Devil Fruits", "Arcs & Story", "Crews & Organizations", "Bounties", "Geography", "Other"]
#: What parts the words of a document; its options are single words, whatever other white space stands in them.
APART = " "
LEVELS = ["easy", "medium", "hard", "odd"]

SQL = """quiz AS (SELECT doc_id AS id, 'Which word: ' || text AS question, w[1:4] AS options, w[1 + doc_id % 4] AS correct_answer,
 list_filter(w[1:4], lambda x, i: i <> 1 + doc_id % 4) AS incorrect_answers,
 CASE WHEN doc_id % 7 = 0 THEN 'http://site.example/' || doc_id ELSE 'https://site.example/wiki/' || doc_id END AS source,
 CASE WHEN doc_id % 11 = 0 THEN 'single' ELSE 'multiple' END AS type,
 ['easy', 'medium', 'hard', 'odd'][1 + doc_id % 4] AS difficulty,
 ['Characters', 'Devil Fruits', 'Arcs & Story', 'Crews & Organizations', 'Bounties', 'Geography', 'Other'][1 + doc_id % 7] AS category,
 CASE WHEN doc_id % 13 = 0 THEN ' ' END AS explainer, CASE WHEN doc_id % 17 = 0 THEN 'ftp://x' END AS image
 FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per document: its text, its first words as options, one of them right; some break a rule."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.split("text", " "))
    i = F.col("doc_id")
    options = F.slice("w", 1, 4)
    return d.select(
        i.alias("id"),
        F.concat(F.lit("Which word: "), F.col("text")).alias("question"),
        options.alias("options"),
        F.try_element_at("w", (1 + i % 4).cast("int")).alias("correct_answer"),
        F.filter(options, lambda x, n: n != i % 4).alias("incorrect_answers"),
        F.when(i % 7 == 0, F.concat(F.lit("http://site.example/"), i)).otherwise(F.concat(F.lit("https://site.example/wiki/"), i)).alias("source"),
        F.when(i % 11 == 0, "single").otherwise("multiple").alias("type"),
        F.element_at(F.array(*map(F.lit, LEVELS)), (1 + i % 4).cast("int")).alias("difficulty"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (1 + i % 7).cast("int")).alias("category"),
        F.when(i % 13 == 0, " ").alias("explainer"),
        F.when(i % 17 == 0, "ftp://x").alias("image"),
    )
