"""From raw documents to token ids: five stages, each of one operator, each written as Parquet and read again by the next.

All but the last keep the columns of documents. ORACLE_SQL is None: SQL can't express the stages; tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triviary.llm import bpe, decontaminate, langid, neardup, queries, substrings
from triviary.llm.common import ship, unused, written

#: A text of more phrases per 100 characters than this is in none of the learned languages: a phrase is two symbols or less.
MOST_PHRASES = 50.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those that no learned language explains."""
    samples = langid.learn(docs, ~F.coalesce(queries.held_out(), F.lit(False)))
    lang, score, rate = unused(docs, "lang_pred", "score", "rate")
    named = langid.identify(docs, samples, columns=(lang, score, rate))
    return named.where((F.col(lang) != "und") & (F.col(rate) <= MOST_PHRASES)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of least doc_id.

    Rows of one doc_id and text count as one, of which that with the least hash of its other columns stays.
    """
    found = neardup.near_duplicates(docs, width=5)
    least = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
    one, th = unused(docs, "id", "th")
    keep = least.unionByName(found.where("group is null").select("doc_id", "th")).distinct().toDF(one, th)
    same = docs.join(keep, docs.doc_id.eqNullSafe(keep[one]) & F.xxhash64(docs.text).eqNullSafe(keep[th]), "left_semi").select(*docs.columns)
    if found.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        return same
    place = unused(docs, "place")[0]
    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    return same.withColumn(place, F.row_number().over(alike)).where(F.col(place) == 1).select(*docs.columns)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in another document too and have over 50 words or 400 bytes; every document stays, with what is left of its text.

    In scripts without spaces two letters count as a word. Passages are made of repeated strings of 200 bytes and more: 51 words of natural text are longer.
    Every copy is cut, none is kept, and a character that a cut would break goes with it.
    """
    return substrings.removed(docs, length=substrings.LEAST, words=substrings.WORDS, across=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, queries.tokenizer_path(), with_ids=True)


def shipped(stage):
    """The stage, on executors that have this package's code."""
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language ID", shipped(language)),
    ("MinHash near-dedup", shipped(near_duplicates)),
    ("suffix-array dedup", shipped(repeated_text)),
    ("benchmark decontamination", shipped(benchmark_free)),
    ("BPE encoding and decoding", shipped(tokens)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
