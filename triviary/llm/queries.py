"""One query per operator over the driver's tables: thin wrappers that apply the operator and derive digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, extract, fim, fingerprint, langid, neardup, periodic, quality, substrings, topk, warc
from .common import ship

#: Where the public tokenizers' files lie; a parameter of the operators.
def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.selectExpr("key as page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"), words=substrings.WORDS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 good; learned from documents that op9's rule doesn't hold out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grades = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
    model = quality.learn(docs, grades, use=~held_out())
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "expected_grade", "p_good", "selected")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    nodes = chat.chain(rows.unionByName(more), "conv_id", ["turn"], "role", "text")
    return chat.read_back(chat.conversations(chat.paths(nodes)))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs, ~F.coalesce(held_out(), F.lit(False)))
    return langid.identify(docs.select("doc_id", "text"), samples).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """op11's contract: of one document in ten, by crc32 of its id, the words from a place on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("if(n > 0, int(g % n), 0)")).withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    again = "array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)), ' ')"
    return rows.select("doc_id", F.expr(f"if(n > 0, {again}, text)").alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapsed(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")), digests=True)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(table(spark, sf_dir, "documents"), digests=True)


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op12_fim": fim.SQL}
