import random

import pytest
from pyspark.sql import functions as F

from triviary.llm import langid


def phrases(text: bytes, sample: bytes) -> int:
    """Greedy parsing by plain search, in blocks."""
    n = 0
    for b in range(0, len(text), langid.BLOCK):
        block, at = text[b : b + langid.BLOCK], 0
        while at < len(block):
            size = 1
            while at + size < len(block) and block[at : at + size + 1] in sample:
                size += 1
            at += size
            n += 1
    return n


def test_phrases_against_search():
    rnd = random.Random(0)
    samples = (("a", " ".join(rnd.choice(["the", "and", "then", "sand"]) for _ in range(200)).encode()), ("b", " ".join(rnd.choice(["der", "und", "den", "hund"]) for _ in range(200)).encode()))
    p = langid.Parser(samples)
    texts = [" ".join(rnd.choice(["the", "und", "sand", "hund", "xyz", "é"]) for _ in range(rnd.randint(1, 400))) for _ in range(50)]
    got = p.phrases(texts)
    for t, row in zip(texts, got.tolist()):
        raw = langid.normal(t)
        assert row == [phrases(raw, s) for _, s in samples]


def test_rows(spark):
    rnd = random.Random(1)
    en, de = "the of and to in that is was for on with as".split(), "der die und in den von zu das mit sich des auf".split()
    rows = [(i, " ".join(rnd.choice(en if i % 2 else de) for _ in range(60)), "en" if i % 2 else "de") for i in range(80)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 !!", None), (903, "the and of", None), (903, "the and of", None), (904, "of the " * 100_000, None), (905, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit(0))
    samples = langid.learn(df, F.col("doc_id") < 60)
    assert [n for n, _ in samples] == ["de", "en"]
    got = langid.identify(df, samples).collect()
    assert len(got) == len(rows) and got[0].h == 0
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "en", "en"]
    assert by[905].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got)
    assert langid.learn(df, F.lit(False)) == ()
    assert {r.lang_pred for r in langid.identify(df, ()).collect()} == {"und"}
    assert langid.identify(df.limit(0), samples).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = langid.identify(docs.where(held), langid.learn(docs, ~held)).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.98


def test_part_of_a_text_that_is_learned_from(spark):
    t = "ab " * 3000
    df = spark.createDataFrame([(1, t, "x")], "doc_id long, text string, lang string")
    size = lambda **kw: len(langid.learn(df, F.lit(True), **kw)[0][1])
    assert (size(), size(part=300), size(part=9000), size(part=9000, sample=1000)) == (8999, 299, 8999, 1000)


def test_texts_are_learned_from_whole(spark):
    name = lambda i: "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    rows = [(i, f"q{name(i)} " * 20, "x") for i in range(40)] + [(100 + i, f"long{name(i)} " * 2000, "x") for i in range(3)] + [(200, "alone " * 3000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = lambda **kw: dict(langid.learn(df, F.lit(True), **kw))
    some = learned(sample=500)
    # short texts by their hashes until there are 500 bytes, the last one whole
    assert len(some["x"]) < 600 and b"long" not in some["x"] and some["y"].count(b"alone") == 3000
    assert all(n == 20 for n in (some["x"].split().count(w) for w in set(some["x"].split())))
    every = learned(rows=64)
    assert b"long" in every["x"] and all(every["x"].split().count(w) in (20, 2000) for w in set(every["x"].split()))
    assert len(set(learned(rows=5)["x"].split())) == 5


def test_columns_of_the_same_name(spark):
    df = spark.createDataFrame([(1, "ab ab", "x", 1.0), (1, "ab ab", "y", 1.0)], "doc_id long, text string, lang string, Score double")
    samples = langid.learn(df, F.lit(True))
    assert [name for name, _ in samples] == ["x", "y"]  # one text under two labels is learned for both
    with pytest.raises(ValueError, match="score"):
        langid.identify(df, samples)
    assert langid.identify(df, samples, columns=("a", "b", "c")).columns == [*df.columns, "a", "b", "c"]
