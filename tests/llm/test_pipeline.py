"""The pipeline over a small corpus against plain versions of its stages."""

import random

import corpus_pipeline
from triviary.llm.common import new_path


def test_stages(spark):
    rnd = random.Random(0)
    en = [rnd.choice(["th", "er", "an", "ing"]) + rnd.choice(["on", "es", "at", "ly"]) + rnd.choice(["", "ed", "or"]) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(en) for _ in range(n))
    item = "the man who sold the world went down to the river and never came back again"
    passage = text(120)
    rows = [(i, text(80), "en", "s", 0) for i in range(30)]
    long = text(200)
    rows += [(100, long, "en", "s", 0), (101, long + " extra", "en", "s", 0), (102, long, "en", "s", 0)]
    rows += [(110, text(60) + " " + passage + " " + text(60), "en", "s", 0), (111, text(60) + " " + passage + " " + text(60), "en", "s", 0)]
    rows += [(120, text(50) + ". " + item + ". " + text(50), "en", "s", 0), (130, "12345 !!", "en", "s", 0), (131, None, None, "s", 0), (131, None, None, "s", 0)]
    top = new_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    docs = spark.read.parquet(f"{top}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, top)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name.startswith("suffix"):
            left = {r.doc_id: r for r in docs.collect()}
            assert passage not in left[110].text and passage not in left[111].text
            assert all(r.n_chars == len(r.text) for r in left.values())
            assert all(left[i].text == t for i, t, *_ in rows[:30])
    every = {r[0] for r in rows}
    assert seen[0] == every - {130, 131}
    assert seen[1] == seen[0] - {101, 102}
    assert seen[2] == seen[1]
    assert seen[3] == seen[2] - {120}
    assert seen[4] == seen[3]
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, rows, items=(), schema=DOCS):
    """What each stage leaves."""
    top = new_path(spark, "tables")
    spark.createDataFrame(rows, schema).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{top}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, top).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    return seen


def test_an_empty_table(spark):
    assert [d.count() for d in staged(spark, [])] == [0] * 5


def test_nulls_long_texts_rows_of_one_id_and_further_columns(spark):
    rnd = random.Random(1)
    words = ["stone", "river", "winter", "garden", "silver", "morning", "letter", "window", "shadow", "summer"]
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    twice, han = text(40), "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(400))
    rows = [(i, text(40), "en", "s", 0, 1, "k") for i in range(20)]
    rows += [(100, text(60_000), "en", None, None, 1, None), (None, text(40), "en", "s", 0, 1, "k"), (101, "", "en", "s", 0, 1, "k"), (102, None, None, None, None, None, None)]
    rows += [(103, twice, "en", "a", 1, 1, "k"), (103, twice, "en", "b", 1, 1, "k"), (103, twice, "en", "b", 1, 1, "k")]
    rows += [(110 + i, "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(200)) + han, "zh", "s", 0, 1, "k") for i in range(2)]
    seen = staged(spark, rows, schema=DOCS + ", group int, spans string")
    for d in seen[:4]:
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "group", "spans"]
    ids = [sorted(((r.doc_id is None, r.doc_id or 0) for r in d.select("doc_id").collect())) for d in seen]
    assert (False, 101) not in ids[0] and (False, 102) not in ids[0] and (True, 0) in ids[0] and (False, 100) in ids[0]
    assert ids[0].count((False, 103)) == 3 and ids[1].count((False, 103)) == 1
    left = {r.doc_id: r.text for r in seen[2].collect()}
    assert len(left[100]) > 60_000 and all(len(left[i]) <= 202 for i in (110, 111))


def test_the_limit_of_phrases(spark):
    """A text of as many phrases as the limit says stays, one of more goes."""
    rnd = random.Random(2)
    words = ["stone", "river", "winter", "garden"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)), "en", "s", 0) for i in range(30)]
    strange = "".join(chr(0x4E00 + i) for i in range(300))
    docs = spark.createDataFrame([*rows, (50, strange, None, "s", 0), (51, "river stone " * 5 + strange[:5], None, "s", 0)], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()}
    assert kept == set(range(30)) | {51}
