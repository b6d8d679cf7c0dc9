import hashlib
import random
import re
import unicodedata

import pytest
import xxhash


from pyspark.sql import functions as F

from triviary.llm import fingerprint


def canonical(t):
    n = unicodedata.normalize
    t = n("NFKC", n("NFKD", n("NFD", t or "").casefold()).casefold())
    return re.sub(r"[\t-\r \x85\xa0  -     　]+", " ", t).strip(" ")


def plain_print(t):
    """128 bits of xxhash; the second half's seed is the hash of a word."""
    raw = canonical(t).encode()
    return f"{xxhash.xxh64_intdigest(raw, 42):016x}{xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(b'wide', 42)):016x}"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for i, (k, t) in enumerate(rows):
        t, follower = t or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + follower[:third]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(follower))))
    return out


FORMS = ["Straße", "STRASSE", "strasse", "ﬁne", "FINE", "é", "é", "É", "Å", "Å", "①", "1", "ς", "σ", "Σ", "ｆｕｌｌ", "İ", "ı", " ", " ", "　", "\t\n", " ", "日本", "가", "한", "𝄞", "ǆ", "ẞ", "ͅ", "ᾳ"]


def rows_of(n, seed=0):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice(FORMS) for _ in range(rnd.choice([0, 1, 2, 3, 7, 40])))) for i in rnd.sample(range(-500, 5000), n)]
    rows += [(9000 + i, "the same text " + " " * (i % 3)) for i in range(12)] + [(9000 + i, "THE same\ttext") for i in range(6)]
    return rows + [(None, None), (None, "a"), (7777, None), (7778, ""), (7779, "ab"), (7779, "ab"), (7779, "abc"), (7780, "long " * 100_000), (7781, "LONG " * 100_000)]


@pytest.mark.parametrize(("size", "small"), [(fingerprint.RANGE, fingerprint.SMALL), (200, 0)])
def test_against_plain_version(spark, size, small):
    rows = rows_of(150)
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, range int, rn int, fingerprint string")
    got = sorted((tuple(r) for r in fingerprint.compared(df, size=size, small=small).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "Abcdef")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprint.compared(df).collect()] == expected([(5, "Abcdef")])
    assert fingerprint.compared(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="n_chars"):
        fingerprint.compared(df.withColumnRenamed("doc_id", "n_chars"), key="n_chars")


@pytest.mark.parametrize("small", [fingerprint.SMALL, 0])
def test_texts_that_share_a_bucket_are_told_apart(spark, small):
    rows = rows_of(60, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, got = (sorted((tuple(r) for r in fingerprint.compared(df, bits=b, small=small, size=500).collect()), key=lambda r: repr(r[:3])) for b in (128, 3))
    assert len({r[3][:32] for r in got}) <= 8
    assert [(*r[:3], *r[5:]) for r in plain] == [(*r[:3], *r[5:]) for r in got]
    # the same partition of all texts, own and edited
    pairs = {(x, y) for p, g in zip(plain, got) for x, y in zip(p[3:5], g[3:5])}
    assert len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def test_plan_has_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = fingerprint.edited_and_next(df.select(F.col("doc_id").alias("key"), "text"), "key", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert plan.count("SinglePartition") == 0
