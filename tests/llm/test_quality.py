import random

import numpy as np
from pyspark.sql import functions as F

from triviary.llm import quality as Q


def rated(n, seed):
    rnd = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        g = rnd.choice([0, 1, 2, 2])
        words = [rnd.choice(plain) for _ in range(rnd.randint(10, 200))]
        if g == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moron"])
        text = " | ".join(words) if g == 1 else " ".join(words)
        rows.append((i, text, g))
    return rows


def test_grades_are_learned_in_order():
    train, test = rated(600, 0), rated(300, 1)
    m = Q.fit([t.encode() for _, t, _ in train], np.array([g for *_, g in train]), buckets=1 << 12)
    assert (np.diff(m.cuts) > 0).all()
    tails = m.tails([t.encode() for _, t, _ in test])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean((tails > 0.5).sum(axis=1) == [g for *_, g in test]) > 0.95


def test_features_of_long_texts_are_whole():
    long = ("alpha beta " * 300_000 + "gamma").encode()
    doc, feat, words = Q.features([b"alpha", long, b"", b"gamma x"], 1 << 12)
    assert words.tolist() == [1, 600_001, 0, 2]
    own = {i: set(feat[(doc == i) & (feat < 1 << 12)].tolist()) for i in range(4)}
    assert len(own[1]) == 3 and own[0] < own[1] and own[1] & own[3] and not own[2]


def test_rows(spark):
    rows = rated(300, 2)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (902, "!!", 0.0), (0, rows[0][1], 0.0)], "doc_id long, text string, grade double")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(900, 1), (None, 1), (901, None), (0, rows[0][2])], "doc_id long, grade int")
    model = Q.learn(docs, ratings, rows=250, buckets=1 << 12)
    got = Q.score(docs, model).collect()
    assert len(got) == 304
    by = {r.doc_id: r for r in got}
    assert all((by[i].expected_grade, by[i].p_good, by[i].selected) == (0, 0, False) for i in (900, 901, 902))
    assert np.mean([by[i].selected == (g == 2) for i, _, g in rows]) > 0.95
    none = Q.learn(docs, ratings.limit(0))
    assert {r.expected_grade for r in Q.score(docs, none).collect()} == {0.0}
    assert Q.score(docs.limit(0), model).count() == 0


def test_held_out_documents(spark):
    from triviary.llm import queries

    got = queries.op7_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = got.where("held_out").join(labels, "doc_id").where("quality = 1 and toxic = 0")
    assert good.agg(F.avg(F.col("selected").cast("int"))).first()[0] > 0.9


def test_fit_is_the_maximum_of_the_likelihood():
    """The penalised likelihood, written out, has no gradient where fit() ends, and its thresholds are in order."""
    rows = rated(120, 3)
    texts, grades = [t.encode() for _, t, _ in rows], np.array([g for *_, g in rows])
    m = Q.fit(texts, grades, buckets=1 << 8, steps=4000, ridge=0.05, least=1, signal=0)
    doc, feat, _ = Q.features(texts, 1 << 8)
    x = np.zeros((len(texts), len(m.weights)))
    x[doc, feat] = 1

    def loss(w, cuts):
        up = [np.ones(len(texts)), *[1 / (1 + np.exp(c - x @ w)) for c in cuts], np.zeros(len(texts))]
        return -np.mean([np.log(up[g][i] - up[g + 1][i]) for i, g in enumerate(grades)]) + 0.05 / 2 * (w**2).sum()

    best = loss(m.weights, m.cuts)
    used = np.flatnonzero(x.any(axis=0))[::17]
    for j in [*used.tolist(), "low", "high"]:
        for step in (-0.05, 0.05):
            w, c = m.weights.copy(), m.cuts.copy()
            if j == "low":
                c[0] += step
            elif j == "high":
                c[1] += step
            else:
                w[j] += step
            assert loss(w, c) > best - 1e-6


def test_columns_of_the_same_name_are_refused_or_renamed(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a b", 0.5)], "doc_id long, text string, P_Good double")
    model = Q.fit([b"a"], np.array([0]), buckets=1 << 8)
    with pytest.raises(ValueError, match="p_good"):
        Q.score(docs, model)
    assert Q.score(docs, model, columns=("e", "p", "s")).columns == ["doc_id", "text", "P_Good", "e", "p", "s"]


def test_words_that_tell_nothing_have_no_weight():
    rows = rated(600, 5)
    m = Q.fit([t.encode() for _, t, _ in rows], np.array([g for *_, g in rows]), buckets=1 << 14)
    at = lambda w: int(Q.features([w.encode()], 1 << 14)[1][0])
    assert m.weights[at("idiot")] < -1 > m.weights[at("moron")]
    assert sum(m.weights[at(f"w{i}")] != 0 for i in range(200)) < 10


def test_toxic_documents_are_held_out_and_found(spark):
    from triviary.llm import queries

    got = queries.op7_quality(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    share = got.join(labels, "doc_id").groupBy("toxic", "quality").agg(F.avg(F.col("selected").cast("int")).alias("x")).collect()
    by = {(r.toxic, r.quality): r.x for r in share}
    assert by[0, 1] > 0.98 and by[1, 1] < 0.1


def test_of_repeated_keys_the_least_grade_and_text_count(spark):
    words = ["good fine nice", "bad poor dull"]
    rows = [(i, f"{words[i % 2]} {i}") for i in range(60)]
    more = [(i, f"zzz other {i}") for i in range(0, 60, 3)]
    grades = [(i, 2 - i % 2) for i in range(60)] + [(i, 3) for i in range(0, 60, 5)]
    table = lambda x, s: spark.createDataFrame(x, s)
    once = Q.learn(table(rows, "doc_id long, text string"), table(grades[:60], "doc_id long, grade int"))
    for order in (1, -1):
        many = Q.learn(table((rows + more)[::order], "doc_id long, text string").repartition(5), table(grades[::order], "doc_id long, grade int"))
        assert np.array_equal(once.weights, many.weights)
