import random

import numpy as np
import pytest

from triviary.llm import neardup
from triviary.llm.graph import components


def words_of(t):
    return (t or "").encode().lower().split()


def brute(rows, width=4):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 300))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy))
    shared = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows += [shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    rows += ["one", "one", "One", "two words", "two  words\n", "", None, "   ", "a b c d e", "A b c d e", "é É", rows[0], rows[0]]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", neardup.F.lit(1)).repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
        assert got == brute(rows)


def test_repeated_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y"), (None, "a b c d e f"), (None, "q r s t"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (1, 1, 1, True), (None, 3, 1, False), (None, 1, None, True), (2, 0, 2, True)], key=repr)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_long_text_is_cut_into_buffers_and_joined():
    rnd = random.Random(3)
    t = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 10**6)) for _ in range(300_000)).encode()
    w = t.split()
    got = neardup.sets([b"short one here now", t, b""], 4)
    assert [len(x) for x in got] == [1, len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}), 0]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(base[:600]), np.unique(base[300:])
    ra, rb, both = neardup.sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    assert abs((ra == rb).mean() - (1 / 3 + 2 / 3 * 0.045)) < 0.1
    same = np.array([(ra == rb).sum()])
    above = np.array([(ra > rb).sum()])
    n = np.array([600.0])
    assert not neardup.plausible(above, neardup.M - same - above, n, n, 0.8)[0]
    assert neardup.plausible(above * 0, above * 0, n, n, 0.8)[0]


def test_blocks_and_rounds(spark, monkeypatch):
    """One hot bucket of many nodes, screened in several blocks, links what it should."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(5):
            copy[rnd.randrange(200)] = f"x{i}{rnd.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 300), (5, 5)]
    got = {r.node: r.least for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 300: 0, 101: 100, 102: 100}


def test_buffers_that_begin_with_empty_texts():
    for lead in ([b""], [b"", b"", b""]):
        _, w = next(neardup.buffers([*lead, b"one two", b"", b"three"], neardup.WORD))
        assert list(zip(w.first.tolist(), w.after.tolist(), w.text.tolist())) == [(0, 3, len(lead)), (4, 7, len(lead)), (7, 12, len(lead) + 2)]
    assert [len(x) for x in neardup.sets([b"", b"one two", b"one two"], 4)] == [0, 1, 1]
    a, b = neardup.sets([b"", b"one two", b"one two"], 4)[1:]
    assert a.tolist() == b.tolist()


def test_small_sets_against_brute_force(spark):
    """Sets of 4 and 5 shingles: 7 and 8 words at a width of 4, 8 and 9 at 5."""
    for width in (4, 5):
        rows = []
        for i in range(40):
            w = [f"{c}{i}" for c in "abcdefghi"]
            rows += [" ".join(w[: width + 3]), " ".join(w[: width + 4]), " ".join(w[: width + 2]), " ".join(w[1 : width + 4])]
        rows = list(enumerate(rows))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=width).collect()}
        assert got == brute(rows, width)
        assert got[1] == (5, 0, False) and got[2] == (3, 2, True) and got[3] == (4, 0, False)


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="settled"):
        components(edges, most=1)
