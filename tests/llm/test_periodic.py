import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from triviary.llm import periodic, queries
from triviary.llm.common import new_path


def by_definition(words, min_len=24, min_exp=3):
    """(start, length, period) of every run, from its definition: every stretch at every lag, kept if no smaller lag has it."""
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            k = 0
            while i + k + q < n and words[i + k] == words[i + k + q]:
                k += 1
            if k and k + q >= min_len and k + q >= min_exp * q:
                out.setdefault((i, k + q), q)
            i += k + 1
    return sorted((s, k, q) for (s, k), q in out.items())


def expected(doc_id, text, planted=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_text(rnd, n):
    """Words with many runs, some next to each other or in each other."""
    out = []
    while len(out) < n:
        phrase = [rnd.choice("abc") for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 13, 40]))]
        out += phrase * rnd.choice([1, 1, 2, 3, 4, 30])
        out += [rnd.choice("abc") for _ in range(rnd.choice([0, 0, 1, 20]))]
    return " ".join(out[:n])


def test_runs_against_definition(monkeypatch):
    rnd = random.Random(0)
    texts = [periodic_text(rnd, rnd.randint(0, 300)) for _ in range(150)]
    # neighbours that carry on each other's period must not hide each other
    texts += ["x " * 100, "x " * 100, "x " * 23, "x " * 24, "a b c " * 7 + "a b", "a b c " * 8, ""]
    import pyarrow as pa

    for cells in (periodic.CELLS, 64):
        monkeypatch.setattr(periodic, "CELLS", cells)
        got = periodic.runs(periodic.Numbered(pa.array(texts)))
        assert got == [by_definition(t.split()) for t in texts]
    few = texts[:40]
    assert periodic.runs(periodic.Numbered(pa.array(few)), min_len=2, min_exp=2) == [by_definition(t.split(), 2, 2) for t in few]


def test_lag_ranges_hold_every_run():
    rnd = random.Random(1)
    import pyarrow as pa

    words = periodic.Numbered(pa.array([periodic_text(rnd, 800)]))
    whole = periodic.runs(words)[0]
    parts = [r for low, high in ((1, 2), (2, 7), (7, 50), (50, 400)) for r in periodic.runs(words, low, high)[0]]
    least = {}
    for s, k, q in parts:
        least[s, k] = min(q, least.get((s, k), q))
    assert sorted((s, k, q) for (s, k), q in least.items()) == whole


ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "ab\x1cc ab\x1cc " * 20), (5, "é日 " * 40), (5, "é日 " * 40), (None, "y " * 30), (6, "\x0bz z\x0cz " * 30), (7, "a\x85b c" * 30), (8, "A a " * 30)]


@pytest.mark.parametrize("part", [periodic.PART, 50])
def test_query_against_definition(spark, part):
    rnd = random.Random(2)
    rows = ROWS + [(i, periodic_text(rnd, rnd.randint(0, 200))) for i in range(10, 60)]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, n_runs int, found int, u int")
    got = sorted((tuple(r) for r in periodic.collapsed(df, part=part, digests=True).collect()), key=repr)
    assert got == sorted((expected(k, t) for k, t in rows), key=repr)
    assert periodic.collapsed(df.limit(0), part=part).count() == 0
    plain = periodic.collapsed(df.where("doc_id = 8"), part=part).first()
    assert plain.collapsed == "A a" and [tuple(r) for r in plain.runs] == [(0, 60, 2)] and plain.exponent_milli == 30000


def test_planted_runs(spark):
    path = new_path(spark, "tables")
    rnd = random.Random(3)
    rows = ROWS[:3] + ROWS[4:6] + [(i, " ".join(str(rnd.random()) for _ in range(rnd.choice([1, 2, 60, 150])))) for i in range(1000, 1250)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_periodic(spark, path).collect())
    assert got == sorted(expected(k, t, planted=True) for k, t in rows)
    assert sum(r[1] for r in got) >= 10


def test_planted_runs_of_texts_without_words(spark):
    path = new_path(spark, "tables")
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    rows = list(zip(ids, [None, "", " \t\n ", "one", "one two three"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_periodic(spark, path).collect())
    assert got == sorted(expected(k, t, planted=True) for k, t in rows)


def test_a_long_text(spark):
    rnd = random.Random(4)
    phrase = [str(rnd.random()) for _ in range(20_000)]
    df = spark.createDataFrame([(1, " ".join(phrase * 4 + ["end"])), (2, "w " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapsed(df, part=1 << 20).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, 80_000, 20_000)
    assert got[1].collapsed == " ".join(phrase + ["end"])
    assert (got[2].n_runs, got[2].length, got[2].period, got[2].collapsed) == (1, 300_000, 1, "w")


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a")], "start long, text string")
    with pytest.raises(ValueError, match="start"):
        periodic.collapsed(df, key="start")
    with pytest.raises(ValueError, match="min_exp"):
        periodic.collapsed(df, key="text", min_exp=1.5)


def test_best_is_exact():
    assert periodic.best([(0, 10**9 + 1, 10**9), (5, 2, 1)]) == (5, 2, 1)
    assert periodic.best([(4, 30, 10), (0, 60, 20), (0, 3, 1)]) == (0, 3, 1)
    assert periodic.best([]) is None
    assert np.array_equal(periodic.dropped(5, [(0, 4, 2)]), [False, False, True, True, False])
