import hashlib
import random
import re
from pathlib import Path

import duckdb
import pytest

from triviary.llm import fim, queries
from triviary.llm.common import new_path

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "chars": r"(?s)."}


def by_definition(key, text, unit="lines", rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def texts():
    rnd = random.Random(0)
    made = ["".join(rnd.choice(["\n", "\n\n", "a", "é", "𝄞", " ", "\t", "\r\n", "<", "P>", "S>", "<M", "\x0b", "\x1c", "日"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    return [None, "", "\n", "\n\n\n", "a", " ", "x<P>y\nz", "<M>", "<S", "P>", "a\nb", "a\nb\n", *made]


@pytest.mark.parametrize("unit", list(fim.UNITS))
@pytest.mark.parametrize("rate", [100, 60])
def test_against_definition(spark, unit, rate):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc"), (None, None), (3, "twice\n" * 4), (3, "twice\n" * 4)]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in fim.transform(df, unit=unit, rate=rate).collect()), key=repr)
    assert got == sorted((by_definition(k, t, unit, rate) for k, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0), unit=unit).count() == 0


def test_query_equals_sql(spark):
    path = new_path(spark, "tables").removeprefix("file://")
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "twice\n" * 4), (3, "twice\n" * 4), (9999, "line of a very long text\n" * 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    for sf in (path, "/root/testdata/sf0.01"):
        df = queries.op12_fim(spark, sf)
        con = duckdb.connect()
        found = Path(sf, "documents.parquet")
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{found}{'/*.parquet' if found.is_dir() else ''}'")
        con.execute(queries.oracle_sql()["op12_fim"])
        names = [d[0] for d in con.description]
        assert names == df.columns
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.fetchall()))


def test_rank_lookup():
    for unit in fim.UNITS:
        c = fim.Cutter(unit)
        for t in texts()[1:]:
            ends, _ = c.events(t)
            units = re.findall(PATTERNS[unit], t)
            assert c.count(t, ends) == len(units)
            assert [c.border(t, ends, k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
            number = [k for k, u in enumerate(units) for _ in u]
            assert [c.unit_of(t, i) for i in range(len(t))] == number


def test_refusals(spark):
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x"), ("aba", "x", "y"), ("<P>x", "<P>", "y")):
        with pytest.raises(ValueError):
            fim.Cutter("lines", bad)
    with pytest.raises(ValueError, match="unit"):
        fim.Cutter("pages")
    with pytest.raises(ValueError, match="form"):
        fim.Cutter().restore("<P>a<S>b", "psm")
    with pytest.raises(ValueError, match="not an output"):
        fim.Cutter().restore("<P>a<S>b<M>c", "spm")
    with pytest.raises(ValueError, match="form"):
        fim.transform(spark.createDataFrame([(1, "a")], "form long, text string"), key="form")
