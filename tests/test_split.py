"""Single files read by many tasks, for any byte ranges, against Python's own parsers."""

import json
import random
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from triviary.sources import split, tables


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range for one test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def put(n):
        for c in names:
            spark.conf.set(c, str(n))

    yield put
    for c in names:
        spark.conf.unset(c)


def dump(path, n, seed=0):
    rnd = random.Random(seed)
    rows = []
    with open(path, "w", encoding="utf-8") as f:
        f.write('<mediawiki xmlns="x">\n <siteinfo><sitename>page</sitename></siteinfo>\n')
        for i in range(n):
            text = "".join(rnd.choice(["a < b & c > d", "</page", "<page>", "é日本", "\n", "{{Box|x=1}}", " word", '"q"']) for _ in range(rnd.randint(0, 60)))
            rows.append((f"Title {i} & more", str(i % 3 * 5), text))
            f.write(f'  <page>\n    <title>Title {i} &amp; more</title>\n    <ns>{i % 3 * 5}</ns>\n    <id>{i}</id>\n    <revision>\n      <id>1</id>\n      <text xml:space="preserve" bytes="9">{escape(text)}</text>\n    </revision>\n  </page>\n')
        f.write("</mediawiki>\n")
    return rows


@pytest.mark.parametrize("size", [777, 5000, 1 << 20])
def test_every_page_once_for_any_ranges(spark, ranges, tmp_path, size):
    rows = dump(tmp_path / "d.xml", 400)
    ranges(size)
    got = tables.pages(spark, str(tmp_path / "d.xml"))
    assert got.rdd.getNumPartitions() > 1 or size > 100_000
    # the parser trims values, as Spark's reader of XML does
    assert sorted((r.title, r.ns, (r.text or "").strip()) for r in got.collect()) == sorted((t, n, x.strip()) for t, n, x in rows)
    assert sorted(r.title for r in tables.pages(spark, str(tmp_path / "d.xml"), columns=("title",)).collect()) == sorted(t for t, *_ in rows)


def test_a_limit_reads_little_of_a_dump(spark, ranges, tmp_path):
    path = str(tmp_path / "d.xml")
    dump(path, 20_000, 1)
    ranges(1 << 20)
    assert tables.pages(spark, path).rdd.getNumPartitions() >= 8
    assert tables.pages(spark, path).count() == 20_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan that ran is wrapped
    try:
        few = tables.pages(spark, path, 5)
        few = few.groupBy().agg(F.count("*").alias("n"))
        assert few.collect()[0].n == 5
        stack, rows = [few._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName():
            rows += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    # each task stops at the limit
    assert 5 <= rows < 2_000


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 5)
    if kind == 0:
        return None
    if kind in (1, 2):
        return "".join(rnd.choice(['"', "\\", "}", "{", "[", "]", ",", ":", "é", "\n", "\t", "a", " ", "/"]) for _ in range(rnd.randint(0, 12)))
    if kind == 3:
        return rnd.randint(-5, 5)
    if kind == 4:
        return rnd.choice([True, False])
    if kind == 5:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {f"k{j}": value(rnd, depth + 1) for j in range(rnd.randint(0, 3))}


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, ranges, tmp_path, size, indent):
    rnd = random.Random(size)
    data = [{"id": i, "s": "".join(rnd.choice('"\\}{],[ é\n') for _ in range(rnd.randint(0, 9))), "x": {"v": value(rnd)}, "l": [str(value(rnd)) for _ in range(rnd.randint(0, 3))]} for i in range(200)]
    data[5]["s"], data[6]["s"] = "\\", '\\"}'
    for name, rows in (("a", data), ("b", data[:1]), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=rnd.random() < 0.5), encoding="utf-8")
    ranges(size)
    schema = "id INT, s STRING, l ARRAY<STRING>"
    got = split.json_elements(spark, str(tmp_path / "*.json"), schema).collect()
    assert sorted((r.id, r.s, r.l) for r in got) == sorted((d["id"], d["s"], d["l"]) for d in data + data[:1])
    assert sorted(map(repr, got)) == sorted(map(repr, spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "*.json")).collect()))


@pytest.mark.parametrize("size", [61, 1 << 20])
def test_json_objects(spark, ranges, tmp_path, size):
    rnd = random.Random(size)
    data = {f"k{i}" + rnd.choice(["", '"', "}", "\\"]): rnd.choice([None, "u", "}{", '"']) for i in range(100)}
    nested = {f"k{i}": {"n": rnd.choice([None, i]), "t": rnd.choice(["}", "a"])} for i in range(50)}
    (tmp_path / "m.json").write_text(json.dumps(data))
    (tmp_path / "n.json").write_text(json.dumps(nested, indent=1))
    (tmp_path / "e.json").write_text("{}")
    ranges(size)
    assert {r.key: r.value for r in tables.json_map(spark, str(tmp_path / "m.json"), "string").collect()} == data
    assert {r.key: r.value.asDict() for r in tables.json_map(spark, str(tmp_path / "n.json"), "struct<n: int, t: string>").collect()} == nested
    assert tables.json_map(spark, str(tmp_path / "e.json"), "string").count() == 0


def test_one_array_is_read_by_many_tasks(spark, ranges, tmp_path):
    path = str(tmp_path / "a.json")
    with open(path, "w") as f:
        json.dump([{"id": i, "s": "}" * (i % 5)} for i in range(50_000)], f)
    ranges(1 << 17)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 8
    got = split.json_elements(spark, path, "id INT, s STRING").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.sum(F.length("s")).alias("s")).first()
    assert (got.n, got.d, got.s) == (50_000, 50_000, 100_000)
