import base64
import gzip
import hashlib
import io
import random

from triviary.llm import warc
from triviary.llm.common import new_path


def digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def test_rows_survive(spark):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, "http://b/", "same"), (9, None, "same"), (3, "http://b/", "same"), (1, "u", None), (2, "u", ""), (4, "u", "other é"), (None, "u", "same"), (7, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", warc.F.lit("clash"))
    got = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, split=1000).collect()), key=repr)
    first = {"same": 3, "": 1}
    want = []
    for k, _, h in rows:
        f = first.get(h or "")
        other = f is not None and k != f
        want.append((k, len((h or "").encode()), digest(h), "revisit" if other else "response", f if other else None))
    assert got == sorted(want, key=repr)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.key: r.refers_to for r in warc.round_trip(df, least=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_split_owns_its_records():
    rnd = random.Random(4)
    payloads = [rnd.randbytes(rnd.randint(0, 3000)) for _ in range(60)]
    # payloads that hold archives themselves, stored uncompressed
    inner = gzip.compress(warc.record(99, "u", b"inner", None, "2024-01-01T00:00:00Z"), 0)
    payloads += [inner, warc.MAGIC * 50, inner + b"tail"]
    data = b"".join(gzip.compress(warc.record(i, "u", p, None, "2024-01-01T00:00:00Z"), i % 3) for i, p in enumerate(payloads))
    for split in (1, 7, 100, 1000, 10**9) if len(data) < 10 else (500, 4096, 10**9):
        seen = []
        for start in range(0, len(data), split):
            for _, text in warc.records(warc.Bytes(io.BytesIO(data), len(data), 512), start, min(len(data), start + split)):
                seen.append(warc.parsed(text, True))
        assert [(r["key"], r["payload"]) for r in seen] == list(enumerate(payloads))


def test_archive_is_plain_gzip(spark):
    df = spark.createDataFrame([(i, "u", f"text {i}") for i in range(20)], "page_id long, url string, html string")
    files = spark.read.schema(warc.FILES).parquet(warc.write(df, new_path(spark, "w"), "page_id", "url", "html")).collect()
    assert sum(f.records for f in files) == 20
    text = b"".join(gzip.open(f.path.removeprefix("file:")).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == 20
