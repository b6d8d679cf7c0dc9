"""The keyed store: touched buckets, kills between two steps, tags, removals, old schemas; and streams that keep their state in it."""

import random

import pytest
from pyspark.sql import functions as F

from triviary.operators import play
from triviary.sources.keyed import KeyedStore
from triviary.streaming import mastery


def rows_of(store):
    df = store.read()
    return {} if df is None else {tuple(r[k] for k in store.keys): r.asDict() for r in df.collect()}


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rnd = random.Random(0)
    path, want = f"file://{tmp_path}/t", {}
    for i in range(8):
        store = KeyedStore(spark, path, ["k"], 8)  # opened anew
        keys = rnd.sample(range(40), rnd.randint(1, 10))
        if rnd.random() < 0.3 and want:
            store.upsert(spark.createDataFrame([(k, None) for k in keys], "k int, v string"), gone=True)
            for k in keys:
                want.pop((k,), None)
        else:
            store.upsert(spark.createDataFrame([(k, f"{i}.{k}") for k in keys], "k int, v string"))
            want |= {(k,): {"k": k, "v": f"{i}.{k}"} for k in keys}
        assert rows_of(store) == want
        if i % 3 == 2:
            store.compact(1)
            assert rows_of(store) == want and all(len(f) == 1 for f in store.state["folders"].values())
    assert store.vacuum() >= 0 and rows_of(KeyedStore(spark, path, ["k"], 8)) == want


def test_an_upsert_writes_to_the_buckets_of_its_keys(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/t", ["k"], 16)
    store.upsert(spark.range(500).selectExpr("int(id) as k", "'old' as v"))
    before = dict(store.state["folders"])
    store.upsert(spark.createDataFrame([(7, "new")], "k int, v string"))
    changed = [b for b, f in store.state["folders"].items() if f != before[b]]
    assert len(changed) == 1 and len(before) == 16
    assert [p.name for p in (tmp_path / "t" / store.state["folders"][changed[0]][-1]).glob("_b=*")] == [f"_b={changed[0]}"]
    asked = spark.createDataFrame([(7,), (8,), (9999,)], "k int")
    assert {r.k: r.v for r in store.looked_up(asked).collect()} == {7: "new", 8: "old", 9999: None}
    assert store.looked_up(asked).inputFiles() and len({f.split("_b=")[1].split("/")[0] for f in store.looked_up(asked).inputFiles()}) <= 3


def test_a_kill_between_two_steps_loses_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    store = KeyedStore(spark, path, ["k"], 4)
    one, two = (spark.createDataFrame([(k, v) for k in ks], "k int, v string") for ks, v in (((1, 2), "a"), ((2, 3), "b")))
    store.upsert(one, "1")
    want = rows_of(store)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the rows are there, the manifest isn't
        m.setattr(KeyedStore, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(two, "2")
        with pytest.raises(KeyboardInterrupt):
            store.compact(0)
    (tmp_path / "t" / "manifest" / "_half").write_text('{"keys"')  # a manifest that wasn't renamed
    again = KeyedStore(spark, path, ["k"], 4)
    assert rows_of(again) == want
    assert again.upsert(two, "2") and not again.upsert(two, "2") and not again.upsert(one, "1")
    assert {k: r["v"] for (k,), r in rows_of(again).items()} == {1: "a", 2: "b", 3: "b"}
    with pytest.raises(RuntimeError, match="another writer"):
        store.upsert(two, "9")  # it doesn't know of the newer manifest
    assert again.vacuum() >= 1 and len(rows_of(KeyedStore(spark, path, ["k"], 4))) == 3


def test_columns_that_older_rows_lack(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/t", ["k"], 2)
    store.upsert(spark.createDataFrame([(1, 5), (2, 6)], "k int, total int"))
    store.upsert(spark.createDataFrame([(2, 7, 3), (4, 9, 1)], "k int, total int, correct int"))
    assert {r.k: (r.total, r.correct) for r in store.read(defaults={"correct": 0}).collect()} == {1: (5, 0), 2: (7, 3), 4: (9, 1)}
    with pytest.raises(ValueError, match="total"):
        store.upsert(spark.createDataFrame([(1, "x")], "k int, total string"))
    with pytest.raises(ValueError, match="keys"):
        KeyedStore(spark, f"file://{tmp_path}/t", ["total"])


def test_a_stream_with_removals_and_an_old_state_equals_the_batch(spark, tmp_path):
    rnd = random.Random(1)
    schema = "profile long, qid int, point int, ts timestamp, seq long, removed boolean"
    events, n = [], 0
    for batch in range(5):
        rows = []
        if batch in (2, 4):
            rows += [(p, None, None, None, None, True) for p in rnd.sample(range(4), 2)]
        for _ in range(120):
            n += 1
            rows.append((rnd.randrange(4), rnd.randrange(5), int(rnd.random() < 0.6), n, n, None))
        events.append(rows)
    made = lambda rows: spark.createDataFrame([(p, q, x, None, s, r) for p, q, x, _, s, r in rows], schema).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_600_000_000))
    source, state, check = (f"file://{tmp_path}/{x}" for x in ("events", "state", "checkpoint"))
    for i, rows in enumerate(events):
        made(rows).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 4):  # the stream stops and goes on with the state that it left
            stream = spark.readStream.schema(made(rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
            mastery.keep(stream, mastery.store(spark, state, 8), check)
    left = []
    for rows in events:
        out = {r[0] for r in rows if r[5]}
        left = [r for r in left if r[0] not in out] + [r for r in rows if not r[5]]
    cols = ["profile", "qid", "seen", "correct", "wrong", "streak", "mastered", "times_mastered", "last_seen"]
    want = play.progress(made(left).drop("removed")).select(*cols)
    got = mastery.progress(mastery.store(spark, state, 8)).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # batches that run again change nothing
    before = mastery.store(spark, state, 8).state["done"]
    mastery.keep(spark.readStream.schema(made(events[0]).schema).option("maxFilesPerTrigger", 1).parquet(source), mastery.store(spark, state, 8), f"{check}-lost")
    after = mastery.store(spark, state, 8)
    assert after.state["done"] == before
    assert sorted(map(tuple, mastery.progress(after).select(*cols).collect())) == sorted(map(tuple, want.collect()))
