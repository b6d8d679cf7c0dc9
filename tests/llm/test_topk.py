import math

import numpy as np
from pyspark.sql import functions as F

from triviary.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k, scale=64.0):
    good = [(i, np.array([math.floor(scale * float(np.float32(x))) for x in v], object)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in good:
        if q % 20:
            continue
        s = sorted(((-int(sum(x * y)), i) for i, y in good if i != q and len(y) == len(x)))[:k]
        out += [(q, r, i, -s_) for r, (s_, i) in enumerate(s, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **kw).collect())


def test_random_vectors_in_small_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist(), None) for i in range(300)]
    assert run(spark, rows, k=20, block=16, head=30, stripe=2) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(30)] + [(0, [1.0, 2.0], 1), (40, None, 1), (60, [1.0, None], 1), (80, [float("nan"), 1.0], 1), (100, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (120, [-0.01, 0.0], 1), (140, [1.0], 1), (141, [2.0], 1), (160, [], 1)]
    got = run(spark, rows, k=5)
    want = [r for r in brute(rows, 5) if r[0]]
    assert [r for r in got if r[0]] == want
    assert got[:5] == [(0, r, r, 64 * 64 * 5) for r in range(1, 6)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**24 + i * 4096), float(-(2**23) + i)], None) for i in range(45)]
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_blocks_that_no_query_reaches_are_not_sent(spark):
    """Bounds before the shuffle lose nothing: long, short and zero vectors, zero queries, many blocks."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (50 if i % 7 == 0 else 0.05)).tolist(), None) for i in range(400)] + [(400, [0.0] * 6, None), (401, [0.0] * 6, None), (420, [1e-3] * 6, None)]
    assert run(spark, rows, k=3, block=8, head=8, stripe=2) == brute(rows, 3)
    assert topk.shortest(np.array([2.0, 4.0]), np.array([10.0, 12.0])) <= 3.0 < topk.shortest(np.array([2.0]), np.array([10.0]))
    assert topk.shortest(np.array([0.0, 1.0]), np.array([-np.inf, 5.0])) == -np.inf
