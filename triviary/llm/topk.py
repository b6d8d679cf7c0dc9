"""Exact top-k by integer inner product: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

Components x become floor(scale * x). The vectors are sorted by descending length over all tasks and packed into blocks; the
queries, too, are packed into blocks. The longest vectors of all (`head`, a fixed number) give every query a first threshold,
its k-th best score so far. Then each block of queries meets stripes of blocks in descending length: a block is skipped when
|q| * (its longest vector) can't reach the threshold; for the others the first coordinates after a rotation, which hold most of the
length, are multiplied first, and only vectors whose partial sum plus |rest of q| * |rest of x| reaches the threshold
are scored on integers. Bounds have slack for rounding and scores are integers, so the result is exact. Ties go to the smaller id.

The rotation holds the right singular vectors of a bounded sample (`sample` rows of least hash); any rotation gives right results, this
one prunes well. Scores beyond 64 bits are held at their limits. Vectors are compared with those of their own dimension.
Null vectors, and those with null or non-finite components or a null id, take no part. Rows that repeat a query's id are its own; of several query rows of one id that of the
least vector asks.
An empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OUT = "query_id long, vec_id long, score long"


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T on integers; by doubles where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    s = np.array([[int(v) for v in r] for r in q.tolist()], object) @ np.array([[int(v) for v in r] for r in x.tolist()], object).T
    return np.clip(s, -(2**63), 2**63 - 1).astype(np.int64)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each query's k best, in the order of queries and ranks."""
    order = np.lexsort((ids, -score.astype(np.float64), query)) if np.abs(score).max(initial=0) < 2**53 else np.array(sorted(range(len(score)), key=lambda i: (query[i], -int(score[i]), ids[i])), np.int64)
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dim)


def search(q_ids: np.ndarray, q: np.ndarray, start: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the parts (ids, vectors; longest first) for each query, among those that reach its start."""
    dim = q.shape[1]
    lead = max(1, dim // 4)
    qr = q @ rotation
    q_norm, q_rest = np.linalg.norm(q, axis=1), np.linalg.norm(qr[:, lead:], axis=1)
    need = start.astype(np.float64).copy()
    held = [np.zeros(0, np.int64)] * 3
    for ids, x in parts:
        norm = np.linalg.norm(x, axis=1)
        slack = 1e-9 * q_norm * norm.max(initial=0) + 1e-6
        live = np.flatnonzero(q_norm * norm.max(initial=0) + slack >= need)
        if not len(live) or not len(ids):
            continue
        xr = x @ rotation
        bound = qr[live, :lead] @ xr[:, :lead].T + np.outer(q_rest[live], np.linalg.norm(xr[:, lead:], axis=1)) + slack[live, None]
        reach = bound >= need[live, None]
        rows, cols = np.flatnonzero(reach.any(axis=1)), np.flatnonzero(reach.any(axis=0))
        if not len(rows):
            continue
        live = live[rows]
        s = exact_scores(q[live], x[cols])
        fit = (s >= need[live, None]) & (ids[cols][None, :] != q_ids[live, None])
        a, b = np.nonzero(fit)
        held = [np.concatenate(z) for z in zip(held, (live[a], ids[cols[b]], s[a, b]))]
        keep = best(*held, k)
        held = [z[keep] for z in held]
        count = np.bincount(held[0], minlength=len(q))
        full = np.flatnonzero(count >= k)
        last = np.cumsum(count) - 1
        need[full] = np.maximum(need[full], held[2][last[full]])
    return held[0], held[1], held[2]


def integers(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, v): v the floored components as doubles, which hold them exactly as they come from doubles."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    y = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(1e150)), F.lit(-1e150))
    v = F.transform(x, lambda c: F.when(F.abs(y(c)) < 2.0**52, F.floor(y(c)).cast("double")).otherwise(y(c)))
    return df.where(x.isNotNull() & F.col(key).isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), F.size(x).alias("dim"), v.alias("v"))


def packed(df: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows of one dimension, in the order of the rows: dim, n, longest, ids, vs, and starts if there."""
    extra = "start" in df.columns

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                own = b.column("v").take(pa.array(rows))
                m = np.asarray(own.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), d)
                for i in range(0, len(rows), size):
                    part = m[i : i + size]
                    row = {"dim": d, "n": len(part), "longest": float(np.linalg.norm(part, axis=1).max(initial=0)), "ids": ids[rows[i : i + size]].astype(np.int64).tobytes(), "vs": part.tobytes()}
                    if extra:
                        start = b.column("start").to_numpy(zero_copy_only=False)[rows[i : i + size]].astype(np.float64)
                        row |= {"starts": start.tobytes(), "reach": shortest(np.linalg.norm(part, axis=1), start)}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vs", pa.binary()), *([("starts", pa.binary()), ("reach", pa.float64())] if extra else [])]))

    return df.mapInArrow(run, "dim int, n int, longest double, ids binary, vs binary" + ", starts binary, reach double" * extra)


def shortest(norm: np.ndarray, need: np.ndarray) -> float:
    """A length that no vector falls short of which can reach what one of these queries needs; with room for rounding."""
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(need <= 1e-6, -np.inf, (need - 1e-6) / (norm * (1 + 1e-9)))
    return float(np.nextafter(least.min(initial=np.inf) * (1 - 1e-12), -np.inf))


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, block: int = 4096, head: int = 4096, sample: int = 4096, stripe: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best among all rows but those of its own id."""
    spark = df.sparkSession
    base = written(integers(df, key, vector, scale).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))), "vectors")
    queries = integers(df.where(is_query), key, vector, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    dims = [r[0] for r in base.groupBy("dim").count().orderBy("dim").collect()]  # one row per dimension
    out = None
    for dim in dims:
        own, asked = base.where(F.col("dim") == dim), queries.where(F.col("dim") == dim)
        one = _one_dimension(own, asked, dim, k, block, head, sample, stripe)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_dimension(base: DataFrame, queries: DataFrame, dim: int, k: int, block: int, head: int, sample: int, stripe: int) -> DataFrame:
    vec = lambda rows: np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)
    room = (1 << 21) // max(dim, 1)  # what goes through the driver or lies in one row holds at most 16 MB
    block, head, sample = max(1, min(block, room)), max(k + 1, min(head, room)), max(1, min(sample, room))
    some = vec(base.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect())
    rotation = np.linalg.svd(some, full_matrices=True)[2].T if dim and len(some) else np.eye(dim)
    longest = base.orderBy(F.desc("norm"), "id").limit(head).select("id", "v").collect()
    head_ids, head_x = np.array([r["id"] for r in longest], np.int64), vec(longest)
    least = -np.inf

    def begin(batches):
        """The k-th best score among the longest vectors; no bound where there are fewer."""
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            q = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), dim)
            start = np.full(len(ids), least)
            for i in range(0, len(ids), 512):
                s = exact_scores(q[i : i + 512], head_x).astype(np.float64)
                s[ids[i : i + 512, None] == head_ids[None, :]] = least
                if len(head_ids) >= k:
                    start[i : i + 512] = np.partition(s, len(head_ids) - k, axis=1)[:, len(head_ids) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start)], names=[*b.schema.names, "start"])

    asked = packed(queries.mapInArrow(begin, "id long, dim int, v array<double>, start double"), 1024)
    asked = written(asked.withColumn("qb", F.monotonically_increasing_id()).select("qb", "ids", "vs", "starts", "reach"), "queries")
    total = base.count()
    parts = max(1, -(-total // (block * stripe)))
    ordered = base.repartitionByRange(int(parts), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id").select("id", "dim", "v")
    blocks = packed(ordered, block).withColumn("stripe", F.spark_partition_id()).select("stripe", "longest", F.col("ids").alias("x_ids"), F.col("vs").alias("x_vs"))
    # a block of vectors is sent to those blocks of queries that its longest one can reach (Cauchy-Schwarz): two numbers per 1024 queries decide
    # that before anything is shuffled, so what the bound excludes never travels
    reach = asked.agg(F.sort_array(F.collect_list(F.struct("reach", "qb"))).alias("all")).first()[0]
    if not reach:
        return base.sparkSession.createDataFrame([], OUT)
    every = F.from_json(F.lit(json.dumps([[str(r["reach"]), r["qb"]] for r in reach])), "array<array<string>>")
    met = F.transform(F.filter(every, lambda r: r[0].cast("double") <= F.col("longest")), lambda r: r[1].cast("bigint"))
    pairs = blocks.withColumn("qb", F.explode(met)).join(asked.drop("reach"), "qb")

    def meet(key, group):
        first = {c: group.column(c)[0].as_py() for c in ("ids", "vs", "starts")}
        order = np.argsort(-group.column("longest").to_numpy(), kind="stable").tolist()
        x_ids, x_vs = group.column("x_ids"), group.column("x_vs")
        found = ((np.frombuffer(x_ids[i].as_py(), np.int64), matrix(x_vs[i].as_py(), dim) if dim else np.zeros((len(x_ids[i].as_py()) // 8, 0))) for i in order)
        q_ids = np.frombuffer(first["ids"], np.int64)
        q = matrix(first["vs"], dim) if dim else np.zeros((len(q_ids), 0))
        a, ids, s = search(q_ids, q, np.frombuffer(first["starts"], np.float64), found, rotation, k)
        return pa.table({"query_id": pa.array(q_ids[a], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.int64())})

    return pairs.groupBy("qb", "stripe").applyInArrow(meet, OUT)
