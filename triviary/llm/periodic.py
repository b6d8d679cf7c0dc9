"""Periodic runs of words: stretches that repeat a phrase of q words at least `min_exp` times, found over all lags, and their collapse to one period.

A run is a stretch with smallest period q (words q apart are identical), of at least max(min_len, min_exp * q) words, that can't be longer on either side.

Every word gets a number by its bytes (Arrow's dictionary, so no hash decides), and the array of numbers is compared with itself shifted by every lag up to
n / min_exp. A run of period q is a stretch of L >= max(min_len, min_exp * q) - q equal places at lag q. Lags are taken by octaves: all of an octave are
compared at once, at places a quarter of its shortest L apart, as a matrix of places by lags that is a strided view of the array; a stretch that counts holds
four such places in a row. Where four hold, the text is compared with this shift in full and the true stretches are run-length coded. So every lag is looked
at, nothing that counts is missed, and the cost is n log n compared words instead of n * n / (2 * min_exp). A stretch at a multiple of its period is the same
stretch, so of equal stretches the smallest lag is the period.

Texts up to `part` bytes are handled where they lie, many in one array (numbers of different texts differ), without a shuffle. Longer ones are dealt out as (document,
lag range) pairs: each task compares one text at one range of lags, runs meet by document, and stretches found at several ranges keep the smallest lag.

Null texts have no words; repeated rows have equal results; a null key is a key like others; an empty table gives no rows; columns other than key and text are
not read, so they can have any name, and the key mustn't be named like a result (ValueError). Ties between runs: see `best`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, free, slices, unused, written

MIN_LEN, MIN_EXP = 24, 3
#: Bytes of a text above which its lags are dealt out, and how many ranges they make.
PART, RANGES = 4 << 20, 4
#: Cells of the compared matrix that are held at once.
CELLS = 1 << 22
#: Equal probes in a row that a stretch which counts must hold.
PROBES = 4
RESULTS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


class Numbered:
    """The words of texts in one array: numbers that are equal for equal words of one text only; words of text i are [first[i], first[i + 1])."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words, owner = split.flatten(), pc.list_parent_indices(split)
        there = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends gives empty ones
        self.words = pc.filter(words, there)
        owner = pc.filter(owner, there).to_numpy().astype(np.int64)
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.code = pc.dictionary_encode(self.words).indices.to_numpy().astype(np.int64) + owner * (len(self.words) + 1)


def stretch(lag, min_len: int, min_exp: float):
    """The equal places that a run of this period has at least."""
    return np.maximum(min_len, np.ceil(min_exp * lag).astype(np.int64)) - lag


def octaves(low: int, high: int):
    """Lag ranges [p, z) within [low, high) of at most a factor two."""
    while low < high:
        z = min(high, 2 * low)
        yield low, z
        low = z


def candidates(code: np.ndarray, first: np.ndarray, low: int, high: int, min_len: int, min_exp: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts and lags in [low, high) with PROBES places in a row that are equal to those a lag later."""
    least = int(stretch(np.arange(low, high), min_len, min_exp).min())
    in_row = min(PROBES, least)
    step = least // in_row
    wide, n = high - low, len(code)
    count = (n - low + step - 1) // step
    if count < in_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(first, np.arange(count) * step, side="right") - 1
    # places behind the end equal nothing
    padded = np.concatenate([code, np.full(wide + step, -1)])
    shifted = np.lib.stride_tricks.sliding_window_view(padded[low:], wide)[::step]
    probes = code[::step]
    found = []
    rows = max(2 * in_row, CELLS // wide)
    for a in range(0, count - in_row + 1, rows - in_row + 1):
        z = min(count, a + rows)
        same = shifted[a:z] == probes[a:z, None]
        m = z - a - in_row + 1
        every = same[:m].copy()
        for k in range(1, in_row):
            every &= same[k : k + m]
        # a row of equal places within a text counts once, at its first place
        every[1:] &= ~(same[: m - 1] & (text[a + 1 : a + m] == text[a : a + m - 1])[:, None])
        i, j = np.nonzero(every)
        found.append((text[i + a], j + low))
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(words: Numbered, low: int = 1, high: int | None = None, min_len: int = MIN_LEN, min_exp: float = MIN_EXP) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, sorted, from the lags in [low, high)."""
    first, code = words.first, words.code
    size = np.diff(first)
    best: list[dict[tuple[int, int], int]] = [{} for _ in size]
    top = int(size.max(initial=0) / min_exp) + 1
    for p, z in octaves(low, min(top, high or top)):
        doc, lag = candidates(code, first, p, z, min_len, min_exp)
        # a text is compared once at each lag; lags rise, so the smallest names a stretch
        for q, d in sorted(set(zip(lag.tolist(), doc.tolist()))):
            own = code[first[d] : first[d + 1]]
            if min_exp * q > len(own):
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own[:-q] == own[q:], [False]]).astype(np.int8)))
            start, equal = edge[::2], edge[1::2] - edge[::2]
            long = equal >= stretch(np.int64(q), min_len, min_exp)
            for s, k in zip(start[long].tolist(), equal[long].tolist()):
                best[d].setdefault((s, k + q), q)
    return [sorted((s, k, q) for (s, k), q in b.items()) for b in best]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; of equals the one that starts first, then that of the smallest period."""
    top = None
    for s, k, q in found:
        if top is None or k * top[2] > top[1] * q or k * top[2] == top[1] * q and (s, q) < (top[0], top[2]):
            top = (s, k, q)
    return top


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, k, q in found:
        edge[s + q] += 1
        edge[s + k] -= 1
    return np.cumsum(edge[:-1]) > 0


def told(words: Numbered, found: list[list[tuple[int, int, int]]], digests: bool) -> list[tuple]:
    """The results of every text."""
    size = np.diff(words.first)
    gone = np.concatenate([np.zeros(0, bool), *(dropped(int(n), f) for n, f in zip(size, found))])
    left = np.concatenate([[0], np.cumsum(~gone)])[words.first]
    kept = pc.filter(words.words, pa.array(~gone))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), pa.scalar(" ", kept.type)).to_pylist()
    out = []
    for f, t in zip(found, texts):
        top = best(f)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in f)
        more = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, t)) if digests else ([{"start": s, "length": k, "period": q} for s, k, q in f], t)
        out.append((len(f), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, *more))
    return out


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def collapsed(docs: DataFrame, key: str = "doc_id", text: str = "text", *, min_len: int = MIN_LEN, min_exp: float = MIN_EXP, part: int = PART, ranges: int = RANGES, digests: bool = False) -> DataFrame:
    """Per row: key, n_runs, start, length, period and exponent_milli of the best run (null without one), runs, collapsed.

    runs: array<struct<start, length, period>> by start, then period; collapsed: the words that no run repeats, joined by one space. With `digests` these two are
    SHA-256 digests (runs as lines `start,length,period`), named runs_sha256 and collapsed_sha256.
    """
    if min_exp < 2:
        raise ValueError("a period must fit twice or more: min_exp >= 2")
    names = RESULTS if digests else (*RESULTS[:5], "runs", "collapsed")
    free(docs.select(key), *names)
    kinds = [T.LongType()] * 5 + ([T.StringType()] * 2 if digests else [T.ArrayType(RUN), T.StringType()])
    schema = T.StructType([docs.schema[key], *(T.StructField(n, k) for n, k in zip(names, kinds))])
    arrow = [pa.int64()] * 5 + ([pa.string()] * 2 if digests else [pa.list_(ARROW_RUN), pa.large_string()])

    def batch(keys, rows):
        return pa.RecordBatch.from_arrays([keys, *(pa.array(x, k) for x, k in zip(zip(*rows), arrow))], names=schema.names)

    def whole(batches):
        claim("periodic")
        for b in slices(batches, 1, 2 << 20):
            words = Numbered(b.column(1))
            yield batch(b.column(0), told(words, runs(words, 1, None, min_len, min_exp), digests))

    def found(batches):
        """(u, runs) of one text at one range of lags."""
        claim("periodic")
        for b in slices(batches, 1, 1):
            words = Numbered(b.column(1))
            top = int(len(words.code) / min_exp) + 1
            # equal numbers of octaves, as these cost the same
            bound = [max(1, math.ceil(top ** (k / ranges))) if k else 1 for k in range(ranges)] + [top]
            k = b.column(2)[0].as_py()
            for s, n, q in runs(words, bound[k], bound[k + 1], min_len, min_exp)[0]:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x], pa.int64()) for x in (s, n, q))], names=["u", "start", "length", "period"])

    def joined(batches):
        claim("periodic")
        for b in slices(batches, 1, 1):
            words = Numbered(b.column(1))
            yield batch(b.column(0), told(words, [sorted((r["start"], r["length"], r["period"]) for r in b.column(2)[0].as_py() or [])], digests))

    rows = docs.select(key, text)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    near = rows.where(size <= part).mapInArrow(whole, schema)
    far = rows.where(size > part)
    if far.isEmpty():  # the sizes are read, no text leaves its task
        return near
    u, k = unused(rows, "u", "k")
    far = far.withColumn(u, F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text)))
    pairs = far.select(u, text).dropDuplicates([u]).withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).repartition(u, k)
    spans = pairs.mapInArrow(found, "u long, start long, length long, period long").groupBy("u", "start", "length").agg(F.min("period").alias("period"))
    spans = written(spans.groupBy("u").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "runs").toDF(u, "found")
    return near.unionByName(far.join(spans, u, "left").select(key, text, "found").mapInArrow(joined, schema))
