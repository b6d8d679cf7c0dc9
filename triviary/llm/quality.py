"""Quality of documents by ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... share one weight vector over hashed text features; ordered thresholds cut the score: P(grade <= k) = 1 / (1 + exp(score - t_k)).
The expected grade and the probability of a grade of `good` or more select documents. Features: the distinct words of the whole text,
lowered and hashed to `buckets`, and one bin each for the share of distinct words, of symbols and of capitals.

The model is fitted on at most `rows` rated rows, those of least hash of their key (a documented bound); every document is scored, in one
pass without a shuffle.

Null texts and texts without words have grade 0 and probability 0 and aren't selected. Ties in the sample go to the smaller key. With no rated row every text has
grade 0. Repeated rows are scored each; other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, free, slices
from .decontaminate import INSIDE, UPPER
from .words import buffers, table

SYMBOLS = table(b"#$%&*|!@^~<>{}[]=_+/\\")
BINS = 8


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, sorted by text; and the number of words of each text."""
    n = len(texts)
    words, symbols, capitals = np.zeros(n), np.zeros(n), np.zeros(n)
    docs, feats = [], []
    for start, w in buffers(texts, INSIDE):
        last = int(w.text[-1]) + 1 if len(w.text) else 1
        own = slice(start, start + last)
        words[own] += np.bincount(w.text, minlength=last)
        if len(w.first):
            edge = np.concatenate([[0], w.first[np.flatnonzero(np.diff(w.text)) + 1], [len(w.buf)]])
            at = np.unique(w.text)
            for mark, total in ((SYMBOLS, symbols), (UPPER, capitals)):
                total[start + at] += np.add.reduceat(mark[w.buf].astype(np.int64), edge[:-1])
        key = np.unique(w.text * buckets + (w.hash % np.uint64(buckets)).astype(np.int64))
        docs.append(start + key // buckets)
        feats.append(key % buckets)
    key = np.unique(np.concatenate(docs) * buckets + np.concatenate(feats)) if docs else np.zeros(0, np.int64)
    doc, feat = key // buckets, key % buckets
    distinct = np.bincount(doc, minlength=n)
    size = np.array([max(1, len(t)) for t in texts])
    some = np.flatnonzero(words > 0)
    share = [np.minimum(distinct / np.maximum(words, 1), 1), np.minimum(8 * symbols / size, 1), np.minimum(2 * capitals / size, 1)]
    style = [buckets + i * BINS + np.minimum((s[some] * BINS).astype(np.int64), BINS - 1) for i, s in enumerate(share)]
    return np.concatenate([doc, *[some] * 3]), np.concatenate([feat, *style]), words


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray
    buckets: int

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each text and k; 0 without words."""
        doc, feat, words = features(texts, self.buckets)
        score = np.bincount(doc, self.weights[feat], minlength=len(texts)) if len(texts) else np.zeros(0)
        return sigmoid(score[:, None] - self.cuts[None, :]) * (words > 0)[:, None]


def telling(doc: np.ndarray, feat: np.ndarray, grades: np.ndarray, size: int) -> np.ndarray:
    """How far each feature's texts depart from the sample, in standard deviations of chance: in their mean grade or in the share of one grade."""
    count, most = np.maximum(np.bincount(feat, minlength=size), 1), np.zeros(size)
    for y in (grades.astype(float), *(grades == g for g in range(int(grades.max(initial=0)) + 1))):
        off = y - np.mean(y)
        if (spread := off.std()) > 0:
            most = np.maximum(most, np.abs(np.bincount(feat, off[doc], minlength=size)) / (spread * np.sqrt(count)))
    return most


def fit(texts: list[bytes], grades: np.ndarray, buckets: int = 1 << 18, steps: int = 200, ridge: float = 1e-4, least: int = 3, signal: float = 4.0) -> Model:
    """Maximum likelihood with a ridge, by Adam on the whole sample.

    Words in fewer than `least` texts have no weight, nor have those whose texts are graded like any others (within `signal` standard deviations): there are
    far more words than rated texts, and by chance alone some would tell every one of these apart. Bins of style always count.
    """
    doc, feat, _ = features(texts, buckets)
    n, k = len(texts), int(grades.max(initial=0))
    known = np.bincount(feat, minlength=buckets + 3 * BINS) >= least
    if n and signal > 0:
        known &= (telling(doc, feat, grades, len(known)) >= signal) | (np.arange(len(known)) >= buckets)
    keep = known[feat]
    doc, feat = doc[keep], feat[keep]
    used, at = np.unique(feat, return_inverse=True)
    w = np.zeros(len(used))
    # thresholds as the first and the logarithms of the gaps, so they stay in order
    p = np.clip([np.mean(grades > j) for j in range(k)], 1e-3, 1 - 1e-3) if n else np.zeros(k)
    cuts0 = -np.log(p / (1 - p)) if n else np.zeros(k)
    c = np.concatenate([cuts0[:1], np.log(np.maximum(np.diff(cuts0), 1e-2))])
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    rate = 0.05
    for step in range(1, steps + 1 if n and k else 1):
        cuts = np.cumsum(np.concatenate([c[:1], np.exp(c[1:])]))
        s = np.bincount(doc, w[at], minlength=n)
        up = np.concatenate([np.ones((n, 1)), sigmoid(s[:, None] - cuts[None, :]), np.zeros((n, 1))], axis=1)  # P(grade >= j)
        own = np.arange(n)
        a, b = up[own, grades], up[own, grades + 1]
        prob = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob
        ds = -(da - db) / n
        gw = np.bincount(at, ds[doc], minlength=len(w)) + ridge * w
        gcut = np.array([(da[grades == j + 1].sum() - db[grades == j].sum()) / n for j in range(k)])
        gc = np.cumsum(gcut[::-1])[::-1].copy()
        gc[1:] *= np.exp(c[1:])
        g = np.concatenate([gw, gc])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        # steps shrink over the second half, so that the end is no moment of an oscillation
        move = rate * min(1.0, 2 * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, c = w - move[: len(w)], c - move[len(w) :]
    weights = np.zeros(buckets + 3 * BINS)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([c[:1], np.exp(c[1:])])) if k else np.zeros(0), buckets)


def learn(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", use: Column | None = None, rows: int = 8000, **options) -> Model:
    """Fits on the rated documents of least hash; `use` chooses among the ratings. Of a key's several grades and texts the least one counts."""
    rated = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if use is None else use))
    some = rated.groupBy(F.col(key).alias("_k")).agg(F.min(grade).cast("int").alias("_g")).orderBy(F.xxhash64("_k"), "_k").limit(rows)
    got = docs.where(F.col(text).isNotNull()).join(F.broadcast(some), docs[key] == some["_k"]).groupBy("_k", "_g").agg(F.min(text).alias("_t")).collect()
    got.sort(key=lambda r: r[0])
    return fit([r[2].encode() for r in got], np.array([r[1] for r in got], np.int64), **options)


def score(df: DataFrame, model: Model, text: str = "text", good: int = 2, least: float = 0.5, columns: tuple[str, str, str] = ("expected_grade", "p_good", "selected")) -> DataFrame:
    """df with expected_grade, p_good (probability of a grade of `good` or more) and selected (p_good at least `least`)."""
    at = df.columns.index(text)
    sc = df.sparkSession.sparkContext.broadcast(model)  # 2 MB at the default number of buckets
    names = list(columns)
    free(df, *names)
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches):
        claim("quality")
        m = sc.value
        for b in slices(batches, at, 4 << 20):
            tails = m.tails([(t or "").encode() for t in b.column(at).to_pylist()])
            p = tails[:, good - 1] if tails.shape[1] >= good else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(axis=1)), pa.array(p), pa.array((p >= least) & (p > 0))], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)
