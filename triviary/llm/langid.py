"""Language identification by cross-parsing: suffix automata of labelled text give the longest matches.

For each language the automaton of a bounded sample of labelled text accepts exactly the substrings of that text. A text is parsed
greedily into phrases, each the longest match that the automaton allows; the fewer phrases per symbol, times the logarithm of the sample's
length, the closer the language. All blocks of a batch of texts walk through all automata in step (numpy); a block is `BLOCK` symbols,
and a text's phrases are those of all its blocks, so whole texts are used and long ones cost no memory.

Symbols are UTF-8 bytes of the lowered text; ASCII characters other than letters count as spaces, and runs of spaces as one.

The sample per language: the first `part` characters (5,000 by default) of each of the `rows` labelled texts of least hash of their key, up to
`sample` bytes together; only the sample is bounded, predictions use whole texts. A text that is null or has
no letter gets `und` and score 0. Ties go to the language of smaller name. With no labelled text every text is `und`. The score is
1 - (phrases of the best / phrases of the second), or 1 if one language is known.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, free, keeps, slices

BLOCK = 512
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
FAIL = np.int32(-(2**31))


def normal(text: str) -> bytes:
    return text.lower().encode().translate(FOLD)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if len(text) < 200 or not any(map(str.isalpha, text[:200])) else True


def automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of text; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Parser:
    """All languages' automata as tables: state and symbol give the next state, with FAIL set where a phrase ends first."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [name for name, _ in samples]
        symbols = sorted(set(b"".join(s for _, s in samples)) | {32})
        self.width = len(symbols) + 1
        self.symbol = np.zeros(256, np.int32)  # 0: in no sample
        self.symbol[symbols] = np.arange(1, self.width)
        self.space = int(self.symbol[32])
        self.cost = np.array([np.log2(len(s) + 2) for _, s in samples])
        self.tables, self.start = [], []
        for _, s in samples:
            go = automaton(s)
            none = len(go)  # the state before a text and after a symbol that the sample lacks: a phrase ends there
            t = np.full((none + 1, self.width), -1, np.int32)
            for state, to in enumerate(go):
                if to:
                    t[state, self.symbol[list(to)]] = list(to.values())
            root = np.where(t[0] < 0, none, t[0])
            t = np.where(t < 0, (root * self.width)[None, :] | FAIL, t * self.width).astype(np.int32)
            self.tables.append(t.ravel())
            self.start.append(none * self.width)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """The number of phrases of each text in each language."""
        raw = [normal(t) for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        sym = self.symbol[np.frombuffer(b"".join(raw), np.uint8)]
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != self.space) | (sym[:-1] != self.space)
        keep[start[size > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        sym = sym[keep]
        size = kept[start + size] - kept[start]
        start = np.cumsum(size) - size
        n = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(raw)), n)
        place = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
        length = np.minimum(size[owner] - place, BLOCK)
        order = np.argsort(-length, kind="stable")
        first, length, owner = (start[owner] + place)[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left").tolist()
        state = [np.full(len(first), s, np.int32) for s in self.start]
        count = [np.zeros(len(first), np.int32) for _ in self.langs]
        for t, a in enumerate(active):
            c = sym[first[:a] + t]
            for s, k, table in zip(state, count, self.tables):
                v = table.take(s[:a] + c)
                k[:a] -= v >> 31
                np.bitwise_and(v, 0x7FFFFFFF, out=s[:a])
        return np.stack([np.bincount(owner, k, minlength=len(raw)) for k in count], axis=1) if len(self.langs) else np.zeros((len(raw), 0))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases per 100 symbols of the best language) of each text."""
        out: list = [("und", 0.0, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        if rows:
            c = self.phrases([texts[i] for i in rows]) * self.cost
            best = c.argmin(axis=1)
            top = c[np.arange(len(rows)), best]
            rest = c.copy()
            rest[np.arange(len(rows)), best] = np.inf
            second = rest.min(axis=1)
            for i, b, x, y in zip(rows, best.tolist(), top.tolist(), second.tolist()):
                out[i] = (self.langs[b], 1.0 - x / y if np.isfinite(y) else 1.0, 100 * x / self.cost[b] / max(1, len(texts[i])))
        return out


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(samples)


keeps("langid", parser.cache_clear)


def learn(df: DataFrame, use: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 64, sample: int = 40_000, long: int = 5_000, part: int | None = None) -> tuple[tuple[str, bytes], ...]:
    """The languages' samples: whole texts of at most `rows` of the rows that `use` allows, for each language, until these have `sample` bytes.

    The bound is one on rows: texts of up to `long` bytes come first, in the order of their hashes, then longer ones, the shortest first; the text that passes `sample`
    is the last and is learned whole, the others aren't learned from. So no long text fills a sample alone unless its language has no other.
    part: of each text only so many characters, and of a sample only `sample` bytes. Rows that are equal in key, text and language count once.
    """
    known = df.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull())
    w = Window.partitionBy("lang").orderBy(F.greatest("bytes", F.lit(long)), "h")
    # only the hash and the length are ranked; texts are fetched for the chosen hashes
    ranked = known.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text), F.col(lang)).alias("h"), F.octet_length(text).alias("bytes")).distinct()
    ranked = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows)
    if part is None:
        ranked = ranked.withColumn("before", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < sample)
    chosen = {r["h"]: r["r"] for r in ranked.select("h", "r").collect()}
    if not chosen:
        return ()
    h = F.xxhash64(F.col(key), F.col(text), F.col(lang))
    learned = F.col(text) if part is None else F.substring(text, 1, part)
    got = known.where(h.isin(list(chosen))).select(h.alias("h"), F.col(lang).alias("lang"), learned.alias("t")).dropDuplicates(["h"]).collect()
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in got:
        texts.setdefault(r["lang"], []).append((chosen[r["h"]], normal(r["t"])))
    join = lambda x: b" ".join(b" ".join(t for _, t in sorted(x)).split())[: None if part is None else sample]
    return tuple((name, s) for name in sorted(texts) if (s := join(texts[name])))


def identify(df: DataFrame, samples: tuple[tuple[str, bytes], ...], text: str = "text", columns: tuple[str, str, str] = ("lang_pred", "score", "phrase_rate")) -> DataFrame:
    """df with the predicted language, its score, and phrases per 100 characters."""
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType()), T.StructField(columns[2], T.DoubleType())])

    free(df, *columns)

    def run(batches):
        claim("langid")
        p = parser(samples)
        for b in slices(batches, at, 2 << 20):
            got = p.predict(b.column(at).to_pylist())
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *columns])

    return df.mapInArrow(run, schema)
