"""BPE encoding and decoding by speculation: greedy longest match proposes tokens, pair checks verify them.

A sequence of tokens is what BPE makes of a word exactly if each token is what BPE makes of its own
symbols and no merge would have crossed the border of two neighbours. So all distinct words of a batch
are first cut greedily (numpy, all words in step), then every adjacent pair is tested (numpy, all pairs in
step), and only words with a failing pair are merged exactly, one merge at a time.

Nulls count as empty texts. Empty texts have no tokens and decode to an empty text. Texts are never cut.
Repeated rows and columns with other names pass through unchanged.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import claim, free, keeps, slices

#: White space as the vocabulary's normaliser sees it (Unicode White_Space).
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() also splits at these; the normaliser doesn't.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: Beyond Latin letters the library's Unicode tables may differ from Python's; such texts are normalised and split by the library.
BEYOND = regex.compile("[^\x00-\u024f]")
NEWER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
#: Distinct chunks a worker remembers before it starts anew.
REMEMBERED = 200_000
NEVER = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in chars]
    return [chars.get(b) or chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizers file of type BPE with byte-level symbols and a suffix on each word's last symbol."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern, self.newer = regex.compile(pattern), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab: dict[str, int] = model["vocab"]
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * n
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.number = [str(i) for i in range(n)]
        self.int = list(range(n))  # one int object per id, shared by all that is remembered
        chars = byte_chars()
        self.base = np.array([vocab[c] for c in chars] + [vocab[c + self.suffix] for c in chars], np.int64)
        symbols = {int(t): (s,) for s, t in enumerate(self.base)}
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank = np.full(n, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((a, b), (r, made))
            if made not in symbols:
                symbols[made] = symbols[a] + symbols[b]
                self.left[made], self.right[made], self.rank[made] = a, b, r
        self.n = n
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([r for r, _ in self.merge.values()], np.int64)[order], np.iinfo(np.int64).max)
        self.pair_made = np.append(np.array([m for _, m in self.merge.values()], np.int64)[order], -1)
        # tokens that BPE makes of their own symbols
        ids = np.array([t for t in symbols if self.rank[t] >= 0], np.int64)
        ids = ids[np.argsort(self.rank[ids])]
        whole = self.compatible(self.left[ids], self.right[ids], self.rank[ids])
        sound = np.ones(n, bool)
        for t, ok in zip(ids.tolist(), whole.tolist()):
            sound[t] = ok and sound[self.left[t]] and sound[self.right[t]]
        # the trie of all sound tokens: node and symbol give the child
        child: dict[int, int] = {}
        value = [-1]
        for t, s in symbols.items():
            if sound[t]:
                node = 0
                for x in s:
                    key = node << 9 | x
                    if key not in child:
                        child[key] = len(value)
                        value.append(-1)
                    node = child[key]
                value[node] = t
        self.value = np.array(value, np.int64)
        self.first = np.array([child[s] for s in range(512)], np.int64)
        self.second = np.full(len(self.first) << 9, -1, np.int64)
        at = np.full(len(value), -1, np.int64)
        at[self.first] = np.arange(512)
        deep = []
        for key, to in child.items():
            node, s = key >> 9, key & 511
            if node and at[node] >= 0:
                self.second[at[node] << 9 | s] = to
            elif node:
                deep.append((key, to))
        deep.sort()
        self.deep_key = np.array([k for k, _ in deep] + [np.iinfo(np.int64).max], np.int64)
        self.deep_to = np.array([v for _, v in deep] + [-1], np.int64)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.exact_merges = 0

    # -- verification

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (before the rank `until`) crosses the border of a and b.

        Both tokens' derivations are undone from the last merge back: at any time the border lies between one node of
        a's right edge and one of b's left edge; a merge of these two crosses it if its rank comes before either node is used up.
        At equal rank the merge further left comes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if until is None else until.copy()
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            u, v = a[live], b[live]
            key = u * self.n + v
            at = np.searchsorted(self.pair_key, key)
            crossed = (self.pair_key[at] == key) & (self.pair_rank[at] < limit[live])
            fine[live[crossed]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~crossed & ((ru >= 0) | (rv >= 0))
            live, u, v, ru, rv = live[go], u[go], v[go], ru[go], rv[go]
            undo_a = ru > rv
            limit[live] = np.where(undo_a, ru, rv + 1)
            a[live] = np.where(undo_a, self.right[u], u)
            b[live] = np.where(undo_a, v, self.left[v])
        return fine

    # -- speculation

    def longest(self, buf: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that starts at each of the positions, and its length."""
        sym = buf[pos]
        node = self.first[sym]
        best, length = self.value[node], np.ones(len(pos), np.int64)
        live = np.flatnonzero(sym < 256)
        node = self.second[sym[live] << 9 | buf[pos[live] + 1]]
        depth = 2
        while True:
            go = node >= 0
            live, node = live[go], node[go]
            if not len(live):
                return best, length
            value = self.value[node]
            hit = value >= 0
            best[live[hit]], length[live[hit]] = value[hit], depth
            last = buf[pos[live] + depth - 1]
            go = last < 256
            live, node = live[go], node[go]
            key = node << 9 | buf[pos[live] + depth]
            at = np.searchsorted(self.deep_key, key)
            node = np.where(self.deep_key[at] == key, self.deep_to[at], -1)
            depth += 1

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE: the merge of least rank first, the leftmost of equals."""
        self.exact_merges += 1
        ids = [int(x) for x in self.base[np.frombuffer(word, np.uint8)]]
        ids[-1] = int(self.base[256 + word[-1]])
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heap = [(r, i, made, x, y) for r, made, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """merged() for many words of similar, small length, in step: each round merges one pair of every word."""
        self.exact_merges += len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lens.max())
        ids = np.full((len(words), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < lens[:, None]
        sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sym[np.cumsum(lens) - 1] += 256
        ids[inside] = self.base[sym]

        def ranks(a, b):
            key = np.where(b >= 0, a * self.n + b, -1)
            at = np.searchsorted(self.pair_key, key)
            found = self.pair_key[at] == key
            return np.where(found, self.pair_rank[at], NEVER), np.where(found, self.pair_made[at], -1)

        rank, made = ranks(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(words)
        row = np.arange(len(words))
        cols = np.arange(width + 1)
        while True:
            j = rank.argmin(axis=1)
            every = np.arange(len(row))
            go = rank[every, j] < NEVER
            if not go.all():
                for r, x in zip(row[~go].tolist(), ids[~go].tolist()):
                    out[r] = [t for t in x if t >= 0]
                row, ids, rank, made, j = row[go], ids[go], rank[go], made[go], j[go]
                every = np.arange(len(row))
            if not len(row):
                return out
            new = made[every, j]
            shift = np.minimum(cols + (cols > j[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            ids[every, j] = new
            shift = np.minimum(shift[:, :-1], width - 1)
            rank, made = np.take_along_axis(rank, shift, 1), np.take_along_axis(made, shift, 1)
            rank[:, -1] = NEVER
            rank[every, j], made[every, j] = ranks(new, ids[every, j + 1])
            k = np.flatnonzero(j > 0)
            rank[k, j[k] - 1], made[k, j[k] - 1] = ranks(ids[k, j[k] - 1], new[k])

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word; words are not empty."""
        raw = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        starts = np.concatenate([[0], ends[:-1]])
        buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        buf[ends - 1] += 256
        pos, word = starts.copy(), np.arange(len(words))
        toks, owners = [], []
        while len(word) > 512:  # all words in step
            t, n = self.longest(buf, pos)
            toks.append(t)
            owners.append(word)
            pos = pos + n
            go = pos < ends[word]
            pos, word = pos[go], word[go]
        if len(word):  # the few that are left, however long: matches at all their positions, then a walk
            lens = ends[word] - pos
            offs = np.cumsum(lens) - lens
            every = np.arange(int(lens.sum())) - np.repeat(offs, lens) + np.repeat(pos, lens)
            t, n = self.longest(buf, every)
            t, n = t.tolist(), n.tolist()
            for w, at, size in zip(word.tolist(), offs.tolist(), lens.tolist()):
                got, end = [], at + size
                while at < end:
                    got.append(t[at])
                    at += n[at]
                toks.append(np.array(got))
                owners.append(np.full(len(got), w))
        tok, owner = np.concatenate(toks), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        tok, owner = tok[order], owner[order]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tok[inner] * self.n + tok[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.n, pairs % self.n)
        bad = np.unique(owner[inner[~fine[back]]]).tolist()
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        ints = self.int
        flat = [ints[t] for t in tok.tolist()]
        out = [tuple(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
        bad.sort(key=lambda w: len(raw[w]))
        for i in range(0, len(bad), 2048):
            part = bad[i : i + 2048]
            short = [w for w in part if len(raw[w]) <= 48]
            got = self.merged_all([raw[w] for w in short]) if short else []
            for w, x in zip(short, got):
                out[w] = tuple(ints[t] for t in x)
            for w in part[len(short) :]:
                out[w] = tuple(ints[t] for t in self.merged(raw[w]))
        return out

    # -- texts

    def split(self, text: str) -> list[str]:
        """Chunks between white space, normalised; a special token's string is given as a chunk of its id after a space."""
        if self.cuts and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.cuts.split(text)):
                if i % 2:
                    out.append(f" {self.special[part]}")
                elif part:
                    out += self.plain(part)
            return out
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list[str]:
        if not text.isascii():
            if BEYOND.search(text):
                return [x for x in SPACE.split(NEWER.normalize_str(text)) if x]
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case letter by letter, without a final form
                text = text.replace("Σ", "σ")
        text = text.lower()
        if NOT_SPACE.search(text):
            return [x for x in SPACE.split(text) if x]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Fills what is remembered for chunks."""
        parts, new = {}, set()
        for c in chunks:
            if c[0] == " ":
                self.chunks[c] = (self.int[int(c)],)
            else:
                if not c.isascii() and BEYOND.search(c):
                    p = [w for w, _ in self.newer.pre_tokenize_str(c)]
                else:
                    p = [c] if c.isalpha() else self.pattern.findall(c)
                parts[c] = p
                new.update(p)
        new = [w for w in new if w not in self.words]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.words.update(zip(part, self.encode_words(part)))
        words, long = self.words, []
        for c, p in parts.items():
            self.chunks[c] = words[p[0]] if len(p) == 1 else tuple(chain.from_iterable([words[w] for w in p]))

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        lists = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(lists)).difference(self.chunks)
        full = len(self.chunks) + len(new) > REMEMBERED
        words = self.words.copy() if full and len(self.words) < REMEMBERED // 4 else None
        self.learn(new)
        get = self.chunks.__getitem__
        for x in lists:
            yield list(chain.from_iterable(map(get, x)))
        if full:  # what came first, and so is frequent, stays; the rest is for this batch alone
            for c in new:
                del self.chunks[c]
            self.words = words or {}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces (the vocabulary names no decoder); ids outside the vocabulary are left out."""
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except IndexError:
            return " ".join(self.token[i] for i in ids if 0 <= i < self.n)


@contextmanager
def uncollected():
    """Many small tuples and no cycles: the collector would only look at them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@lru_cache(maxsize=1)
def model(path: str) -> WordBpe:
    return WordBpe(path)


keeps("bpe", model.cache_clear)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text as array<int>."""
    at = df.columns.index(text)
    free(df, out)

    def run(batches):
        claim("bpe")
        bpe = model(path)
        for b in slices(batches, at, 4 << 20):
            with uncollected():
                ids = pa.array(list(bpe.encode_batch(b.column(at).to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that each array of ids stands for; null ids count as none."""
    at = df.columns.index(ids)
    free(df, out)

    def run(batches):
        claim("bpe")
        bpe = model(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([bpe.decode(x or []) for x in part.column(at).to_pylist()], pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids in one pass; returns the key, the number of ids and digests of both results, and perhaps the ids.

    One pass over the rows, no shuffle: a task holds about 8 MB of text and the chunks it remembers.
    """
    df = df.select(F.col(key), F.col(text))
    schema = T.StructType([df.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        claim("bpe")
        bpe = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches, 1, 4 << 20):
            n, a, d, flat = [], [], [], []
            with uncollected():
                for ids in bpe.encode_batch(b.column(1).to_pylist()):
                    n.append(len(ids))
                    a.append(sha(" ".join(map(bpe.number.__getitem__, ids))))
                    d.append(sha(bpe.decode(ids)))
                    if with_ids:
                        flat.append(np.array(ids, np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(flat))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)
