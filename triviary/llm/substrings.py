"""Exact removal of repeated substrings: every byte that lies in a string of `length` bytes that also starts elsewhere.

Equal strings of `length` bytes hold the same anchor, the `gram`-byte string of least hash among theirs, at the same place. So:

1. Every document gives its anchors, each with its context: the bytes that the strings of this anchor cover together, and their hash.
   Anchors are one in about (length - gram) / 2 bytes. Texts are read in windows of `BUFFER` bytes that overlap by `length` - 1, so memory follows the
   window and not the longest text; no text is shuffled for them.
2. Anchors and contexts are counted with partial aggregation. Where a context occurs again, everything in it is repeated. Where only the anchor
   does, one segment of text per different context is fetched.
3. Segments go to shards, all of an anchor to one. A shard sorts its suffixes (Larsson-Sadakane), finds common prefixes (Kasai), and runs of
   suffixes that share `length` bytes but start in different places are repeated.
4. An anchor with more segments than a shard holds is spread over several. These shards cut their sorted fingerprints of different strings at common
   bounds by binary search; each piece is merged by one task, and shards learn which of their strings others hold.
5. The intervals meet the documents, which are cut.

Strings are judged on the input, in UTF-8 bytes; the texts of other documents and of the same count alike, repeated rows as documents of their own.
With `across` only what stands in another document (another key or another text) counts. `n_passages` counts runs of `words` whole words made of such
strings of `least` bytes: passages that are too short for `length` are reported, not removed.

A cut may split a character; the kept bytes are what is left. Null texts are empty; texts shorter than `length` stay whole; a null key is a key
like others; an empty table gives no rows. Columns of any name pass through `removed`; `digests` returns its own columns and the key alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, remove, slices, swept, unused, written
from .suffix import common_prefixes, suffix_array
from .words import mix, powers

LENGTH, GRAM = 400, 128
SHARD = 1 << 17
BUFFER = 1 << 17
#: A passage: over 50 words, and bytes that no 51 words of natural text fall short of.
WORDS, LEAST = 51, 200
U = np.uint64


class Hashes:
    """Hashes of any substrings of one buffer."""

    def __init__(self, buf: np.ndarray):
        self.p, self.inv = powers(max(1 << 16, 1 << int(len(buf)).bit_length()))
        self.total = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * self.p[: len(buf)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def anchors(buf: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, context (from, to: positions in the buffer), hash and context hash of every anchor of the texts buf[bounds[i]:bounds[i + 1]].

    The context is what the strings of `length` bytes whose anchor this is cover together.
    """
    w = length - gram + 1
    n = len(buf) - gram + 1
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none, none.astype(U), none.astype(U)
    hashes = Hashes(buf)
    at = np.arange(n)
    h = hashes.of(at, at + gram)
    # the least hash of w places: the low bits hold the place, so the leftmost of equals wins
    bits = U(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(U)
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, U)]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - w + 1], before[w - 1 : n])
    # only strings inside one text
    room = np.diff(bounds) - length + 1
    fits = np.flatnonzero(room > 0)
    if not len(fits):
        return none, none, none, none.astype(U), none.astype(U)
    first, room = bounds[fits], room[fits]
    start = np.arange(int(room.sum())) + np.repeat(first - (np.cumsum(room) - room), room)
    place = (least[start] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place, low, high = place[new], start[new], start[np.append(new[1:], len(start)) - 1] + length
    context = mix(hashes.of(low, high) + (place - low).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return np.searchsorted(bounds, low, side="right") - 1, low, high, h[place], context


def pieces(texts: list[bytes], most: int, length: int):
    """(text numbers, offsets, parts) of buffers of about `most` bytes; a longer text is cut into parts that share `length` - 1 bytes.

    So every string of `length` bytes lies in one part, and memory doesn't follow the longest text. Shorter texts are left out.
    """
    own, offset, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, most):
            part = t[a : a + most + length - 1]
            if size and size + len(part) > most:
                yield own, offset, held
                own, offset, held, size = [], [], [], 0
            own.append(i)
            offset.append(a)
            held.append(part)
            size += len(part)
    if size:
        yield own, offset, held


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(u, s, e, h, ctx) of every anchor and its context; docs: (u, text)."""
    names = ["u", "s", "e", "h", "ctx"]

    def run(batches):
        claim("substrings")
        for b in slices(batches, 1, 2 << 20):
            u = b.column(0).to_numpy()
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for own, offset, held in pieces(texts, BUFFER, length):
                bounds = np.concatenate([[0], np.cumsum(list(map(len, held)))]).astype(np.int64)
                part, low, high, h, ctx = anchors(np.frombuffer(b"".join(held), np.uint8), bounds, length, gram)
                text, shift = np.array(own)[part], np.array(offset)[part] - bounds[part]
                yield pa.RecordBatch.from_arrays([pa.array(u[text]), pa.array((low + shift).astype(np.int32)), pa.array((high + shift).astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(ctx.astype(np.int64))], names=names)

    return docs.mapInArrow(run, "u long, s int, e int, h long, ctx long")


def segments(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, salt, u, start, need, bytes): the text of each wanted context (u, s, e, h, salt, need)."""
    by_doc = wanted.groupBy("u").agg(F.collect_list(F.struct("s", "e", "h", "salt", "need")).alias("wanted"))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches):
        for b in slices(batches, 2, 2 << 20):
            rows, size = [], 0
            for u, want, text in zip(*(c.to_pylist() for c in b.columns)):
                raw = (text or "").encode()
                for w in want:
                    rows.append((w["h"], w["salt"], u, w["s"], w["need"], raw[w["s"] : w["e"]]))
                    size += w["e"] - w["s"]
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "salt", "u", "start", "need", "bytes"])

    return docs.join(by_doc, "u").select("u", "wanted", "text").mapInArrow(run, "h long, salt int, u long, start long, need boolean, bytes binary")


class Shard:
    """Segments of text, their strings of `length` bytes, and which of these are repeated among them."""

    def __init__(self, t: pa.Table, length: int, across: bool = False):
        self.u, self.start = (t.column(c).to_numpy() for c in ("u", "start"))
        self.need = t.column("need").to_numpy(zero_copy_only=False)
        raw = t.column("bytes").to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(size + 1) - size - 1
        self.text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        n = np.maximum(size - length + 1, 0)
        self.segment = np.repeat(np.arange(len(raw)), n)
        self.offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.first[self.segment] + self.offset  # where each string starts
        sa = suffix_array(self.text)
        shared = common_prefixes(self.text, sa, int(size.max(initial=1)) + 8, self.first)
        group = np.empty(len(self.text), np.int64)
        group[sa] = np.concatenate([[0], np.cumsum(shared < length)])
        self.group = group[self.at]
        # different places, or documents: a string may lie in several segments of its document
        doc = np.unique(self.u, return_inverse=True)[1]
        number = np.full(len(self.text), -1, np.int64)
        number[self.at] = np.arange(len(self.at))
        order = number[sa]
        order = order[order >= 0]
        many = np.zeros(len(self.text) + 1, bool)
        if len(order):
            place = doc[self.segment] if across else (doc[self.segment] << 40) + self.start[self.segment] + self.offset
            g, place = self.group[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            many[g[first]] = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        self.repeated = many[self.group]

    def fingerprints(self, length: int) -> np.ndarray:
        return Hashes(self.text).of(self.at, self.at + length)

    def intervals(self, hit: np.ndarray, length: int) -> list[pa.Array]:
        """u, start, end of the runs of the strings in `hit`, for the segments that need them."""
        k = np.flatnonzero(hit & self.need[self.segment])
        seg, begin = self.segment[k], self.start[self.segment[k]] + self.offset[k]
        new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (begin[1:] > begin[:-1] + length)]) if len(k) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(k)) - 1 if len(k) else a
        return [pa.array(x.astype(np.int64)) for x in (self.u[seg[a]], begin[a], begin[z] + length)]


def whole(batches, columns: tuple[str, ...], most: int):
    """Tables of sorted rows of about `most` bytes that hold every group of equal `columns` whole."""
    held, size = None, 0
    for b in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        size += t.nbytes
        if size < most:
            continue
        same = None
        for c in columns:
            eq = pc.equal(held.column(c), held.column(c)[-1])
            same = eq if same is None else pc.and_(same, eq)
        k = held.num_rows - pc.sum(same).as_py()
        if k:
            yield held.slice(0, k).combine_chunks()
            held = held.slice(k).combine_chunks()
            size = held.nbytes
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def found_in_shards(segs: DataFrame, length: int, across: bool = False) -> DataFrame:
    """(u, s, e): repeated intervals of the segments, each anchor's in one shard."""

    def run(batches):
        claim("substrings")
        for t in whole(batches, ("h",), SHARD):
            s = Shard(t, length, across)
            yield pa.RecordBatch.from_arrays(s.intervals(s.repeated, length), names=["u", "s", "e"])

    small = segs.select("h", "u", "start", "need", "bytes")
    return small.repartition("h").sortWithinPartitions("h").mapInArrow(run, "u long, s long, e long")


def found_across(segs: DataFrame, length: int, across: bool = False, per_piece: int = 1 << 20, paths: list[str] | None = None) -> DataFrame:
    """(u, s, e) for anchors whose segments are spread over shards (h, salt)."""
    segs = written(segs, "hot-segments", paths)
    n = segs.groupBy("h").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * length / per_piece)).cast("int").alias("cuts"))
    schema = "h long, salt int, piece int, blob binary"

    def local(batches):
        for t in whole(batches, ("h", "salt"), 0):
            h, salt, cuts = (t.column(c).to_numpy() for c in ("h", "salt", "cuts"))
            ends = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]), [True]])).tolist()
            for a, z in zip(ends, ends[1:]):
                s = Shard(t.slice(a, z - a), length)
                f = np.unique(s.fingerprints(length))
                k = int(cuts[a])
                bounds = (np.arange(1, k, dtype=object) * (1 << 64) // k).astype(U)
                at = np.concatenate([[0], np.searchsorted(f, bounds), [len(f)]]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([int(h[a])] * k, pa.int64()), pa.array([int(salt[a])] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([f[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], names=["h", "salt", "piece", "blob"])

    with_cuts = segs.join(n, "h")
    blobs = with_cuts.select("h", "salt", "u", "start", "need", "bytes", "cuts").repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(local, schema)

    def merge(key, group):
        """Which fingerprints of a piece several shards hold: each shard's, by binary search in the sorted rest."""
        own = [np.frombuffer(x, U) for x in group.column("blob").to_pylist()]
        both = np.sort(np.concatenate(own))
        twice = np.unique(both[1:][both[1:] == both[:-1]])
        out = []
        for f in own:
            at = np.searchsorted(twice, f)
            at[at == len(twice)] = 0
            out.append(f[twice[at] == f].tobytes() if len(twice) else b"")
        return pa.table({"h": group.column("h"), "salt": group.column("salt"), "piece": group.column("piece"), "blob": pa.array(out, pa.binary())})

    merged = blobs.groupBy("h", "piece").applyInArrow(merge, schema).where("length(blob) > 0")

    def mark(left, right):
        s = Shard(left, length, across)
        others = np.sort(np.frombuffer(b"".join(right.column("blob").to_pylist()), U))
        f = s.fingerprints(length)
        hit = s.repeated.copy()
        if len(others):
            at = np.searchsorted(others, f)
            at[at == len(others)] = 0
            hit |= others[at] == f
        return pa.Table.from_arrays(s.intervals(hit, length), names=["u", "s", "e"])

    def marked(left, right):
        return mark(left, right) if left.num_rows else pa.table({c: pa.array([], pa.int64()) for c in ("u", "s", "e")})

    return segs.groupBy("h", "salt").cogroup(merged.groupBy("h", "salt")).applyInArrow(marked, "u long, s long, e long")


def keyed(docs: DataFrame, key: str, text: str, name: str = "_u") -> DataFrame:
    """docs with a column that names a row's key and text, by 64 bits; equal rows share it."""
    return docs.withColumn(name, F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text)))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, per_shard: int = 2000, across: bool = False) -> DataFrame:
    """(u, spans): the intervals array<struct<s, e>> of repeated strings, not merged, of each text (see keyed) that has some.

    across: only strings that stand in another document too. gram: about a third of `length` if not given.
    Most anchors stand at one place; these end with one small aggregation by anchor. Most of the others have one context, so all of it is
    repeated; only anchors of several contexts need these counted and compared.
    """
    gram = gram or max(1, length * GRAM // LENGTH)
    own = keyed(docs.select(key, text), key, text).select(F.col("_u").alias("u"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    passing: list[str] = []
    found = written(anchored(own, length, gram), "anchors", passing)
    apart = F.min("u") != F.max("u") if across else F.lit(True)
    per_anchor = found.groupBy("h").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed"), apart.alias("apart")).where("n > 1 and apart")
    per_anchor = written(per_anchor.select("h", "n", "mixed"), "repeats", passing)  # a join of tables can be split at a hot anchor, one of sums can't
    places = written(found.join(per_anchor, "h").select("h", "ctx", "u", "s", "e", "mixed", "n"), "places", passing)
    while len(passing) > 1:
        remove(docs.sparkSession, passing.pop(0))
    swept(docs.sparkSession)
    sure, mixed = places.where("not mixed").select("u", "s", "e"), places.where("mixed")
    firsts = [F.first(c).alias(c) for c in ("u", "s", "e", "n")]
    again = F.min("u") != F.max("u") if across else F.count("*") > 1
    classes = written(mixed.groupBy("h", "ctx").agg(*firsts, again.alias("again")), "classes", passing)
    sure = sure.unionByName(mixed.join(classes.where("again").select("h", "ctx"), ["h", "ctx"]).select("u", "s", "e"))
    salts = F.ceil(F.col("n") / per_shard).cast("int")
    wanted = classes.select("u", "s", "e", "h", F.when(salts > 1, F.pmod(F.xxhash64("u"), salts)).otherwise(-1).cast("int").alias("salt"), (~F.col("again")).alias("need"))
    segs = written(segments(wanted, own), "segments", passing)
    parts = sure.unionByName(found_in_shards(segs.where("salt < 0"), length, across))
    if not segs.where("salt >= 0").isEmpty():
        parts = parts.unionByName(found_across(segs.where("salt >= 0"), length, across, paths=passing))
    spans = written(parts.groupBy("u").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    for path in passing:
        remove(docs.sparkSession, path)
    swept(docs.sparkSession)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint, maximal runs in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


#: Letters of scripts that put no space between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han); two of them make a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def whole_words(raw: bytes, s: int, e: int) -> int:
    """The words that lie whole in raw[s:e]: between spaces, and of two letters each in scripts without spaces."""
    part = raw[s:e]
    letters = len(UNSPACED.findall(part.decode("utf-8", "ignore"))) if not part.isascii() else 0
    return letters // 2 + _spaced(raw, part, s, e)


def _spaced(raw: bytes, part: bytes, s: int, e: int) -> int:
    n = len(part.split())
    if n and s and not raw[s - 1 : s].isspace() and not part[:1].isspace():
        n -= 1
    if n and e < len(raw) and not raw[e : e + 1].isspace() and not part[-1:].isspace():
        n -= 1
    return n


def n_passages(raw: bytes, spans: list[dict] | None, words: int) -> int:
    return sum(whole_words(raw, s, e) >= words for s, e in merged(spans))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, per_shard: int = 2000, words: int | None = None, least: int = LEAST) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256.

    With `words` also n_passages: how many passages of as many whole words and of `least` bytes stand in another document too.
    """
    rows = keyed(docs.select(key, text), key, text)
    name = rows.columns[2]
    long = repeated(docs, key, text, length, gram, per_shard)
    rows = rows.join(long.withColumnRenamed("u", name), name, "left")
    if words:  # both meet the texts in one shuffle
        rows = rows.join(repeated(docs, key, text, least, across=True).toDF(name, "passages"), name, "left")
    more = ["n_passages"] if words else []
    rows = rows.select(F.col(key), F.col(text), "spans", *(["passages"] if words else []))
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *(T.StructField(c, T.LongType()) for c in more)])

    def run(batches):
        for b in slices(batches, 1, 2 << 20):
            out = []
            held = b.column(3).to_pylist() if words else [None] * b.num_rows
            for t, spans, short in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), held):
                raw, runs = (t or "").encode(), merged(spans)
                left = kept(raw, runs)
                out.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), *([n_passages(raw, short, words)] if words else [])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, per_shard: int = 2000, words: int = 0, across: bool = False, enough: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from the text (broken characters at the cuts are dropped); null texts stay null.

    words: runs of fewer whole words stay unless they have `enough` bytes; across: what a text repeats only of itself stays.
    """
    u, own = unused(docs, "u", "spans")
    spans = repeated(docs, key, text, length, gram, per_shard, across).toDF(u, own)
    rows = keyed(docs, key, text, u).join(spans, u, "left").select(*docs.columns, own)
    at, last = docs.columns.index(text), len(docs.columns)

    def cut(t: str | None, spans) -> str | None:
        if not spans:
            return t
        raw = t.encode()
        return kept(raw, [(s, e) for s, e in merged(spans) if not words or e - s >= enough or whole_words(raw, s, e) >= words]).decode("utf-8", "ignore")

    def run(batches):
        for b in slices(batches, at):
            texts = [cut(t, spans) for t, spans in zip(b.column(at).to_pylist(), b.column(last).to_pylist())]
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:last])]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:last])

    return rows.mapInArrow(run, docs.schema)
