"""Documents that hold benchmark items, also re-parameterised ones, by template windows.

Numbers, names (capitalised words inside a sentence) and units (after a number) are replaced by typed placeholders, everything
else is lowered. Windows of `window` words are hash-joined with those of the items (an item of fewer words is one window): every window
by its raw lowered words, and by its template words if half of them or more are literal. Windows on one alignment of document and item
must agree in their slots: equal values in the item must stand for equal values in the document and the other way round. A document
is contaminated if on one alignment

- consistent windows that are equal in their raw words, or in templates of which 3/4 are literal, cover half of the item's words, or 13; or
- such an alignment is known by one window, and consistent windows of any kind on it cover all of the item's words but one, or 13, and at least 4 of these words, and 3/4 as many as the first
  rule asks for, are literal. So questions full of numbers and names are found with other numbers and names too.

The items' windows are held by every task, so items are taken in blocks of at most `block` windows, however many there are; the
documents are read once per block and never shuffled. All words of every document are read.

Null and empty texts are clean. Items under `least` words are found by their raw words alone, as their templates say nothing; items of one or
two words are left out, as any text holds them. Repeated rows are judged each; tables may be empty; other columns pass through `clean`
unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, slices
from .words import Words, buffers, shingles, table

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
INSIDE = table(set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256)))
UPPER, DIGIT, ENDS = table(set(range(65, 91))), table(b"0123456789"), table(b".!?:\n")
#: Fixed words after numbers.
UNITS = b"mm cm m km in ft yd mi mg g kg t oz lb ml l s min h hr hrs ms hz khz mhz ghz kb mb gb tb w kw mw v kv j kj c f k percent dollars euros pounds meters metres kilometers kilometres miles hours minutes seconds days weeks months years degrees grams kilograms liters litres"
#: Items of fewer words are left out.
SHORTEST = 3
NUM, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


def template(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's template hash, and whether it is a slot."""
    n = len(w.first)
    if not n:
        return w.hash, np.zeros(0, bool)
    digits = np.concatenate([[0], np.cumsum(DIGIT[w.buf])])
    number = digits[w.after] - digits[w.first] == w.after - w.first
    ends = np.concatenate([[0], np.cumsum(ENDS[w.buf])])
    new = np.ones(n, bool)
    new[1:] = (w.text[1:] != w.text[:-1]) | (ends[w.first[1:]] > ends[w.after[:-1]])
    initial, second = w.buf[w.first], w.buf[np.minimum(w.first + 1, len(w.buf) - 1)]
    upper = UPPER[initial] | (initial == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    capitals = np.concatenate([[0], np.cumsum(UPPER[w.buf])])
    shouted = capitals[w.after] - capitals[w.first] > 1
    name = upper & ~new & ~shouted
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~new[1:] & np.isin(w.hash[1:], unit_hashes())
    h = w.hash.copy()
    h[number], h[name], h[unit] = NUM, NAME, UNIT
    return h, number | name | unit


def unit_hashes() -> np.ndarray:
    return next(buffers([UNITS], INSIDE))[1].hash


class Items:
    """Windows of some benchmark items: of raw words for all of them, of template words where half of a window or more is literal."""

    def __init__(self, rows: list[tuple[int, str]], window: int = 8, least: int = 5):
        self.window = window
        self.ids, self.hash, self.slot, self.value = [], [], [], []
        # by kind (template or raw): keys, items, places, sizes
        made = {False: ([], [], [], []), True: ([], [], [], [])}
        for item, text in rows:
            t, v, s = [np.concatenate(x) for x in zip(*[(*template(w), w.hash) for _, w in buffers([(text or "").encode()], INSIDE)])] if text else ([], [], [])
            if len(t) < SHORTEST:
                continue
            n = min(window, len(t))
            literal = n - np.convolve(v, np.ones(n, int), "valid")
            every = np.arange(len(literal))
            for raw, words, good in ((False, t, every[(literal * 2 >= n) & (len(t) >= least)]), (True, s, every)):
                for own, x in zip(made[raw], (shingles(words, n)[good], np.full(len(good), len(self.ids)), good, np.full(len(good), n))):
                    own.append(x)
            self.ids.append(item)
            self.hash.append(t)
            self.slot.append(v)
            self.value.append(s)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.by_size = []
        for raw, columns in made.items():
            key, item, place, size = map(cat, columns, (np.uint64, np.int64, np.int64, np.int64))
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                own = own[np.argsort(key[own], kind="stable")]
                self.by_size.append((raw, n, key[own], item[own], place[own]))

    def found(self, texts: list[bytes]) -> dict[int, dict[int, int]]:
        """For each contaminated text its items, with the number of words covered."""
        out: dict[int, dict[int, int]] = {}
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for start, w in buffers(texts, INSIDE):
            t, v = template(w)
            alone = len(t) and w.text[-1] == 0
            if held and not (alone and held[0][0] == start):
                self._judge(held, out)
                held = []
            if alone:  # perhaps one of several parts of a long text
                held.append((start, t, v, w.hash))
            else:
                self._match(t, v, w.hash, w.text, start, out)
        self._judge(held, out)
        return out

    def _judge(self, held, out) -> None:
        if held:
            t, v, s = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            self._match(t, v, s, np.zeros(len(t), np.int64), held[0][0], out)

    def _match(self, t, v, s, text, start, out) -> None:
        hits = defaultdict(set)
        made = {}
        for raw, n, key, item, place in self.by_size:
            if len(t) < n:
                continue
            if (raw, n) not in made:
                made[raw, n] = shingles(s if raw else t, n)
            k = made[raw, n]
            at = np.searchsorted(key, k)
            at[at == len(key)] = 0
            pos = np.flatnonzero((key[at] == k) & (text[n - 1 :] == text[: len(k)]))
            for p in pos.tolist():
                i = int(np.searchsorted(key, k[p]))
                while i < len(key) and key[i] == k[p]:
                    hits[int(text[p]), int(item[i]), p - int(place[i])].add((int(place[i]), n, raw))
                    i += 1
        for (d, i, offset), windows in hits.items():
            n = self._covered(i, d, offset, windows, t, s, text)
            if n:
                own = out.setdefault(start + d, {})
                own[self.ids[i]] = max(own.get(self.ids[i], 0), n)

    def _covered(self, i: int, d: int, offset: int, windows: set[tuple[int, int, bool]], t: np.ndarray, s: np.ndarray, text: np.ndarray) -> int:
        """How many words of item i are covered on one alignment where these windows were found, 0 if that's too few; see the module's docstring."""
        size, slot = len(self.hash[i]), self.slot[i]
        raw = sorted(w for w in windows if w[2])
        mostly = sorted(w for w in windows if not w[2] and 4 * int(slot[w[0] : w[0] + w[1]].sum()) <= w[1])

        def cover(chosen):
            words, forth, back = set(), {}, {}
            for place, n, _ in chosen:
                slots = {(int(self.value[i][q]), int(s[offset + q])) for q in range(place, place + n) if slot[q]}
                alike = len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots)
                if alike and all(forth.get(a, b) == b and back.get(b, a) == a for a, b in slots):
                    forth.update(slots)
                    back.update((b, a) for a, b in slots)
                    words.update(range(place, place + n))
            return words

        half = min(13, (size + 1) // 2)
        most = max((len(cover(x)) for x in ((mostly, raw + mostly) if raw else (mostly,)) if x), default=0)
        best = most if most >= half else 0
        if not best:
            # windows of fewer literal words have no key of their own, but the alignment is known here
            q = np.arange(max(0, -offset), min(size, len(t) - offset))
            same = np.zeros(size, bool)
            same[q] = (text[offset + q] == d) & ((t[offset + q] == self.hash[i][q]) | (s[offset + q] == self.value[i][q]))
            n = min(self.window, size)
            equal = [(p, n, False) for p in np.flatnonzero(np.convolve(same, np.ones(n, int), "valid") == n).tolist()]
            words = cover(raw + mostly + [w for w in equal if w not in mostly])
            literal = sum(not slot[q] for q in words)
            if len(words) >= min(13, max(size - 1, min(size, self.window))) and 4 * literal >= 3 * half and literal >= 4:
                best = len(words)
        return best


def blocks(items: DataFrame, item: str, text: str, window: int, block: int) -> Iterator[Items]:
    """The benchmark in parts of at most `block` words."""
    held, size = [], 0
    for r in items.select(item, text).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") // 4 + 1
        if size >= block:
            yield Items(held, window)
            held, size = [], 0
    if held:
        yield Items(held, window)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, block: int = 1 << 20) -> DataFrame:
    """The documents that hold an item: key, item_ids (sorted), n_words (the most words of an item that are covered)."""
    schema = T.StructType([docs.schema[key], T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType())])
    carried = T.StructType([docs.schema[key], docs.schema[text], *schema.fields[1:]])
    out = docs.select(key, text, F.array().cast("array<long>").alias("item_ids"), F.lit(0).cast("long").alias("n_words"))
    # every row takes what earlier blocks found with it, so rows are never grouped
    for own in blocks(items, item, item_text, window, block):

        def run(batches, own=own):
            claim("decontaminate")
            for b in slices(batches, 1, 4 << 20):
                hit = own.found([(t or "").encode() for t in b.column(1).to_pylist()])
                ids, most = b.column(2).to_pylist(), b.column(3).to_pylist()
                for r, found in hit.items():
                    ids[r], most[r] = sorted({*ids[r], *found}), max(most[r], *found.values())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(most, pa.int64())], names=carried.names)

        out = out.mapInArrow(run, carried)
    return out.where("n_words > 0").select(*schema.names)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, block: int = 1 << 20) -> DataFrame:
    """docs without the contaminated ones, in one pass per block of items."""
    at = docs.columns.index(text)
    for own in blocks(items, item, item_text, window, block):

        def run(batches, own=own):
            claim("decontaminate")
            for b in slices(batches, at, 4 << 20):
                hit = own.found([(t or "").encode() for t in b.column(at).to_pylist()])
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)])) if hit else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
