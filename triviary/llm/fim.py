"""Fill-in-middle: a text is cut at two unit borders and its parts are put in another order behind sentinels, reversibly.

One Aho-Corasick automaton over code points finds the sentinels and the ASCII characters that change the class of a text's characters (the line feed for
lines, white space for words). Between two of these events nothing happens, so a gap's units follow from its length: none for lines and words, which end at
events alone, one per code point for characters. The sparse events with their running counts are the rank index in which a unit's border is looked up by
binary search.

Units: "lines" `[^\\n]*\\n|[^\\n]+`, "words" `[^\\s]*[\\s]+|[^\\s]+` over \\x20 and \\x09-\\x0D (a word with the white space behind it), "chars" one code point.

The draws come from the first four 8-digit groups h1 to h4 of the hex SHA-256 of `seed:key`: of n units the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1), the middle after the larger. A text is plain if it is empty, holds a sentinel or h3 % 100 >= rate; else it has the form spm if h4 % 100 < spm_rate,
psm otherwise. Sentinels mustn't be empty, hold or overlap each other, so that an output can be taken apart in one way only.

Null texts are empty; a null key counts as an empty one; repeated rows have equal results; an empty table gives no rows; a text of any length is cut as a
whole (its events are kept, 8 bytes each). Only key and text are read, so other columns can have any name; the key mustn't be named like a result (ValueError).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import claim, free, slices

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Unit -> the ASCII characters whose runs end one, and the units of a gap's character.
UNITS = {"lines": ("\n", 0), "words": (" \t\n\x0b\x0c\r", 0), "chars": ("", 1)}
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


@dataclass(frozen=True)
class Form:
    """What a text becomes."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


class Cutter:
    """The automaton of one set of sentinels and one kind of unit."""

    def __init__(self, unit: str = "lines", sentinels: tuple[str, ...] = SENTINELS):
        if unit not in UNITS:
            raise ValueError(f"no unit {unit}; there are {', '.join(UNITS)}")
        for a in sentinels:
            for b in sentinels:
                # a text before or behind a sentinel must never complete another one
                if not a or a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"the sentinels {a!r} and {b!r} overlap")
        if len(set(sentinels)) != 3:
            raise ValueError("three different sentinels are needed")
        self.prefix, self.suffix, self.middle = self.sentinels = sentinels
        self.ends, self.per_char = UNITS[unit]
        self.merges = len(self.ends) > 1  # adjacent events end one unit together
        self.machine = ahocorasick.Automaton()
        for c in self.ends:
            self.machine.add_word(c, "")
        for s in sentinels:
            self.machine.add_word(s, s)
        self.machine.make_automaton()

    def events(self, text: str) -> tuple[list[int], list[tuple[int, str]]]:
        """Where units end by an event (exclusive, rising), and where sentinels begin."""
        ends: list[int] = []
        marks: list[tuple[int, str]] = []
        for at, mark in self.machine.iter(text):
            if mark:
                marks.append((at + 1 - len(mark), mark))
            elif self.merges and ends and ends[-1] == at:
                ends[-1] = at + 1
            else:
                ends.append(at + 1)
        return ends, marks

    def count(self, text: str, ends: list[int]) -> int:
        """The units of a text: those that end by events, and those of the gaps or of the rest behind the last event."""
        if self.per_char:
            return len(text) * self.per_char
        return len(ends) + ((ends[-1] if ends else 0) < len(text))

    def border(self, text: str, ends: list[int], k: int) -> int:
        """Where the first k units end."""
        if self.per_char:
            return k // self.per_char
        return 0 if not k else ends[k - 1] if k <= len(ends) else len(text)

    def cut(self, text: str, key: str, seed: int, rate: int, spm_rate: int) -> Form:
        ends, marks = self.events(text)
        n = self.count(text, ends)
        digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not text or marks or h3 % 100 >= rate:
            return Form(n, "plain", None, None, text)
        i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = self.border(text, ends, i), self.border(text, ends, j)
        p, m, s = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_rate:
            return Form(n, "spm", a, b - a, f"{self.suffix}{s}{self.prefix}{p}{self.middle}{m}")
        return Form(n, "psm", a, b - a, f"{self.prefix}{p}{self.suffix}{s}{self.middle}{m}")

    def restore(self, output: str, form: str) -> str:
        """The text, from its output and form alone."""
        if form == "plain":
            return output
        marks = self.events(output)[1]
        order = [self.suffix, self.prefix, self.middle] if form == "spm" else [self.prefix, self.suffix, self.middle]
        if [m for _, m in marks] != order:
            raise ValueError(f"not an output of the form {form}")
        stops = [at for at, _ in marks[1:]] + [len(output)]
        part = {m: output[at + len(m) : z] for (at, m), z in zip(marks, stops)}
        return part[self.prefix] + part[self.middle] + part[self.suffix]

    def unit_of(self, text: str, at: int) -> int:
        """The number of the unit that the code point at `at` lies in: the rank of a place among the events."""
        return at * self.per_char if self.per_char else bisect_left(self.events(text)[0], at + 1)


@lru_cache(4)
def cutter(unit: str, sentinels: tuple[str, ...]) -> Cutter:
    return Cutter(unit, sentinels)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", *, unit: str = "lines", sentinels: tuple[str, ...] = SENTINELS, seed: int = 7, rate: int = 100, spm_rate: int = 50, digests: bool = False) -> DataFrame:
    """Per row: key, n, form, prefix_chars, middle_chars, output, restored. With `digests` the last two are SHA-256 digests, named output_sha256 and restored_sha256.

    One pass without a shuffle; restored is read back from output and form.
    """
    cutter(unit, sentinels)  # raises here, not on an executor
    names = [*RESULTS[:4], *(f"{c}_sha256" if digests else c for c in RESULTS[4:])]
    free(docs.select(key), *names)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([docs.schema[key], *(T.StructField(n, k) for n, k in zip(names, kinds))])
    arrow = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def told(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest() if digests else s

    def run(batches):
        claim("fim")
        c = cutter(unit, sentinels)
        for b in slices(batches, 1, 2 << 20):
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = c.cut(t or "", "" if k is None else str(k), seed, rate, spm_rate)
                out.append((f.n, f.form, f.prefix_chars, f.middle_chars, told(f.output), told(c.restore(f.output, f.form))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), arrow))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


#: The same in SQL, for lines and the default parameters.
SQL = """WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)::BIGINT], '') AS p, array_to_string(u[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS m, array_to_string(u[greatest(a, b)::BIGINT + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""
