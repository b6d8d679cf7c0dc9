"""Words of many texts at once, as 64-bit hashes, in numpy.

A word's hash is a polynomial of its bytes, taken from running sums over the whole buffer, and mixed. It doesn't depend on
where the word stands. Buffers are cut at word ends, so that memory follows `PIECE` and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; the longest so far are kept."""
    for i, b in enumerate((BASE, INVERSE)):
        if len(_powers[i]) < n:
            p, done = np.empty(n, np.uint64), len(_powers[i])
            p[:done] = _powers[i]
            while done < n:
                more = min(done, n - done)
                p[done : done + more] = p[:more] * np.uint64(pow(b, done, 1 << 64))
                done += more
            _powers[i] = p
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def table(chars: str | bytes | set[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars if not isinstance(chars, str) else chars.encode())] = True
    return t


#: ASCII white space \\x20 \\x09-\\x0D; only A-Z are lowered.
SPACES = table(b" \t\n\x0b\x0c\r")
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """hash, first and after (byte positions in buf) of the words of one buffer, and the text each belongs to."""

    buf: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    after: np.ndarray
    text: np.ndarray


def words_of(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    """The words of the texts buf[bounds[i]:bounds[i + 1]]: runs of bytes for which `inside` holds, lowered."""
    is_in = inside[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = is_in[0]
    np.not_equal(is_in[1:], is_in[:-1], out=edge[1:])
    starts = bounds[1:-1]
    starts = starts[(starts > 0) & (starts < len(buf))]
    # a word ends where its text does
    split = starts[is_in[starts] & is_in[starts - 1]]
    at = np.flatnonzero(edge)
    first, after = at[is_in[at]], at[~is_in[at]]
    if len(split):
        split = np.unique(split)
        first, after = np.sort(np.concatenate([first, split])), np.sort(np.concatenate([after, split]))
    if len(after) < len(first):
        after = np.append(after, len(buf))
    p, inv = powers(max(1 << 16, 1 << int(len(buf)).bit_length()))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    h = mix((total[after] - total[first]) * inv[first] + (after - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(buf, h, first, after, np.searchsorted(bounds, first, side="right") - 1)


def buffers(texts: list[bytes], inside: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, Words]]:
    """The words of all texts, in order, buffer by buffer, with the number of each buffer's first text. A long text has several buffers."""
    held, size, start, long = [], 0, 0, False

    def made():
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
        return start, words_of(np.frombuffer(b"".join(held), np.uint8), bounds, inside)

    for i, t in enumerate(texts):
        if size and size + len(t) > piece:
            yield made()
            held, size = [], 0
        if not held:
            start = i
        while len(t) > piece:  # cut before a byte outside words
            cut = piece
            while cut < len(t) and inside[t[cut]]:
                cut += 1
            held, start = [t[:cut]], i
            yield made()
            held, t, long = [], t[cut:], True
        if long:  # its last part has a buffer of its own
            held, start, long = [t], i, False
            if t:
                yield made()
            held = []
            continue
        held.append(t)
        size += len(t)
    if size:
        yield made()


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    k = len(h) - n + 1
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + k])
    return out
