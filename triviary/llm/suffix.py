"""Suffix arrays in numpy: Larsson-Sadakane refinement, and common prefixes after Kasai."""

from __future__ import annotations

import numpy as np

U = np.uint64


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer, zeros beyond the end."""
    t = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | t[j : j + len(text)]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order; a suffix comes before those that it begins.

    Groups of suffixes that agree in their first h bytes are split by the groups of the suffixes h further; only groups of more than one
    are sorted again, and h doubles. Group, next group and suffix are packed into one integer each while three of them fit, as sorting
    integers is several times faster than sorting their places.
    """
    n = len(text)
    bits = max(1, n.bit_length())
    packed = 3 * bits + 1 <= 64

    def ordered(key: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s in the order of the keys, and where a new key begins."""
        if packed:
            both = np.sort((key << U(bits)) | s.astype(U))
            key, s = both >> U(bits), (both & U((1 << bits) - 1)).astype(kind)
        else:
            order = np.argsort(key)
            key, s = key[order], s[order].astype(kind)
        fresh = np.ones(len(s), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        return s, fresh

    kind = np.int32 if n < 2**31 - 1 else np.int64
    # symbols from 1; 0 stands beyond the end
    there = np.flatnonzero(np.bincount(text, minlength=256))
    symbol = np.zeros(256, U)
    symbol[there] = np.arange(1, len(there) + 1)
    width = max(1, len(there).bit_length())
    h = max(1, (64 - (bits if packed else 0)) // width)
    own = np.concatenate([symbol[text], np.zeros(h, U)])
    key = np.zeros(n, U)
    for j in range(h):
        key = (key << U(width)) | own[j : j + n]
    sa, new = ordered(key, np.arange(n))
    rank = np.zeros(n + 1, kind)  # of the suffix beyond the end: 0; of others the first place of their group, from 1
    starts = np.flatnonzero(new)
    rank[sa] = np.repeat(starts + 1, np.diff(np.append(starts, n)))
    at = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(at):
        s = sa[at]
        key = (rank[s].astype(U) << U(bits)) | rank[np.minimum(s + h, n)].astype(U)
        s, fresh = ordered(key, s)
        sa[at] = s
        rank[s] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))] + 1
        at = at[~fresh | np.append(~fresh[1:], False)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, fixed: np.ndarray) -> np.ndarray:
    """For each place in the suffix array but the first, the common prefix with the place before, exact up to `cap`.

    In text order a suffix shares at most one byte less with its predecessor than the suffix before did; exactly one less unless the preceding
    bytes differ. So only suffixes whose preceding bytes differ, and the positions in `fixed`, are compared; the rest follow. `fixed` must name a
    position in every `cap` bytes, as comparisons end there.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    inner = np.flatnonzero(phi[1:] > 0) + 1
    own[inner] = text[inner - 1] != text[phi[inner] - 1]
    own[fixed] = True
    at = np.flatnonzero(own & (phi >= 0))
    with_ = phi[at]
    length = np.zeros(len(at), np.int64)
    first = np.concatenate([eights(text), np.zeros(8, np.uint64)])
    live = np.arange(len(at))
    while len(live):
        a, b = at[live] + length[live], with_[live] + length[live]
        fit = (a + 8 <= n) & (b + 8 <= n)
        same = fit & (first[np.minimum(a, n)] == first[np.minimum(b, n)])
        stop = live[~same]
        for _ in range(8):  # the last bytes one by one
            a, b = at[stop] + length[stop], with_[stop] + length[stop]
            ok = (a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            stop = stop[ok]
            length[stop] += 1
        live = live[same]
        length[live] += 8
        live = live[length[live] < cap]
    plcp = np.full(n, -1, np.int64)
    plcp[at] = length + at
    plcp = np.maximum.accumulate(plcp) - np.arange(n)
    plcp[phi < 0] = 0
    return np.maximum(plcp[sa[1:]], 0)
