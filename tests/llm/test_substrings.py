import hashlib
import random
import re

import numpy as np
import pytest

from triviary.llm import substrings
from triviary.llm.suffix import common_prefixes, suffix_array


def brute(rows, length):
    seen = {}
    for d, t in enumerate(t for _, t in rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    cover = [bytearray(len((t or "").encode())) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + length] = b"\1" * length
    out = []
    for (k, t), c in zip(rows, cover):
        b = (t or "").encode()
        kept = bytes(x for x, gone in zip(b, c) if not gone)
        runs = sum(c[i] and (not i or not c[i - 1]) for i in range(len(c)))
        out.append((k, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage, line = text(90), text(33)
    rows = []
    for _ in range(60):
        parts = [text(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            a, z = sorted(rnd.randint(0, 90) for _ in range(2))
            parts += [rnd.choice([passage, passage[a:z], line, "ab" * rnd.randint(0, 60)]), text(rnd.randint(0, 30))]
        rows.append("".join(parts))
    rows += [rows[0], rows[0], rows[1] + "x", None, "", "short", "z" * 500]
    return list(enumerate(rows))


def digests(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", substrings.F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in substrings.digests(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("per_shard", [2000, 4])
def test_against_brute_force(spark, per_shard):
    for seed in (0, 1):
        rows = corpus(seed)
        assert digests(spark, rows, length=40, gram=20, per_shard=per_shard) == brute(rows, 40)


def test_repeated_and_null_keys(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(100))
    rows = [(1, t), (1, t), (None, t[10:80]), (2, None), (2, "x")]
    assert digests(spark, rows, length=40, gram=20) == brute(rows, 40)
    assert substrings.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_removed_keeps_columns(spark):
    t = "".join(random.Random(2).choice("abcdef") for _ in range(60))
    df = spark.createDataFrame([(1, "é" + t, 5), (2, t + "ü", 6), (3, None, 7)], "doc_id long, text string, spans int")
    got = sorted(tuple(r) for r in substrings.removed(df, length=40, gram=20).collect())
    assert got == [(1, "é", 5), (2, "ü", 6), (3, None, 7)]


def test_suffix_arrays():
    rnd = random.Random(3)
    for trial in range(150):
        b = bytes(rnd.choice(b"ab\x00c" if trial % 2 else b"ab") for _ in range(rnd.randint(1, 200))) * (3 if trial % 3 == 0 else 1)
        t = np.frombuffer(b, np.uint8)
        sa = suffix_array(t)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        common = []
        for x, y in zip(want, want[1:]):
            k = 0
            while x + k < len(b) and y + k < len(b) and b[x + k] == b[y + k]:
                k += 1
            common.append(k)
        assert common_prefixes(t, sa, 10**6, np.array([0])).tolist() == common


def brute_passages(rows, words, least):
    """Passages of whole words inside the runs of strings of `least` bytes that stand in another text."""
    raws = [(t or "").encode() for _, t in rows]
    held = {}
    for d, b in enumerate(raws):
        for i in range(len(b) - least + 1):
            held.setdefault(b[i : i + least], set()).add(raws[d])
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if len(held[b[i : i + least]]) > 1:
                cover[i : i + least] = b"\1" * least
        at = [m.span() for m in re.finditer(rb"\S+", b)]
        whole = [all(cover[x:z]) for x, z in at]
        n, run = 0, 0
        for k, ok in enumerate(whole):
            joined = k and all(cover[at[k - 1][1] : at[k][0]])
            if not joined:
                n, run = n + (run >= words), 0
            run += ok
        out.append(n + (run >= words))
    return out


def test_passages_of_words(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short, own = text(14), text(7), text(12)
    rows = [text(30) for _ in range(20)] + [f"{text(9)} {long} {text(8)}", f"{long} {text(4)}", f"{text(6)} {long}", f"{text(5)} {short} {text(9)}", f"{short} {text(3)}", f"{own} {text(5)} {own}", None, "", "x"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("passages", substrings.F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_passages) for r in substrings.digests(df, length=400, words=10, least=20).collect()}
    want = brute_passages(rows, 10, 20)
    assert [got[i][1] for i in range(len(rows))] == want
    assert want[20:] == [1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert {n for n, _ in got.values()} == {0}
    left = {r.doc_id: r.text for r in substrings.removed(df, length=20, words=10, across=True).collect()}
    assert [left[i] for i in (23, 24, 25, 26, 27)] == [rows[i][1] for i in (23, 24, 25, 26, 27)]
    assert all(long not in left[i] for i in (20, 21, 22))


def test_long_texts_are_cut_into_windows(spark):
    """Memory follows the window: a text of 50 MB beside one that shares 500 bytes with it, over the border of two windows."""
    rnd = random.Random(7)
    block = bytes(rnd.choices(b"abcdefghijklmnop ", k=1 << 16)).decode()
    long = "".join(f"{i:08d}" + block for i in range(763))
    a = 3 * substrings.BUFFER - 250
    unique = bytes(rnd.choices(b"qrstuvwxyz", k=500)).decode()
    long = long[:a] + unique + long[a + 500 :]
    peak = []
    for own, offset, held in substrings.pieces([long.encode()], substrings.BUFFER, 400):
        peak.append(sum(map(len, held)))
    assert max(peak) <= substrings.BUFFER + 399 and len(peak) == -(-len(long) // substrings.BUFFER)
    df = spark.createDataFrame([(1, long[a - 70_000 : a + 70_000]), (2, "_" * 300 + unique + "!" * 300)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.digests(df).collect()}
    assert got[2].n_removed == 500 and got[2].n_spans == 1


def test_windows_do_not_change_the_result(spark, monkeypatch):
    for seed in (2, 3):
        rows = corpus(seed)
        monkeypatch.setattr(substrings, "BUFFER", 64)
        parts = {}
        for own, offset, held in substrings.pieces([(t or "").encode() for _, t in rows], 64, 40):
            bounds = np.concatenate([[0], np.cumsum(list(map(len, held)))])
            text, low, high, h, ctx = substrings.anchors(np.frombuffer(b"".join(held), np.uint8), bounds, 40, 20)
            for k, x, z in zip(text.tolist(), low.tolist(), high.tolist()):
                parts.setdefault(own[k], []).append((x - int(bounds[k]) + offset[k], z - int(bounds[k]) + offset[k]))
        for i, (_, t) in enumerate(rows):
            n = len((t or "").encode())
            starts = sorted(s for a, z in parts.get(i, []) for s in range(a, z - 39))
            assert starts == list(range(max(0, n - 39)))  # every string of 40 bytes has one anchor


def test_passages_of_scripts_with_and_without_spaces(spark):
    rnd = random.Random(9)
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    word = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared, short, spaced, few = han(400), han(80), word(60), word(45)
    texts = [han(50) + shared + han(50), han(30) + shared + han(20), han(40) + short + han(40), han(20) + short + han(60), f"{word(20)} {spaced} {word(20)}", f"{word(30)} {spaced} {word(9)}", f"{word(20)} {few} {word(20)}", f"{word(30)} {few} {word(9)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in substrings.removed(df, length=substrings.LEAST, words=substrings.WORDS, across=True).collect()}
    for i in (0, 1):
        assert shared[2:-2] not in left[i] and 60 > len(left[i]) - (len(texts[i]) - 400) >= -4
    assert all(left[i] == texts[i] for i in (2, 3, 6, 7))  # 40 words, and 45
    assert all(spaced not in left[i] and len(left[i]) < len(texts[i]) - 350 for i in (4, 5))
    assert substrings.whole_words("ab 漢字漢字 cd".encode(), 0, 18) == 5
