import random
import re

from pyspark.sql import functions as F

from triviary.llm import decontaminate as D

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and reaches the coast after Anna waits 3 hours at the old station. How far is it?"),
    (2, "the quick brown fox jumps over the lazy dog while nobody in the village looks at it"),
    (3, "too short"),
    (4, None),
]


def run(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_ids string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    hit = {r.doc_id: r.item_ids for r in D.contaminated(docs, items, **kw).collect()}
    kept = sorted(r.doc_id for r in D.clean(docs, items, **kw).collect())
    assert kept == [i for i in range(len(texts)) if i not in hit]
    return hit


def test_cases(spark):
    filler = " ".join(random.Random(0).choice(["one", "two", "red", "blue"]) for _ in range(300))
    texts = [
        f"{filler}. {ITEMS[0][1]} {filler}",
        # other numbers and names, used alike
        f"{filler}. A train leaves Dallas at 75 km per hour and reaches the coast after Maria waits 5 hours at the old station. How far is it?",
        "THE QUICK brown fox jumps over the lazy dog while nobody in the village looks at it, " + filler,
        "the quick brown fox is here, and the lazy dog looks at it while nobody jumps",
        None,
        "",
        "too short",
        filler,
        filler + " " + ITEMS[1][1] + " " + ITEMS[0][1],
    ]
    want = {0: [1], 1: [1], 2: [2], 8: [1, 2]}
    assert run(spark, texts) == want
    assert run(spark, texts, block=1) == want  # item by item


def test_slots_must_agree():
    items = D.Items([(1, "pay 5 coins to the man at the gate then pay 5 coins to the man at the door")])
    good = b"pay 7 coins to the man at the gate then pay 7 coins to the man at the door"
    bad = b"pay 7 coins to the man at the gate then pay 8 coins to the man at the door"
    assert items.found([good])[0][1] == 19
    assert items.found([bad])[0][1] < 19


def test_long_text_and_empty_tables(spark):
    t = ("lorem ipsum " * 200_000 + ITEMS[1][1]).encode()
    assert D.Items(ITEMS).found([b"x", t, b"y"]) == {1: {2: 17}}
    cut = b"lorem " * 349_525 + ITEMS[1][1].encode() + b" lorem" * 1000  # the item crosses a buffer's end
    assert list(D.Items(ITEMS).found([cut])) == [0]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == 1


def test_whole_items_in_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows, bench = docs.select("doc_id", "text").collect(), items.collect()
    want = {r.doc_id for r in rows if any(b.text in (r.text or "") for b in bench)}
    assert {r.doc_id for r in D.contaminated(docs, items).select(F.col("doc_id")).collect()} == want


DENSE = [
    (1, "What is 48 plus 17 minus 5 times 3?"),
    (2, "Tom has 12 apples and Ann has 15 apples."),
    (3, "Who was the wife of John Smith?"),
    (4, "Natalia sold 48 clips in April, and Mia sold 24 in May."),
    (5, "What is 6 times 7?"),
    (6, "Capital of Peru?"),
    (7, "Sort 9 4 8 1 7 2 6 3 5 and 10"),
]


def test_items_full_of_slots_and_short_items():
    items = D.Items(DENSE)
    filler = "nothing of note is in these lines of prose " * 20
    for i, t in DENSE:
        assert items.found([f"{filler}. {t} {filler}".encode()])[0].keys() == {i}
        assert items.found([f"{filler}, {t.lower()} {filler}".encode()])[0].keys() == {i}  # without capitals
        assert items.found([f'{filler} he asked "{t}" {filler}'.encode()])[0].keys() == {i}
    others = [
        b"What is 23 plus 9 minus 2 times 7?",
        b"Bob has 3 apples and Eve has 7 apples.",
        b"Who was the wife of Peter Pan?",
        b"Olga sold 7 clips in June, and Ida sold 9 in July.",
    ]
    assert {d: set(x) for d, x in items.found(others).items()} == {0: {1}, 1: {2}, 2: {3}, 3: {4}}
    clean = [b"What is 23 plus 9 minus 9 times 7?", b"What is 3 times 4?", b"Capital of Chile?", b"Sort 1 2 3 4 5 6 7 8 9 and 11", b"1 2 3 4 5 6 7 8 9 10 11 12", b"Who was the King of John Smith?", filler.encode()]
    assert items.found(clean) == {}


def test_repeated_rows_are_judged_each_in_any_number_of_blocks(spark):
    both = f"{ITEMS[0][1]} {ITEMS[1][1]}"
    docs = spark.createDataFrame([(1, both), (1, both), (1, ITEMS[1][1]), (None, both), (None, ITEMS[0][1]), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted([(1, [1, 2]), (1, [1, 2]), (1, [2]), (None, [1, 2]), (None, [1])], key=repr)
    for block in (1, 1 << 20):
        assert sorted(((r.doc_id, r.item_ids) for r in D.contaminated(docs, items, block=block).collect()), key=repr) == want


def brute_template(text):
    """(raw word, template word, is a slot) of each word, by regular expressions."""
    units = set(D.UNITS.decode().split())
    out, end = [], 0
    for m in re.finditer(r"[0-9A-Za-z]+", text):
        w = m[0]
        new = not out or bool(re.search(r"[.!?:\n]", text[end : m.start()]))
        end = m.end()
        if w.isdigit():
            kind = "#num"
        elif w[0].isupper() and not new and sum(c.isupper() for c in w) == 1:
            kind = "#name"
        elif out and out[-1][1] == "#num" and not new and w.lower() in units:
            kind = "#unit"
        else:
            kind = w.lower()
        out.append((w.lower(), kind, kind[0] == "#"))
    return out


def brute_match(item, doc, window=8, least=5):
    """Whether an alignment of the two satisfies a rule of the module's docstring; every alignment is tried."""
    size = len(item)
    if size < D.SHORTEST:
        return False
    n = min(window, size)
    half = min(13, (size + 1) // 2)

    def cover(places, o):
        words, forth, back = set(), {}, {}
        for p in places:
            slots = {(item[q][0], doc[o + q][0]) for q in range(p, p + n) if item[q][2]}
            alike = len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots)
            if alike and all(forth.get(a, b) == b and back.get(b, a) == a for a, b in slots):
                forth.update(slots)
                back.update((b, a) for a, b in slots)
                words.update(range(p, p + n))
        return words

    for o in range(-size, len(doc)):
        inside = [p for p in range(size - n + 1) if 0 <= o + p and o + p + n <= len(doc)]
        raw = [p for p in inside if all(item[p + i][0] == doc[o + p + i][0] for i in range(n))]
        same = [p for p in inside if all(item[p + i][1] == doc[o + p + i][1] for i in range(n))]
        literal = lambda p: sum(not item[p + i][2] for i in range(n))
        found = [p for p in same if 2 * literal(p) >= n and size >= least]
        mostly = [p for p in found if 4 * literal(p) >= 3 * n]
        if not raw and not found:
            continue
        if max(len(cover(x, o)) for x in ((mostly, raw + mostly) if raw else (mostly,))) >= half:
            return True
        either = [p for p in inside if all(item[p + i][0] == doc[o + p + i][0] or item[p + i][1] == doc[o + p + i][1] for i in range(n))]
        words = cover(raw + mostly + [p for p in either if p not in mostly], o)
        said = sum(not item[q][2] for q in words)
        if len(words) >= min(13, max(size - 1, min(size, window))) and 4 * said >= 3 * half and said >= 4:
            return True
    return False


def test_against_every_alignment():
    """Random questions full of numbers, names and units in documents that hold them changed: the same answers as a plain search."""
    rnd = random.Random(9)
    pick = lambda: rnd.choice(["the", "man", "pays", "for", "at", "gate", "with", "coins", "km", "hours", "Anna", "Bob", "Oslo", "12", "7", "30", "each", "then"])
    sentence = lambda n: " ".join(pick() for _ in range(n))
    items = [(i, sentence(rnd.choice([1, 3, 4, 5, 7, 8, 10, 16, 24]))) for i in range(40)]
    swap = {"Anna": "Carl", "Bob": "Dora", "Oslo": "Rome", "12": "45", "7": "9", "30": "31"}
    docs = []
    for k in range(160):
        words = items[k % 40][1].split()
        kind = k % 4
        if kind == 1:
            words = [swap.get(w, w) for w in words]
        elif kind == 2:
            words = [rnd.choice(list(swap.values())) if w in swap and rnd.random() < 0.5 else w for w in words]
        elif kind == 3 and len(words) > 4:
            words[rnd.randrange(len(words))] = "odd"
        docs.append(f"so {sentence(6)} so {' '.join(words)} so {sentence(6)}")
    got = D.Items(items).found([d.encode() for d in docs])
    parsed, texts = {i: brute_template(t) for i, t in items}, [brute_template(d) for d in docs]
    for d, t in enumerate(texts):
        assert set(got.get(d, ())) == {i for i, _ in items if brute_match(parsed[i], t)}, docs[d]
