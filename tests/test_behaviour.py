"""Rules that no table shows: identifiers, grades, streaks, caps, cleaning, sources, streams."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from triviary.functions import scores
from triviary.functions import text as X
from triviary.operators import bank, items, markup, play, ratings, signals
from triviary.operators.containment import holds
from triviary.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def test_identifiers(spark):
    def djb2(s):
        h = 5381
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 33 & 0xFFFFFFFF) ^ int.from_bytes(raw[i : i + 2], "big")
        digits = ""
        while h:
            h, r = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return "q_" + digits

    for s in ("", "Who is it?", "é \U0001f600 x"):
        assert one(spark, X.question_id(F.lit(s))) == djb2(s)
    import hashlib

    q, o = 'Say "x"\n', ["b", "é", "a"]
    assert one(spark, X.content_hash(F.lit(q), arr(*o))) == hashlib.sha256(json.dumps([q, sorted(o)], ensure_ascii=False).encode()).hexdigest()[:16]


def test_names(spark):
    assert one(spark, X.strip_quals(F.lit("Grand Line (Ryugu; x) (former;"))) == "Grand Line"
    assert one(spark, X.primary(arr("None", "Marines, 77th Branch"))) == "Marines"
    assert one(spark, X.primary(arr())) is None
    assert one(spark, X.combined_name(arr("Gum Fruit (VIZ)"), arr("Gomu no Mi"))) == "Gum Fruit / Gomu no Mi"
    assert one(spark, X.combined_name(arr("Gomu"), arr("gomu"))) == "Gomu"
    assert one(spark, X.clean_bounty(arr("Unknown", "999", "3,000,000,000"))) == "3,000,000,000 Berries"
    assert one(spark, X.bounty_amount(arr("3,000,000,000"))) == 3_000_000_000
    assert one(spark, X.current_residence(arr("Downs (former); Spider Miles", "Dressrosa"))) == "Spider Miles"
    assert one(spark, X.near_dupe(F.lit(""), F.lit("x"))) and not one(spark, X.near_dupe(F.lit("ab"), F.lit("bc")))
    assert one(spark, X.leaked(F.lit("Attach Ace"), F.lit("Attachan Palace"))) == ["attach"]
    assert one(spark, X.is_noise(F.lit("Auntnoncanon"))) and one(spark, X.is_noise(F.lit("Toei Animation")))


def test_signals(spark):
    assert one(spark, X.is_numeric_ladder(arr("10 m", "2,000 m", "3 m", "4 m"))) and not one(spark, X.is_numeric_ladder(arr("10 m", "2 km")))
    assert one(spark, X.is_numeric_ladder(arr("Two", "Four"))) and one(spark, X.is_parallel_enumeration(arr("Grove 1", "Grove 79")))
    assert one(spark, X.is_name_like(F.lit("the Sea of Monsters"))) and not one(spark, X.is_name_like(F.lit("she turned invisible")))
    assert one(spark, X.stem_leak(F.lit("The Kuja sailed"), F.lit("Kuja Pirates"), arr("Arlong Pirates")))
    assert one(spark, X.gloss_leak(F.lit("Who makes clothing?"), F.lit("Fuku"), F.lit("Clothes Fruit")))
    assert one(spark, X.answer_len_outlier(F.lit("a very long true answer"), arr("no", "yes")))
    assert one(spark, X.cross_domain(arr("a"), F.array(arr("b", "c"), arr("c")))) and not one(spark, X.cross_domain(arr("a"), F.array(arr("b"), arr("c"))))
    got = spark.createDataFrame([(["Grove 1", "Grove 79"],), ([],)], "o array<string>").select(signals.option_similarity("o")).collect()
    assert abs(got[0][0] - 10 / 13) < 1e-9 and got[1][0] == 0


def test_grades_and_formats(spark):
    for score, grade, said in ((100, "A+", 0), (97, "A+", 0), (89.5, "B+", None), (89, "B+", 1), (60, "D-", 3), (59.9, "F", 4), (0, "F", 4)):
        row = spark.range(1).select(scores.grade(F.lit(float(score))), scores.remarks(F.lit(float(score)))).first()
        assert row[0] == grade and row[1] == (None if said is None else scores.REMARKS[said][2])
    assert one(spark, scores.grade(F.lit(None).cast("double"))) is None
    assert one(spark, scores.clock(F.lit(360_061_000))) == "00:01:01" and one(spark, scores.clock(F.lit(3_661_000))) == "01:01:01"
    assert one(spark, scores.percent(F.lit(1), F.lit(3))) == 33.33 and one(spark, scores.percent(F.lit(0), F.lit(0))) == 0
    assert [one(spark, scores.letter(F.lit(i))) for i in range(5)] == ["A.", "B.", "C.", "D.", None]
    assert one(spark, scores.saga_order(F.lit(100))) == 1 and one(spark, scores.saga_order(F.lit(5000))) == 11
    assert one(spark, scores.signal_penalty(arr("stem_leak", "numeric_ladder", "other"))) == 40
    assert one(spark, scores.profile_name(F.lit("  "))) == "Player" and one(spark, scores.human_bytes(F.lit(1536))) == "1.5 KB"
    for total, right, want in ((4, 4, 0.7), (10, 4, 0.7), (10, 7, 0.25), (10, 8, 0.1)):
        assert one(spark, scores.mix(F.lit(total), F.lit(right)))["easy"] == want


def test_streaks_break_and_return(spark):
    rows = [(1, 1, p, i, i) for i, p in enumerate([1, 1, 0, 1, 1, 1])]
    s = play.progress(spark.createDataFrame(rows, "profile int, qid int, point int, ts int, seq int")).first()
    assert (s.seen, s.correct, s.wrong, s.streak, s.mastered, s.times_mastered) == (6, 5, 1, 3, True, 2)


def plain_state(points):
    streak = times = 0
    for p in points:
        was, streak = streak >= 2, streak + 1 if p else 0
        times += streak >= 2 and not was
    return len(points), sum(points), streak, streak >= 2, times


def test_summaries_merge_in_any_grouping(spark):
    rnd = random.Random(0)
    rows, want = [], {}
    for q in range(60):
        points = [int(rnd.random() < rnd.choice([0.2, 0.7, 0.95])) for _ in range(rnd.choice([1, 2, 3, 30, 90]))]
        want[q] = plain_state(points)
        rows += [(1, q, p, i // 2, i) for i, p in enumerate(points)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "profile int, qid int, point int, ts int, seq int")
    for size in (7, 100, 1 << 16):
        got = {r.qid: (r.seen, r.correct, r.streak, r.mastered, r.times_mastered) for r in play.progress(df, size=size).collect()}
        assert got == want
    parts = play.summarised(df, size=50).cache()
    left, right = (play.folded(parts.where(f"chunk {x} 5")).withColumn("chunk", F.lit(x)) for x in ("<", ">="))
    halves = play.folded(left.unionByName(right).withColumn("chunk", F.when(F.col("chunk") == "<", 0).otherwise(1)))
    assert {r.qid: (r.seen, r.correct, r.streak, r.mastered, r.times_mastered) for r in play.states(halves).collect()} == want
    assert play.progress(df.limit(0)).count() == 0


def test_a_hot_question_is_spread_over_tasks(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("profile"), F.lit(7).alias("qid"), (F.col("id") % 3 != 0).cast("int").alias("point"), F.col("id").alias("ts"), F.col("id").alias("seq"))
    parts = play.summarised(df)
    assert parts.count() >= 15 and parts.select(F.max("s.seen")).first()[0] < 90_000
    s = play.progress(df).first()
    assert (s.seen, s.correct, s.streak, s.times_mastered) == (1_000_000, 666_666, 0, 333_333)
    plan = play.progress(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_caps_equal_the_ordered_pass(spark):
    keys = {"a": "ca", "b": "cb", "c": "cc"}
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, rnd.randrange(8), 3, rnd.randrange(15), rnd.choice([2, 5]), rnd.randrange(3), 12) for i in range(120)]
        df = spark.createDataFrame(rows, "ord long, a int, ca int, b int, cb int, c int, cc int")
        used, want = {}, []
        for r in rows:
            own = [("a", r[1], r[2]), ("b", r[3], r[4]), ("c", r[5], r[6])]
            if all(used.get(k[:2], 0) < k[2] for k in own):
                want.append(r[0])
                for k in own:
                    used[k[:2]] = used.get(k[:2], 0) + 1
        read = []
        assert sorted(r.ord for r in items.capped(df, keys, "ord", read).collect()) == want
        # later rounds read undecided rows alone, fewer each time
        assert read[0] == len(rows) and all(a > b for a, b in zip(read, read[1:]))
    assert items.capped(df.limit(0), keys, "ord").count() == 0


def test_caps_ask_of_few_rows_whether_they_stand(spark):
    keys = {"a": "ca", "b": "cb", "c": "cc"}
    for seed, falls in ((0, lambda i: False), (1, lambda i: i % 3 == 0), (2, lambda i: i % 7 > 0), (3, lambda i: i < 380), (4, lambda i: True)):
        rnd = random.Random(seed)
        rows = [(i, rnd.randrange(8), 3, rnd.randrange(15), rnd.choice([2, 5]), rnd.randrange(3), 12, falls(i)) for i in range(400)]
        df = spark.createDataFrame(rows, "ord long, a int, ca int, b int, cb int, c int, cc int, falls boolean")
        used, want = {}, []
        for r in rows:
            own = [("a", r[1], r[2]), ("b", r[3], r[4]), ("c", r[5], r[6])]
            if not r[7] and all(used.get(k[:2], 0) < k[2] for k in own):
                want.append(r[0])
                for k in own:
                    used[k[:2]] = used.get(k[:2], 0) + 1
        asked = []
        stand = lambda d: asked.extend(r.ord for r in d.collect()) or d.where("not falls").withColumn("more", F.col("ord") + 1)
        got = items.capped(df, keys, "ord", check=stand).collect()
        assert sorted(r.ord for r in got) == want and all(r.more == r.ord + 1 for r in got)
        assert len(asked) == len(set(asked))
        if seed < 2:
            assert len(asked) < 100
    assert "more" in items.capped(df.limit(0), keys, "ord", check=stand).columns


def test_distractors_beyond_the_prefix(spark):
    pool = spark.createDataFrame([("p", v, v, None, None, i) for i, v in enumerate(["aa", "aab", "aac", "bb", "cc"])], "pool string, v string, norm_v string, tier int, saga int, ord long")
    q = spark.createDataFrame([(1, "p", "zz", None, None, None)], "id long, pool string, answer string, leak_ref string, tier int, saga int")
    c = items.candidates(q, pool, "s")
    assert items.distractors(c, 3, 64).first().distractors == items.distractors(c, 3, 1).first().distractors
    got = items.distractors(c).first().distractors
    assert len(got) == 3 and {"bb", "cc"} < set(got)


def test_templates_in_one_pass():
    leaf = re.compile(r"\{\{((?:(?!\{\{|\}\}).)*)\}\}", re.DOTALL)

    def in_passes(text):
        for _ in range(markup.PASSES):
            text = leaf.sub(lambda m: markup.rendered(m[1]), text)
        return text

    def nested(tokens):
        """The tokens after the innermost pairs are rendered, level by level; what is rendered is a token that is no brace."""
        for _ in range(markup.PASSES):
            new = []
            for t in tokens:
                new.append(t)
                at = max((i for i, x in enumerate(new[:-1]) if x in ("{{", "}}") or x is None), default=None) if t == "}}" else None
                if at is not None and new[at] == "{{":
                    new[at:] = [(markup.rendered("".join(x[0] if isinstance(x, tuple) else x for x in new[at + 1 : -1])),), None]
            tokens = [x for x in new if x is not None]
        return "".join(x[0] if isinstance(x, tuple) else x for x in tokens)

    rng = random.Random(3)
    words = ["|", "a", "w|", "Ruby|", "Qref|", "k=", "[[", "]]", " ", "\n"]
    for _ in range(20000):
        # pairs apart from each other and no single braces: the passes see the same pairs
        text = "".join(rng.choice(["{{" + rng.choice(words), rng.choice(words) + "}}", *words]) for _ in range(rng.randrange(1, 25)))
        assert markup.render(text) == in_passes(text), text
    for _ in range(5000):
        text = "".join(rng.choice(["{{", "}}", "{{", "}}", "{", "}", *words]) for _ in range(rng.randrange(1, 20)))
        assert markup.render(text) == nested(re.findall(r"\{\{|\}\}|.", text, re.DOTALL)), text
    for depth in (1, 11, 12, 13, 14, 30):
        for text in ("{{w|" * depth + "x" + "}}" * depth, "{{w|y {{Ref|1}}" * depth + "x" + "}}" * depth, "{{w|" * depth + "x" + "}}" * (depth // 2)):
            assert markup.render(text) == in_passes(text)
    assert markup.render("{{{{w|x}}|y}}") == "y" and markup.render("") == "" and markup.render("}}{{") == "}}{{"


def test_templates_cost_as_much_as_their_text():
    cost = {}
    for n in (20000, 80000):
        nested = "{{w|a " * n + "x" + " b}}" * n
        began = time.process_time()
        assert len(markup.spans(nested)) == n and "x" in markup.render(nested)
        cost[n] = time.process_time() - began
    # four times the text; work per level of nesting would make it sixteen
    assert cost[80000] < 10 * cost[20000] + 0.2


def test_keys_inside_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), "".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 30])))) for _ in range(300)]
    long = "".join(rng.choice("abc") for _ in range(500))
    rows += [("x", long), ("x", long[100:400]), ("x", long[100:399] + "d"), ("x", long[3:67]), ("x", long[-63:]), ("y", long[5:80]), ("x", ""), ("x", None), (None, "q"), (None, "pq")]
    df = spark.createDataFrame(rows, "g string, key string")
    got = sorted(holds(df, df, ["g"]).collect(), key=repr)
    keys = {(g, k) for g, k in rows if k}
    assert sorted(map(tuple, got), key=repr) == sorted([(g, a, b) for g, a in keys for h, b in keys if g == h and a != b and b in a], key=repr)
    assert holds(df.limit(0), df, ["g"]).count() == holds(df, df.limit(0), ["g"]).count() == 0


def test_pieces_of_keys_are_not_broadcast(spark):
    keys = tables.written(spark.range(2000).selectExpr("'p' as g", "string(id * 7919) as key"), "keys")
    got = holds(keys, keys, ["g"])
    rows = got.collect()
    # the plan as it ran: neither the first choice nor a later one sends a side to all executors
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    all_ = [str(i * 7919) for i in range(2000)]
    assert sorted((r.outer, r.inner) for r in rows) == sorted((a, b) for a in all_ for b in all_ if a != b and b in a)


def test_nearest_equals_whole_pools(spark):
    rng = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "tor", "fen") for b in ("ra", "dun", "vel", "sil", "gar", "")]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3])))
    values = {(rng.choice("pq"), name()): None for _ in range(400)}
    pool = spark.createDataFrame([(p, v, v.replace(" ", ""), rng.choice([0, 1, 2, None]), rng.choice([1, 2, 5, 9, None]), i) for i, (p, v) in enumerate(values)], "pool string, v string, norm_v string, tier int, saga int, ord long")
    asked = [(i, rng.choice("pqr"), name(), rng.choice([None, "", name()]), rng.choice([0, 1, 2, None]), rng.choice([1, 2, 5, 9, None])) for i in range(150)]
    asked += [(150, "p", "", "x", 1, 1), (151, None, "x", "x", 1, 1), (152, "p", None, "kara", 1, 1)]
    q = spark.createDataFrame(asked, "id long, pool string, answer string, leak_ref string, tier int, saga int")
    lists = lambda d: {r.id: r.distractors for r in d.collect()}
    want = lists(items.distractors(items.candidates(q, pool, "s")))
    met = []
    assert lists(items.nearest(q, pool, "s", least=8, read=met)) == want
    assert met[0] < items.candidates(q, pool, "s").count() / 2
    # a test that leaves few candidates makes questions go on to further cells
    few = lambda c: c.where(F.pmod(F.xxhash64("v"), F.lit(23)) == 0)
    met = []
    assert lists(items.nearest(q, pool, "s", keep=few, least=2, read=met)) == lists(items.distractors(few(items.candidates(q, pool, "s"))))
    assert len(met) > 1
    assert not lists(items.nearest(q.limit(0), pool, "s")) and not lists(items.nearest(q, pool.limit(0), "s"))
    covered = items.covering(items._prepared(q), items._values(pool))
    by_hand = items.candidates(q, pool, "s").where("rank_key.cover < 0").select("id", "v")
    assert by_hand.count() > 20 and by_hand.join(covered, ["id", "v"], "left_anti").isEmpty()


def test_sample_size(spark):
    b = spark.createDataFrame([(i, "easy" if i < 2 else "hard") for i in range(40)], "id long, difficulty string")
    got = play.sample(b, 10, {"easy": 0.25, "medium": 0.5, "hard": 0.25}, F.col("id"), F.md5(F.col("id").cast("string"))).collect()
    assert len(got) == 10 and len({r.id for r in got}) == 10


def test_scores_follow_the_order_of_rules(spark):
    i = spark.createDataFrame([("a", "hard", ["stem_leak"], True), ("b", "easy", [], False), ("c", "hard", [], True)], "item string, authored string, guessability_flags array<string>, must_know boolean")
    r = spark.createDataFrame([("b", "x", 90, True), ("b", "y", 95, False)], "item string, rater string, knowledge_score int, guessable boolean")
    got = {x.item: x for x in ratings.scored(i, r, "item").collect()}
    assert (got["a"].score, got["a"].tier, got["a"].basis) == (50, "medium", "authored")
    assert (got["b"].score, got["b"].basis, got["b"].spread) == (92 - 15, "raters", 5)
    assert got["c"].score == 66 and got["c"].tier == "medium"


def test_markup(spark):
    text = "{{Char Box|name=Luffy|image=x.png|affiliation=[[Straw Hats|Crew]]<br/>{{Nihongo|Big|{{b}}}}|bounty={{B}}1,500,000{{Qref|x}}|rootpage=Luffy}}'''Luffy''' is a pirate who sails. He wants to be king of all. {{Ref|a}}"
    pages = spark.createDataFrame([("Luffy", "0", text), ("Talk", "1", text), ("None", "0", "no box")], "title string, ns string, text string")
    f = markup.facts(markup.infoboxes(pages), "https://x/wiki/").collect()
    assert len(f) == 1 and f[0].kind == "character" and f[0].source == "https://x/wiki/Luffy"
    assert f[0].fields["affiliation"] == ["Crew", "Big"] and f[0].fields["bounty"] == ["1,500,000"]
    assert one(spark, markup.lead_summary(F.lit("'''Luffy''' is a young pirate , who sails ().\n\nMore"))) == "Luffy is a young pirate, who sails."
    assert one(spark, markup.lead_summary(F.lit("no bold marker in this long paragraph of text"))) is None
    assert one(spark, X.title_after_first(F.lit("https://x/wiki/Nico_Robin%27s+a"))) == "Nico Robin's+a"
    assert one(spark, X.source_url(F.lit("Gol D. Roger/x (a) é"), "w/")) == "w/Gol_D._Roger/x_(a)_%C3%A9"
    assert one(spark, X.force_param(F.lit("https://cdn/x?a=1"), "cdn")) == "https://cdn/x?a=1&format=png"


def test_bank_checks(spark):
    good = dict(category="Geography", type="multiple", difficulty="easy", question="Where?", correct_answer="Alpha", incorrect_answers=["Beta", "Gamma", "Delta"], options=["Beta", "Alpha", "Gamma", "Delta"], source="https://x.y/wiki/A", explainer=None, image=None)
    cases = [({}, None), ({"type": "single"}, "type"), ({"question": " "}, "blank question"), ({"options": ["Alpha", "Beta"]}, "not four options"), ({"options": ["Alpha", "Alphabet", "Gamma", "Delta"]}, "near-duplicate options"), ({"image": "x"}, "image"), ({"options": ["Alpha", "a, b", "Netflix", "Delta"]}, "comma in option: a, b"), ({"source": None, "type": None}, "missing: type, source")]
    rows = [good | change for change, _ in cases]
    schema = "category string, type string, difficulty string, question string, correct_answer string, incorrect_answers array<string>, options array<string>, source string, explainer string, image string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    assert [r[0] for r in df.select(bank.fault(df)).collect()] == [w for _, w in cases]
    cache = spark.createDataFrame([("a", "u"), ("b", None)], "title string, url string")
    got = bank.with_images(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), cache, "t")
    assert {r.t: r.image_state for r in got.collect()} == {"a": "found", "b": "none", "c": "not asked"}
    once = bank.with_difficulty(spark.createDataFrame([("k", "easy")], "key string, difficulty string"), spark.createDataFrame([("k", "hard", 90)], "key string, tier string, score int"), "key")
    assert once.first().difficulty == "hard" and once.first().authored == "easy"


def test_sources(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<m><page><title>A</title><ns>0</ns><id>1</id><revision><id>2</id><text>x {{Box}}</text></revision></page></m>")
    assert tables.pages(spark, str(tmp_path / "d.xml")).collect() == [("A", "0", "x {{Box}}")]
    assert [r.key for r in tables.titles(spark, str(tmp_path / "d.xml")).collect()] == ["a"]
    (tmp_path / "f.jsonl").write_text('{"title": "A", "fields": {"x": "one", "y": ["a", "b"]}}\n\n{"title": "B"}\n')
    assert {r.title: r.fields for r in tables.facts(spark, str(tmp_path / "f.jsonl")).collect()} == {"A": {"x": ["one"], "y": ["a", "b"]}, "B": None}
    (tmp_path / "m.json").write_text('{"a": "u", "b": null}')
    assert {r.key: r.value for r in tables.json_map(spark, str(tmp_path / "m.json"), "string").collect()} == {"a": "u", "b": None}
    q = spark.createDataFrame([(2, "b"), (1, "a")], "id int, question string")
    tables.write_json_array(q, str(tmp_path / "bank"), ["id"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "bank").glob("part-*"))) == [{"id": 1, "question": "a"}, {"id": 2, "question": "b"}]
    with pytest.raises(ValueError):
        tables.write_guarded(q.limit(0), print)
    with pytest.raises(ValueError):
        tables.write_guarded(q, print, failures=q)
    assert tables.write_guarded(q, print, check_only=True) == 2
    assert {r.id: r.question for r in tables.merged(q, spark.createDataFrame([(2, "new")], "id int, question string"), ["id"]).collect()} == {1: "a", 2: "new"}
    found = spark.createDataFrame([("T", "u")], "title string, url string")
    aliases = spark.createDataFrame([("x", "S", 1), ("x", "T", 2)], "alias string, title string, ord int")
    assert tables.resolved(spark.createDataFrame([("x",), ("T",)], "title string"), aliases, found).where("url = 'u'").count() == 2
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "opus.b00.json").write_text('{"ratings": [{"n": 1, "knowledge_score": 140, "guessable": true}]}')
    v = tables.verdicts(spark, str(tmp_path / "v" / "*.json"))
    got = ratings.imported(v, spark.createDataFrame([("b00", 1, "h")], "batch string, n int, hash string")).first()
    assert (got.hash, got.rater, got.knowledge_score) == ("h", "opus", 100)


def test_stream_equals_batch(spark):
    from triviary import catalog

    sf = "/root/testdata/sf0.001"
    cols = ["profile", "qid", "seen", "correct", "wrong", "streak", "mastered", "times_mastered"]
    rows = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, sf).select(*cols).collect())
    assert rows("streaming_mastery") == rows("mastery_state")


def test_whole_texts_that_begin_alike(spark, tmp_path):
    """Documents that agree in their first 60 characters have ids, keys, hashes and flags of their own."""
    from triviary import catalog

    opening = "one two three four " + "the same opening of all texts that goes on past sixty " * 2
    texts = [opening + "alpha", opening + "beta", opening + "alpha", opening + "\U0001f600 é", "x" * 70_000]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, opening + "gamma"), (2, texts[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    get = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    ids = {r.doc_id: r.qid for r in get("question_id_whole")}
    for i, t in enumerate(texts):
        h, raw = 5381, t.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 33 & 0xFFFFFFFF) ^ int.from_bytes(raw[k : k + 2], "big")
        assert int(ids[i][2:], 36) == h
    assert ids[0] == ids[2] and len(set(ids.values())) == 4
    assert {r.state: r.n for r in get("golden_check_whole")} == {"ok": 6, "missing": 1}
    hashes = {r.id: r.hash for r in get("content_hash_whole")}
    assert hashes[0] == hashes[2] and len(set(hashes.values())) == 4
    assert len(get("signal_flags_whole")) == len(texts)


def test_nearest_lets_few_values_of_a_large_level_out_of_the_join(spark):
    pool = spark.range(1500).selectExpr("'p' as pool", "concat('v', hex(id * 7919 + 100000)) as v", "concat('v', lower(hex(id * 7919 + 100000))) as norm_v", "cast(1 as int) as tier", "cast(1 as int) as saga", "id as ord")
    q = spark.range(20).selectExpr("id", "'p' as pool", "concat('answer', id) as answer", "'x' as leak_ref", "cast(1 as int) as tier", "cast(1 as int) as saga")
    kept = []
    got = items.nearest(q, pool, "s", keep=lambda c: kept.append(c.count()) or c)
    lists = lambda d: {r.id: r.distractors for r in d.collect()}
    assert lists(got) == lists(items.distractors(items.candidates(q, pool, "s")))
    assert kept[0] < 20 * 64


def test_a_lead_is_made_once(spark):
    text = "'''A''' x\n\n: No lead , but an indented one of many letters.\n\nFirst one , and of the. Second ( ) sentence here;. Third.\n\nAnother paragraph of many letters."
    df = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(markup.lead_summary(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["First one. Second sentence here.", None, None]
    # a paragraph is cleaned at one place of the expression, however often its lead is looked at
    assert df._jdf.queryExecution().analyzed().toString().count("array_join") == 1
