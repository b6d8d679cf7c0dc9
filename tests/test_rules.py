"""Rules of facts, questions, requests and profiles, each on a few rows."""

import pytest
from pyspark.sql import functions as F

from triviary.functions import scores
from triviary.functions import text as X
from triviary.operators import bank as checks
from triviary.operators import bloom, items, markup, play, ratings, signals
from triviary.plans import bank
from triviary.sources import tables
from triviary.sources.tables import FACT


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def facts(spark, *rows):
    """Rows (title, kind, fields, length, summary) in order."""
    full = [(t, k, f"https://x.y/wiki/{t}", False, f, n, s, i) for i, (t, k, f, n, s) in enumerate(rows)]
    return spark.createDataFrame(full, FACT + ", ord BIGINT")


def hero(name, n=7000, **fields):
    return (name, "character", {"first": ["Chapter 10"]} | {k: v if isinstance(v, list) else [v] for k, v in fields.items()}, n, None)


def test_tabbed_boxes_and_articles(spark):
    prose = "{{For|others}}\n{{Quote\n|a}}\n'''Ann''' is a {{Nihongo|Big Cook|x}} of the {{Ref|a}}. She cooks very well on ships, known as the. Third."
    pages = spark.createDataFrame(
        [("Ann", "0", prose), ("Template:Ann", "10", "{{Char Box|root=[[Ann]]|tab=1|origin=East|age=5|title=x}}"), ("Bob", "0", "{{Char Box|root=Ann|origin=West}} {{Char Box|first=1}}"), ("Doc", "10", "{{Char Box|origin=x}}"), ("Par", "0", "{{Char Box|root={{{1}}}|a=b}} {{Char Box|name=only layout}}")],
        "title string, ns string, text string",
    )
    got = {(r.title, r.kind): r for r in bank.facts_of(pages.coalesce(1), "w/").collect()}
    assert set(got) == {("Ann", "character"), ("Bob", "character")}
    ann = got["Ann", "character"]
    assert ann.tabbed and ann.fields == {"origin": ["East"], "age": ["5"]}
    assert ann.article_len == len(prose) and ann.summary == "She cooks very well on ships. Third."
    assert got["Bob", "character"].fields == {"first": ["1"]}


def test_ties_between_boxes_go_to_the_first(spark):
    pages = spark.createDataFrame([("A", "0", "{{Char Box|x=first}}"), ("B", "0", "{{Char Box|root=A|x=second}}" + "long " * 50)], "title string, ns string, text string")
    assert [r.fields["x"] for r in bank.facts_of(pages.coalesce(1), "w/").collect()] == [["first"]]


@pytest.mark.parametrize("said, want", [("Good start, a of, b of, c of, d of, e of, f of", "Good start"), ("all of, the", ""), ("He sails , with () care .", "He sails, with care"), ("known as", "")])
def test_clauses_are_cut_until_none_dangles(spark, said, want):
    assert value(spark, markup.tidy(F.lit(said))) == want


def test_citations_and_layout():
    assert markup.render("a{{Web Ref|x|Site}}b{{Book|Kept}}c{{qref/ext|1}}") == "abKeptc"
    assert {"name", "title", "backcolor", "root", "tabs"} <= markup.SKIPPED and "style" not in markup.SKIPPED


@pytest.mark.parametrize(
    "title, kind, first, want",
    [
        ("Moon Fruit", "devil_fruit", ["Episode 3"], False),
        ("Moon Fruit", "devil_fruit", ["Chapter 3"], True),
        ("Ann (Novel)", "character", ["Chapter 3"], False),
        ("Ann", "character", ["One Piece Film: Z; Chapter 691 (cover)"], False),
        ("Ann", "character", ["Stampede", "Episode 2; Chapter 907"], True),
        ("Ann", "character", ["Movie 3; Chapter 5 (mentioned)"], False),
        ("Ann", "character", ["chapter 5"], False),
        ("Ann", "character", None, False),
    ],
)
def test_canon(spark, title, kind, first, want):
    f = facts(spark, (title, kind, {} if first is None else {"first": first}, 1, None))
    assert bank.canon(f).count() == int(want)


def test_sagas(spark):
    order = lambda *first: value(spark, scores.saga_of_first(F.array(*map(F.lit, first))))
    assert [order("Episode 1", "Chapter 100"), order("Chapter 101"), order("Chapter 1058"), order("x")] == [1, 2, 11, None]
    assert value(spark, scores.saga_name(F.lit(2))) == "Alabasta" and value(spark, scores.saga_name(F.lit(11))) == "Final Saga"


def test_values_that_one_character_has_are_not_asked(spark):
    f = facts(spark, hero("Anna", occupation="Cook", origin="Tibet"), hero("Bert", occupation="Cook (former)"), hero("Carl", occupation="God of Skypiea"))
    q = {(r.template, r.title) for r in bank.asked(bank.prepared(f)).collect()}
    assert ("char_occupation", "Anna") in q and ("char_occupation", "Bert") in q
    assert ("char_occupation", "Carl") not in q and ("char_origin", "Anna") not in q
    pools = {(r.pool, r.v) for r in bank.pools(bank.prepared(f)).collect()}
    assert ("occupation", "Cook") in pools and not {("occupation", "God of Skypiea"), ("origin", "Tibet")} & pools


def test_own_places_are_no_distractors(spark):
    rows = [hero("Anna", residence="Lodge (former); Harbour; Mill (former)", origin="Valley"), hero("Bert", residence="Lodge"), hero("Carl", residence="Mill"), hero("Dora", residence="Valley"), hero("Emil", residence="Tower"), hero("Fina", residence="Garden"), hero("Gerd", residence="Castle")]
    made = {r.title: r for r in bank.generated(facts(spark, *rows)).where("template = 'char_residence'").collect()}
    assert made["Anna"].answer == "Harbour" and set(made["Anna"].distractors) == {"Tower", "Garden", "Castle"}
    assert set(made["Emil"].distractors) <= {"Lodge", "Mill", "Valley", "Harbour", "Garden", "Castle"}


def test_members_of_any_affiliation_are_no_distractors(spark):
    rows = [hero("Anna", affiliation="Red Guild"), hero("Bert", affiliation=["Blue Guild; Red Guild (former)"]), hero("Carl", affiliation=["none", "Green Guild, Red Guild"]), hero("Dora", affiliation="Blue Guild"), hero("Emil", affiliation="Green Guild"), hero("Fina", affiliation="Anna; Green Guild")]
    made = {(r.title, r.template): r for r in bank.generated(facts(spark, *rows)).collect()}
    assert set(made["Anna", "crew_member"].distractors) == {"Dora", "Emil", "Fina"}
    assert made["Fina", "crew_member"].question == "Which of these characters is a member of the Green Guild?"


def test_kingdoms(spark):
    place = lambda t, **f: (t, "location", {"first": ["Chapter 1"]} | {k: [v] for k, v in f.items()}, 1, "A place.")
    f = bank.prepared(facts(spark, place("Rose Kingdom"), place("Port", affiliation="Goa Kingdom (east)"), hero("Anna", origin="Sun Kingdom"), hero("Bert", affiliation="Snow Kingdom; x")))
    q = [r for r in bank.asked(f).where("template = 'loc_kingdom'").collect()]
    assert [(r.title, r.answer, r.explainer) for r in q] == [("Port", "Goa Kingdom", "Port belongs to the Goa Kingdom. A place.")]
    assert {r.v for r in bank.pools(f).where("pool = 'kingdom'").collect()} == {"Goa Kingdom", "Sun Kingdom", "Snow Kingdom"}


def test_fruits_are_named_by_both_names(spark):
    fruit = lambda t, **f: (t, "devil_fruit", {"first": ["Chapter 1"], "user": ["Ann; Bob"]} | {k: [v] for k, v in f.items()}, 1, None)
    q = bank.asked(bank.prepared(facts(spark, fruit("Goro Goro", ename="Rumble (x)", rname="Goro Goro no Mi"), fruit("Yami Yami no Mi")))).collect()
    assert {r.question for r in q} == {"Who is the user of the Rumble / Goro Goro no Mi?", "Who is the user of the Yami Yami no Mi?"}
    assert {r.answer for r in q} == {"Ann"}


def test_order_of_emission(spark):
    f = bank.prepared(facts(spark, hero("Short", 10, bounty="1,000"), hero("Nami", 10, bounty="2,000"), hero("Long", 9000, bounty="3,000"), ("Big", "location", {"first": ["Chapter 2"]}, 5, None), ("Nami Town", "location", {"first": ["Chapter 2"]}, 3, None)))
    q = [r.title for r in bank.asked(f).where("template in ('char_bounty', 'loc_saga')").orderBy("ord").collect()]
    assert q == ["Nami", "Long", "Short", "Nami Town"]


def test_caps_equal_an_ordered_pass(spark):
    rows = [hero(f"Hero{chr(97 + i % 26)}{chr(97 + i // 26)}", 7000 - i, occupation=["Cook", "Doctor", "Sniper", "Helmsman"][i % 4], origin=f"{['North', 'South', 'East', 'West'][i // 4 % 4]} Sea", bounty=f"{i + 1},000,000") for i in range(40)]
    made = bank.generated(facts(spark, *rows))
    want, used = [], {}
    for r in made.orderBy("ord").collect():
        own = [("a", r.answer_key, r.answer_cap), ("e", r.entity, r.entity_cap), ("t", r.template, r.template_cap)]
        if all(used.get(k[:2], 0) < k[2] for k in own):
            want.append(r.question)
            for k in own:
                used[k[:2]] = used.get(k[:2], 0) + 1
    assert sorted(r.question for r in bank.bank(facts(spark, *rows)).collect()) == sorted(want)


def test_must_know_names_are_built_in(spark):
    assert [value(spark, X.must_know(F.lit(t))) for t in ("Monkey D. Luffy", "Portgas D. Rouge", "Aceline", "Nico Robin")] == [True, True, False, True]


def test_upserts_go_on_where_they_stopped(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    path = f"file://{tmp_path}/state"
    one, two = batch((1, "a"), (2, "b")), batch((2, "c"), (3, "d"))
    assert tables.upserted(spark, path, [one], ["k"]).count() == 2
    (tmp_path / "state" / "state=2").mkdir()  # a run that was killed while it wrote
    got = tables.upserted(spark, path, [batch((9, "never again")), two], ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.state_of(spark, f"file://{tmp_path}/none") == (None, 0)


def test_profiles(spark):
    p = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "owner int, profile int")
    chosen = spark.createDataFrame([(1, 11), (2, 20), (3, 30)], "owner int, profile int")
    left = play.removed(p, spark.createDataFrame([(11,), (20,)], "profile int"))
    assert {r.owner: r.active for r in play.active(left, chosen, "owner", "profile").collect()} == {1: 10, 2: None, 3: None}
    assert {r.owner: r.active for r in play.active(p, chosen, "owner", "profile").collect()} == {1: 11, 2: 20, 3: None}
    made = play.created(spark.createDataFrame([("  " + "x" * 30, 8), (None, 1)], "n string, i int"), "n", "i").collect()
    assert [(r.name, r.color) for r in made] == [("x" * 24, "#e03997"), ("Player", "#2185d0")]


def test_first_and_last_answers(spark):
    t = spark.createDataFrame([("q", "k", 1, "a"), ("q", "k", 2, "b")], "g string, k string, o int, text string")
    assert (play.settled(t, "g", "k", "o", True).first().text, play.settled(t, "g", "k", "o", False).first().text) == ("a", "b")


def test_formats(spark):
    shown = [value(spark, scores.human_bytes(F.lit(n))) for n in (1023, 1024, 5 << 20, 3 << 30, 5 << 40)]
    assert shown == ["1023.0 B", "1.0 KB", "5.0 MB", "3.0 GB", "5120.0 GB"]
    assert value(spark, scores.dump_url("h", F.lit("OnePage"))) == "h/o/on/onepage_pages_current.xml.7z"
    assert value(spark, checks.rendered(F.lit(3), F.lit("Who?"), F.array(F.lit("x"), F.lit("y")))) == "3. Who?\n   A) x\n   B) y"


def test_raters_and_offenders(spark):
    v = spark.createDataFrame([("b00", 1, "a"), ("b09", 1, "a"), ("b00", 7, "b")], "batch string, n int, rater string")
    m = spark.createDataFrame([("b00", 1, "h")], "batch string, n int, hash string")
    assert {r.rater: r.skipped for r in ratings.skipped(v, m).collect()} == {"a": 1, "b": 1}
    rows = spark.createDataFrame([(1, "hard", ["a"], ["a"]), (2, "hard", ["a", "b"], ["a", "b"]), (3, "easy", ["a"], ["a"]), (4, "hard", ["b"], [])], "id int, authored string, flags array<string>, guessability_flags array<string>")
    assert [r.id for r in signals.offenders(rows, 5).collect()] == [2, 1]
    assert [r.id for r in signals.offenders(rows, 5, "b").collect()] == [2, 4]


def test_missing_pairs_of_many_raters(spark):
    raters = spark.range(1500).selectExpr("concat('r', id) as rater")
    items = spark.createDataFrame([(1,), (2,), (3,), (3,)], "item int")
    done = raters.selectExpr("1 as item", "rater").unionByName(raters.where("rater <> 'r7' and rater <> 'r1499'").selectExpr("2 as item", "rater")).unionByName(spark.createDataFrame([(2, "stranger"), (9, "r1")], "item int, rater string"))
    got = ratings.unrated(items, raters, done.unionByName(done.limit(50)))
    assert sorted(map(tuple, got.where("item < 3").collect())) == [(2, "r1499"), (2, "r7")]
    assert got.where("item = 3").select("rater").distinct().count() == got.where("item = 3").count() == 1500
    assert ratings.unrated(items, raters.limit(0), done).count() == 0


def test_gloss_leaks_reach_the_cascade(spark):
    q = spark.createDataFrame([(1, "Which fruit lets one create clothing?", "Fuku Fuku no Mi", ["Bara Bara no Mi", "Gomu Gomu no Mi", "Hana Hana no Mi"], ["Fuku Fuku no Mi", "Bara Bara no Mi", "Gomu Gomu no Mi", "Hana Hana no Mi"], "Nami")], "id int, question string, correct_answer string, incorrect_answers array<string>, options array<string>, subject string")
    f = facts(spark, ("Fuku Fuku no Mi", "devil_fruit", {"ename": ["Clothes Fruit"]}, 100, None), ("Bara Bara no Mi", "devil_fruit", {}, 1, None), ("Gomu Gomu no Mi", "devil_fruit", {}, 1, None))
    seen = signals.with_subjects(q, f)
    assert (seen.first().gloss.strip(), seen.first().prominence, seen.first().article_len) == ("Clothes Fruit", 2, None)
    got = signals.flags(signals.attested(seen, signals.vocabulary(f, q))).first()
    assert "gloss_leak" in got.flags and "gloss_leak" not in got.guessability_flags and "unattested_option" in got.flags


def quiz_of(spark, right, *wrong):
    return spark.createDataFrame([(1, "Who?", right, list(wrong), [right, *wrong], "x", None)], "id int, question string, correct_answer string, incorrect_answers array<string>, options array<string>, subject string, gloss string")


def test_titles_of_pages_attest_options(spark):
    q = quiz_of(spark, "Zoro", "Wado Ichimonji", "Shusui Blade", "The Enma Blade")
    f = facts(spark, ("Zoro", "character", {}, 1, None))
    titles = spark.createDataFrame([("wadoichimonji",), ("shusuiblade",), ("enmablade",)], "key string")
    flagged = lambda t, asked=None: signals.flags(signals.attested(q, signals.vocabulary(f, q, t, asked))).first().flags
    assert flagged(None) == ["lone_canon_option"]
    assert flagged(titles) == flagged(titles, q) == []
    # a key without its article counts among pages alone
    named = facts(spark, ("Zoro", "character", {"sword": ["Enma Blade"]}, 1, None))
    known = signals.attested(q, signals.vocabulary(named, q)).first().known
    assert [k.known for k in known] == [True, False, False, False]


def test_other_kinds(spark):
    f = facts(spark, ("Luffy", "character", {"occupation": ["Captain; Cook (former)", "Hunter"]}, 1, None))
    q = quiz_of(spark, "Luffy", "Captain", "Cook", "Hunter")
    seen = signals.attested(q, signals.vocabulary(f, q, asked=q))
    assert [k.kinds for k in seen.first().known] == [["answer", "character"], *[["field:occupation"]] * 3]
    assert "cross_domain" in signals.flags(seen).first().flags


def test_the_last_fact_of_a_key_counts(spark):
    q = quiz_of(spark, "Fuku", "a", "b", "c").drop("gloss").withColumn("subject", F.lit("Fuku"))
    f = facts(spark, ("Fuku", "x", {"ename": ["Zebra"]}, 900, None), ("FUKU!", "y", {"ename": ["Apple"]}, 100, None), ("fuku", "z", {}, 50, None)).withColumn("at", F.element_at(F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(3), F.lit("z"), F.lit(2)), F.col("kind")))
    got = signals.with_subjects(q, f, order="at").first()
    assert (got.article_len, got.gloss.strip()) == (100, "Apple")


def test_bloom_filter_keeps_every_key(spark):
    keys = spark.range(0, 5000, 7).selectExpr("string(id) as k").unionByName(spark.createDataFrame([(None,)], "k string"))
    rows = spark.range(0, 100_000).selectExpr("string(id) as key", "id")
    chunks, bits = bloom.made(keys, "k")
    kept = {r.id for r in bloom.possible(rows, "key", chunks, bits).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 10_000
    assert bloom.possible(spark.createDataFrame([(None,)], "key string"), "key", chunks, bits).count() == 0
    assert bloom.joinable(rows, "key", keys.limit(0), "k").count() == 0


def test_bits_of_a_bloom_filter_are_hashed_not_sorted(spark):
    keys = spark.range(0, 50_000, 7, 4).selectExpr("string(id) as k")
    chunks, bits = bloom.made(keys, "k")
    # a sort would hold every key's bits in one task
    assert "SortAggregate" not in chunks._jdf.queryExecution().executedPlan().toString()
    n = bits // bloom.CHUNK
    assert n > 1 and [(r.chunk, len(r.bits)) for r in chunks.orderBy("chunk").collect()] == [(i, bloom.CHUNK // bloom.WORD) for i in range(n)]
    assert bloom.possible(keys, "k", chunks, bits).count() == keys.count()


def test_a_load_that_fails_is_tried_again(spark, tmp_path):
    calls = []

    def load():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("offline")
        return spark.range(3)

    with pytest.raises(OSError):
        tables.remembered(spark, "bank", load)
    assert tables.remembered(spark, "bank", load).count() == tables.remembered(spark, "bank", load).count() == 3
    assert len(calls) == 2
    tables.remembered(spark, "bank", load).unpersist()
    (tmp_path / "f").write_bytes(b"abc")
    assert tables.file_md5(spark, str(tmp_path / "f")).first().md5 == "900150983cd24fb0d6963f7d28e17f72"


def test_equal_questions_of_two_entities_have_distractors_of_their_own(spark):
    low, high = (dict(zip(["Ann", *x], ["Harbour", *y])) for x, y in ((("Bert", "Carl", "Dora"), ("Lodge", "Mill", "Valley")), (("Emil", "Fina", "Gerd"), ("Tower", "Garden", "Castle"))))
    rows = [hero(n, 10, residence=r) for n, r in low.items()] + [hero(n, 30000, residence=r) for n, r in high.items()]
    made = bank.generated(facts(spark, *rows)).where("template = 'char_residence' and title = 'Ann'").collect()
    assert {r.tier: set(r.distractors) for r in made} == {0: {"Lodge", "Mill", "Valley"}, 2: {"Tower", "Garden", "Castle"}}


def test_questions_behind_full_caps_meet_no_values(spark, monkeypatch):
    rows = [hero(f"Hero{chr(97 + i % 26)}{chr(97 + i // 26)}", 5000 - i, occupation=["Cook", "Doctor", "Sniper", "Helmsman"][i % 4], origin=f"{['North', 'South', 'East', 'West'][i // 4 % 4]} Sea", bounty=f"{i + 1},000,000") for i in range(600)]
    f, met, nearest = facts(spark, *rows), [], bank.items.nearest
    want = {r.question: r.incorrect_answers for r in bank.bank(f).collect()}
    monkeypatch.setattr(bank.items, "nearest", lambda q, *a, **b: met.append(q.count()) or nearest(q, *a, **b))
    got = {r.question: r.incorrect_answers for r in bank.bank(f).collect()}
    assert got == want and len(got) <= sum(met) <= 2 * len(got)
    assert bank.asked(bank.prepared(f)).count() > 3 * sum(met)
