"""Facts to a bank: every question is valid, leak-free and within the caps."""

from collections import Counter

from triviary.operators import bank as B
from triviary.plans import bank
from triviary.sources.tables import FACT


def test_bank(spark):
    rows = []
    for i in range(60):
        fields = {"first": [f"Chapter {i * 15}"], "affiliation": [f"{'Red Blue Green Black White'.split()[i % 5]} Guild; Hero {i - 1}"], "bounty": [f"{i + 1},000,000"], "occupation": [["Cook", "Doctor", "Sniper", "Helmsman"][i % 4]], "origin": [["North", "South", "East", "West"][i % 4] + " Sea"]}
        rows.append((f"Hero{chr(97 + i // 26)}{chr(97 + i % 26)}", "character", f"https://x.y/wiki/H{i}", False, fields, 1000 * i, f"Summary {i}"))
    rows.append(("Fake (Non-Canon)", "character", "https://x.y/wiki/F", False, {"first": ["Chapter 1"]}, 5, None))
    got = bank.bank(spark.createDataFrame(rows, FACT)).cache()
    questions = got.collect()
    assert {"char_affiliation", "char_bounty", "char_occupation", "char_origin", "crew_member", "char_saga"} <= {q.template for q in questions}
    assert got.select(B.fault(got).alias("f")).where("f is not null").count() == 0
    per_answer = Counter((q.category, q.correct_answer) for q in questions)
    assert all(n <= (14 if c == "Arcs & Story" else 6) for (c, _), n in per_answer.items())
    assert not any("Fake" in q.question for q in questions)
    crew = {f"{'Red Blue Green Black White'.split()[i % 5]} Guild": set() for i in range(5)}
    for i, r in enumerate(rows[:60]):
        crew[f"{'Red Blue Green Black White'.split()[i % 5]} Guild"].add(r[0])
    for q in questions:
        if q.template == "crew_member":
            own = next(m for c, m in crew.items() if c in q.question)
            assert q.correct_answer in own and not own & set(q.incorrect_answers)
