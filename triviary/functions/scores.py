"""Scores, grades, tiers and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of grades, bounds of remarks, upper bounds of sagas, thresholds.
GRADES = [(97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-")]
REMARKS = [
    (90, None, "Outstanding! You've mastered this quiz. Well done!"),
    (80, 89, "Great job! You've excelled in this quiz."),
    (70, 79, "Good effort! You've passed the quiz."),
    (60, 69, "You've passed, but there's potential for improvement."),
    (None, 60, "Learning is a journey. Keep going, and you'll get there."),
]
SAGAS = [100, 217, 302, 441, 489, 597, 653, 801, 902, 1057]
SAGA_NAMES = ["East Blue", "Alabasta", "Sky Island", "Water 7", "Thriller Bark", "Summit War", "Fish-Man Island", "Dressrosa", "Whole Cake Island", "Wano Country", "Final Saga"]
EASY, MEDIUM = 33, 66
PENALTIES = {"stem_leak": 30, "cross_domain": 25, "numeric_ladder": 25, "lone_canon_option": 20, "meta_noise_option": 20, "weak_distractors": 15, "answer_len_outlier": 10}
PRIOR = {"easy": 20, "medium": 50, "hard": 80}
MASTERED = 2
COLORS = ["#e03997", "#2185d0", "#21ba45", "#f2711c", "#6435c9", "#00b5ad", "#db2828", "#fbbd08"]
EVENT_SECONDS = 300


def half_up(c: Column) -> Column:
    """Rounded to an integer, halves towards plus infinity."""
    return F.floor(c + 0.5)


def percent(correct: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.round(correct * 100 / total, 2))


def grade(score: Column) -> Column:
    whole = score.cast("int")
    out = F.when(score.isNull(), None)
    for low, name in GRADES:
        out = out.when(whole >= low, name)
    return out.otherwise("F")


def remarks(score: Column) -> Column:
    """By the score itself, so one between two bands has none."""
    out = F.when(score.isNull(), None)
    for low, high, said in REMARKS:
        out = out.when(score >= low if high is None else score < high if low is None else score.between(low, high), said)
    return out


def clock(ms: Column) -> Column:
    """HH:MM:SS, two last digits each."""
    s = F.floor(ms / 1000)
    two = lambda c: F.right(F.concat(F.lit("0"), c.cast("string")), F.lit(2))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def letter(i: Column) -> Column:
    return F.when(i == 0, "A.").when(i == 1, "B.").when(i == 2, "C.").when(i == 3, "D.")


def human_bytes(n: Column) -> Column:
    """A number of bytes with one decimal, in gigabytes at most."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))
    return F.when(n < 1024, shown(0, "B")).when(n < 1024**2, shown(1, "KB")).when(n < 1024**3, shown(2, "MB")).otherwise(shown(3, "GB"))


def saga_order(chapter: Column) -> Column:
    out = F.when(chapter.isNull(), None)
    for i, high in enumerate(SAGAS, 1):
        out = out.when(chapter <= high, i)
    return out.otherwise(len(SAGAS) + 1)


def saga_of_first(first: Column) -> Column:
    """The saga of the first of the debuts (an array) that names a chapter."""
    chapters = F.filter(F.transform(first, lambda v: F.regexp_extract(v, r"Chapter\s+([0-9]+)", 1)), lambda n: n != "")
    return saga_order(F.get(chapters, 0).try_cast("int"))


def saga_name(order: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, SAGA_NAMES)), order)


def prominence(must_know: Column, length: Column) -> Column:
    return F.when(must_know | (length >= 20000), 2).when(length >= 6000, 1).otherwise(0)


def difficulty(prominence: Column, depth: Column) -> Column:
    d = prominence - depth
    return F.when(d >= 2, "easy").when(d == 1, "medium").otherwise("hard")


def tier(score: Column) -> Column:
    return F.when(score <= EASY, "easy").when(score <= MEDIUM, "medium").otherwise("hard")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def signal_penalty(flags: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for p in PENALTIES.items() for x in p])
    return F.least(F.lit(40), F.aggregate(flags, F.lit(0), lambda a, f: a + F.coalesce(F.try_element_at(weights, f), F.lit(0))))


def prior(difficulty: Column) -> Column:
    out = F.when(difficulty == "easy", PRIOR["easy"])
    for name in ("medium", "hard"):
        out = out.when(difficulty == name, PRIOR[name])
    return out.otherwise(50)


def mix(total: Column, correct: Column) -> Column:
    """Shares of easy, medium and hard questions that suit past accuracy."""
    share = lambda e, m, h: F.struct(F.lit(e).alias("easy"), F.lit(m).alias("medium"), F.lit(h).alias("hard"))
    weak = (total < 5) | (correct / F.nullif(total, F.lit(0)) < 0.5)
    return F.when(weak, share(0.7, 0.3, 0.0)).when(correct / F.nullif(total, F.lit(0)) < 0.8, share(0.25, 0.5, 0.25)).otherwise(share(0.1, 0.4, 0.5))


def profile_name(c: Column) -> Column:
    t = F.trim(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 24))
    return F.when(t == "", "Player").otherwise(t)


def profile_color(place: Column) -> Column:
    """Colours in turn; place counts from 0."""
    return F.element_at(F.array(*map(F.lit, COLORS)), (F.pmod(place, F.lit(len(COLORS))) + 1).cast("int"))


def quiz_seconds(event: Column, chosen: Column) -> Column:
    """The clock of a quiz: an event without one gets the usual five minutes."""
    return F.when(event & (F.coalesce(chosen, F.lit(0)) == 0), EVENT_SECONDS).otherwise(F.coalesce(chosen, F.lit(0)))


def dump_url(host: str, wiki: Column) -> Column:
    """Where a wiki's dump lies: folders of its first letter and its first two."""
    w = F.lower(wiki)
    return F.concat_ws("/", F.lit(host), F.substring(w, 1, 1), F.substring(w, 1, 2), F.concat(w, F.lit("_pages_current.xml.7z")))
