"""Column expressions on names and texts; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no content, noise answers, number words.
STOPWORDS = "the and for with from that this what which who was were his her their they one piece fruit mi no of a an in on at to is are it by pirates pirate crew island kingdom berries years old".split()
META_NOISE = "bandai toei toeianimation 4kids funimation shueisha viz vizmedia namco bandainamco crunchyroll netflix space outerspace n/a na unknown none various other".split()
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty hundred".split()
ARTICLES = "a an the of no and".split()
# Names that everyone is expected to know; those of one word match a word of a title, the others a part of it.
MUST_KNOW_SINGLE = "luffy zoro nami usopp sanji chopper robin franky brook jinbe jimbei shanks buggy kaido kaidou linlin teach newgate roger rayleigh garp sengoku kuzan aokiji borsalino kizaru sakazuki akainu mihawk doflamingo crocodile ace sabo dragon hancock kuma moria oden yamato vivi koby smoker enel arlong katakuri marco vegapunk carrot momonosuke perona bartolomeo bellamy roronoa".split()
MUST_KNOW_MULTI = ["big mom", "boa hancock", "trafalgar", "eustass kid", "bon clay", "jewelry bonney", "gecko moria", "portgas d", "monkey d"]
# Markup as it stands in infobox values, with what it becomes.
FILE_LINK = r"(?i)\[\[(?:File|Image|Category|Media):[^\[\]]*\]\]"
MARKUP = [(r"(?s)<!--.*?-->", ""), (r"(?i)<\s*br\s*/?\s*>", "\n"), (FILE_LINK, ""), (r"\[\[(?:[^|\]]*\|)?([^\[\]]+)\]\]", "$1"), (r"\[\[(?:[^|\]]*\|)?([^\[\]]+)\]\]", "$1"), (r"\[(?:https?:)?//[^\s\]]+\s+([^\]]+)\]", "$1"), (r"<[^>]+>", ""), (r"\{\{[^{}]*\}\}", "")]
QUOTES = [("'''", ""), ("''", ""), ("&nbsp;", " "), ("[[", ""), ("]]", "")]


# White space between the words of a name: ASCII alone, whatever the engine takes \\s for.
SPACE = r"[\t\n\f\r ]"


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def trimmed(c: Column) -> Column:
    """Without spaces of any script at its ends; tabs and line ends stay."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def spaced(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(trimmed(c), f"{SPACE}+"), lambda t: t != "")


def norm_key(c: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def near_dupe(a: Column, b: Column) -> Column:
    """Whether two keys are equal or one holds the other; an empty key is near every key."""
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric words of three characters and more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) >= 3))


def lowered(c: Column) -> Column:
    """Lower case, character by character: a dotted capital I becomes one letter, not two."""
    return F.lower(F.translate(c, "\u0130", "i"))


def words(c: Column) -> Column:
    """Distinct lower-case words of three letters and more that are no stopwords."""
    return F.array_distinct(F.filter(F.regexp_extract_all(lowered(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), 0), lambda t: (F.length(t) >= 3) & ~F.array_contains(literals(STOPWORDS), t)))


def leaked(ref: Column, value: Column) -> Column:
    """Tokens of ref that value shows again, whole or, from four characters, inside a token."""
    return shown(tokens(ref), tokens(value))


def shown(of: Column, seen: Column) -> Column:
    """The tokens of `of` that are in `seen` or, from four characters, inside a token of it."""
    return F.filter(of, lambda t: F.array_contains(seen, t) | ((F.length(t) >= 4) & F.exists(seen, lambda s: F.contains(s, t))))


def strip_quals(c: Column) -> Column:
    """Without parenthesised qualifiers, closed or not."""
    return F.trim(F.btrim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^()]*\)", ""), r"\s*\(.*$", ""), F.lit(" ;,.")))


def primary(values: Column) -> Column:
    """The first value's first clause that isn't empty or 'none'."""
    heads = F.transform(values, lambda v: F.trim(F.element_at(F.split(strip_quals(v), "[;,]"), 1)))
    return F.get(F.filter(heads, lambda h: (h != "") & (F.lower(h) != "none")), 0)


def clean_name(values: Column) -> Column:
    heads = F.transform(values, lambda v: strip_quals(F.element_at(F.split(v, ";"), 1)))
    return F.get(F.filter(heads, lambda h: (h != "") & ~F.contains(h, F.lit("{{{")) & (F.lower(h) != "none")), 0)


def combined_name(english: Column, romaji: Column) -> Column:
    """'English / Romaji', or the one there is if one is missing or both have the same key."""
    a, b = clean_name(english), clean_name(romaji)
    return F.when(a.isNotNull() & b.isNotNull() & (norm_key(a) != norm_key(b)), F.concat_ws(" / ", a, b)).otherwise(F.coalesce(a, b))


def clean_bounty(values: Column) -> Column:
    """The first value of digits and commas alone, with four digits or more."""
    good = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.rlike("^[0-9,]+$") & (F.length(F.replace(v, F.lit(","), F.lit(""))) >= 4))
    return F.concat(F.get(good, 0), F.lit(" Berries"))


def bounty_amount(values: Column) -> Column:
    return F.replace(F.split(clean_bounty(values), " ")[0], F.lit(","), F.lit("")).try_cast("bigint")


def is_noise(c: Column) -> Column:
    return c.isNull() | (c == "") | norm_key(c).isin(META_NOISE) | c.rlike("(?i)non-?canon")


def residences(values: Column) -> Column:
    """array<struct<place, current>> of every clause, in order."""
    clauses = F.flatten(F.transform(values, lambda v: F.split(v, ";")))
    all_ = F.transform(clauses, lambda c: F.struct(primary(F.array(c)).alias("place"), (~c.rlike("(?i)former|temporar|deceased|noncanon|non-canon")).alias("current")))
    return F.filter(all_, lambda s: s["place"].isNotNull())


def current_residence(values: Column) -> Column:
    return F.get(F.filter(residences(values), lambda s: s["current"] & ~is_noise(s["place"])), 0)["place"]


def lead(fact: Column, summary: Column) -> Column:
    """A sentence of fact, ended by punctuation, and the summary."""
    said = F.trim(fact)
    ended = F.when(said.rlike("[.!?]$"), said).otherwise(F.concat(said, F.lit(".")))
    return F.concat_ws(" ", ended, F.when(F.length(F.trim(summary)) > 0, F.trim(summary)))


def is_kingdom(c: Column) -> Column:
    return c.rlike(r"\bKingdom\b")


def must_know(title: Column, multi: list[str] = MUST_KNOW_MULTI, single: list[str] = MUST_KNOW_SINGLE) -> Column:
    t = F.lower(title)
    several = F.exists(literals(multi), lambda k: F.contains(t, k)) if multi else F.lit(False)
    one = F.arrays_overlap(F.regexp_extract_all(t, F.lit("[a-z]+"), 0), literals(single)) if single else F.lit(False)
    return several | one


def json_string(c: Column) -> Column:
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def content_hash(question: Column, options: Column) -> Column:
    """16 hex digits of the SHA-256 of the JSON [question, [sorted options]] with ', ' between elements."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(options), json_string), ", "), F.lit("]"))
    return F.substring(F.sha2(F.concat(F.lit("["), json_string(question), F.lit(", "), listed, F.lit("]")), 256), 1, 16)


def question_id(c: Column) -> Column:
    """The xor form of djb2 over UTF-16 units, unsigned 32 bits in base 36."""
    hexed = F.hex(F.encode(c, "UTF-16BE"))
    # one pass over the text: a substring at each place would read it from its start again
    units = F.transform(F.regexp_extract_all(hexed, F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("bigint"))
    step = lambda a, u: ((a * 33).bitwiseAND(F.lit(4294967295))).bitwiseXOR(u)
    h = F.aggregate(units, F.lit(5381).cast("bigint"), step)
    return F.concat(F.lit("q_"), F.lower(F.conv(h.cast("string"), 10, 36)))


def split_number(c: Column) -> Column:
    """struct<value, unit>; null where there is no number."""
    shape = rf"^{SPACE}*([0-9,.]+){SPACE}*([^\n]*)\z"  # a line end can't be passed over, not even at the end
    value = F.replace(F.regexp_extract(c, shape, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lower(trimmed(F.regexp_extract(c, shape, 2))).alias("unit")))


def is_number_word(c: Column) -> Column:
    t = F.regexp_extract_all(lowered(c), F.lit("[a-z]+"), 0)
    return (F.size(t) > 0) & F.forall(t, lambda x: F.array_contains(literals(NUMBER_WORDS + ARTICLES), x))


def is_name_like(c: Column) -> Column:
    """Half of its words but articles begin with a capital or digit."""
    own = F.filter(spaced(c), lambda t: ~F.array_contains(literals(ARTICLES), F.lower(F.btrim(t, F.lit(".,'\"")))))
    capital = F.filter(own, lambda t: t.rlike(r"^[\p{Lu}\p{Nd}]"))
    return (F.size(own) > 0) & ~is_number_word(c) & (F.size(capital) * 2 >= F.size(own))


def is_numeric_ladder(options: Column) -> Column:
    parsed = F.transform(options, split_number)
    units = F.array_distinct(F.transform(parsed, lambda p: p["unit"]))
    return F.forall(options, is_number_word) | (F.forall(parsed, lambda p: p.isNotNull()) & (F.size(units) == 1))


def is_entity_like(options: Column) -> Column:
    return F.forall(options, lambda o: (F.size(spaced(o)) <= 5) & is_name_like(o))


def is_parallel_enumeration(options: Column) -> Column:
    stems = F.array_distinct(F.transform(options, lambda o: F.regexp_replace(norm_key(o), "[0-9]+", "")))
    return (F.size(stems) == 1) & (stems[0] != "") & F.exists(options, lambda o: o.rlike("[0-9]"))


def stem_leak(question: Column, correct: Column, incorrect: Column) -> Column:
    shared = F.coalesce(F.flatten(F.transform(incorrect, words)), F.array().cast("array<string>"))
    own = F.array_except(words(correct), shared)
    return (F.size(own) > 0) & (F.size(F.array_except(own, words(question))) == 0)


def gloss_leak(question: Column, correct: Column, gloss: Column) -> Column:
    """A word of the answer's gloss, by its first five characters, stands in the question."""
    own, said = words(correct), F.lower(question)
    g = F.filter(words(gloss), lambda w: (F.length(w) >= 4) & ~F.array_contains(own, w))
    return F.exists(g, lambda w: F.contains(said, F.substring(w, 1, 5)))


def answer_len_outlier(correct: Column, incorrect: Column, apart: str = f"{SPACE}+") -> Column:
    """apart: the pattern that parts the answer's words."""
    long = F.size(F.filter(F.split(trimmed(correct), apart), lambda t: t != "")) >= 4
    return long & (F.size(incorrect) > 0) & (F.length(correct) >= 1.6 * F.array_max(F.transform(incorrect, F.length)))


def cross_domain(kinds: Column, others: Column) -> Column:
    """kinds: of the answer; others: array of the distractors' kinds. The distractors share a kind that the answer lacks entirely."""
    known = (F.size(kinds) > 0) & F.forall(others, lambda k: F.size(k) > 0)
    apart = ~F.exists(others, lambda k: F.arrays_overlap(kinds, k))
    return known & apart & (F.size(F.aggregate(others, F.get(others, 0), F.array_intersect)) > 0)


# -- markup and addresses


def clean_field(c: Column) -> Column:
    """Infobox markup as plain lines: array<string>, null if nothing is left. Templates are rendered before (see markup.render)."""
    t = c
    for pattern, new in MARKUP:
        t = F.regexp_replace(t, pattern, new)
    for old, new in QUOTES:
        t = F.replace(t, F.lit(old), F.lit(new))
    line = lambda s: F.trim(F.btrim(F.regexp_replace(F.trim(F.regexp_replace(s, "[ \t ]+", " ")), r"^-{2,}\s*", ""), F.lit(";,")))
    lines = F.filter(F.transform(F.split(t, "\n"), line), lambda s: s != "")
    return F.when(F.size(lines) > 0, lines)


def percent_decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def title_after_first(url: Column, mark: str = "/wiki/") -> Column:
    """The decoded rest after the first mark, underscores as spaces; null without the mark."""
    at = F.instr(url, mark)
    return F.when(at > 0, F.replace(percent_decoded(F.substr(url, at + len(mark))), F.lit("_"), F.lit(" ")))


def title_after_last(url: Column, mark: str = "/wiki/") -> Column:
    """The decoded rest after the last mark, up to a '#', trimmed."""
    return F.trim(F.substring_index(F.replace(percent_decoded(F.substring_index(url, mark, -1)), F.lit("_"), F.lit(" ")), "#", 1))


def source_url(title: Column, base: str) -> Column:
    """base plus the title with underscores, percent-encoded but for letters, digits and _.-~/:()#',!&"""
    t = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%23", "#"), ("%27", "'"), ("%2C", ","), ("%21", "!"), ("%26", "&"), ("%7E", "~"), ("*", "%2A")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.concat(F.lit(base), t)


def force_param(url: Column, host: str, name: str = "format", value: str = "png") -> Column:
    """The query parameter, added to addresses of a host that lack it."""
    has = url.rlike(f"[?&]{name}=")
    sep = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(F.contains(url, F.lit(host)) & ~has, F.concat(url, sep, F.lit(f"{name}={value}"))).otherwise(url)
