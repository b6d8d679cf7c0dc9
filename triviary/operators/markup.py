"""Wikitext: templates rendered to text, infoboxes to rows, first sentences to summaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Infobox templates by kind, templates without text, those of their first and of their last value, layout parameters,
# templates above the lead, words on which no sentence ends.
KINDS = {"char box": "character", "devil fruit box": "devil_fruit", "island box": "location", "chapter box": "chapter", "episode box": "episode"}
CITATIONS = frozenset(["qref", "qref/ext", "web ref", "webref", "refn", "ref", "sbs ref"])
FIRST, LAST = frozenset(["nihongo", "nihongo foot", "ruby", "lang"]), frozenset(["w", "sort", "wp", "wikipedia"])
SKIPPED = frozenset(["root", "colorscheme", "color scheme", "image", "imagename", "imagesize", "backcolor", "textcolor", "dfbackcolor", "dftextcolor", "border", "caption", "name", "title", "tab", "tabs"])
HATNOTES = frozenset(["you may", "for", "about", "main", "distinguish", "redirect", "see also", "seealso", "otheruses", "merge", "note", "spoiler", "expand", "cleanup"])
CONNECTIVES = "a an the of to in on for with and as by from into being is was were are known called named serving designated nicknamed".split()
WINDOW, LONGEST, BLOCK_LENGTH = 12000, 240, 120
BRACES = re.compile(r"\{\{|\}\}")
PASSES = 12


def parts(body: str) -> tuple[str, list[str], dict[str, str]]:
    """A template's name, its positional values and its named ones; pipes inside links and templates don't part."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"\[\[|\]\]|\{\{|\}\}|\|", body):
        if m[0] == "|":
            if not depth:
                out.append(body[at : m.start()])
                at = m.end()
        else:
            depth = max(0, depth + (1 if m[0] in ("[[", "{{") else -1))
    out.append(body[at:])
    place, named = [], {}
    for p in out[1:]:
        key, eq, value = p.partition("=")
        if eq and not re.search(r"[\[{<]", key):
            named[key.strip().lower()] = value
        else:
            place.append(p)
    return out[0].strip().lower(), place, named


def rendered(body: str) -> str:
    """What a template stands for; those inside it are rendered before."""
    name, place, _ = parts(body)
    if name in CITATIONS or name in ("b", "-") or not place:
        return ""
    return place[0] if name in FIRST else place[-1]


def render(text: str) -> str:
    """text with its templates rendered, the innermost first, to a height of PASSES; higher ones stay as they are around rendered ones.

    One pass: a template is rendered when it closes, as all inside it have closed by then, so a character is copied once per level and PASSES times at most.
    Braces are paired as they are read from the left, so what stands for a template opens and closes nothing: of {{{{a}}|b}} the inner one is {{a}}.
    """
    out, starts, at = [], [], 0
    for m in BRACES.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            out.append("{{")
            starts.append([len(out), 0])
        elif not starts:
            out.append("}}")
        else:
            start, below = starts.pop()
            if starts:
                starts[-1][1] = max(starts[-1][1], below + 1)
            if below >= PASSES:
                out.append("}}")
                continue
            value = rendered("".join(out[start:]))
            del out[start - 1 :]
            if value:
                out.append(value)
    out.append(text[at:])
    return "".join(out)


def spans(text: str) -> list[tuple[int, int]]:
    """Where the bodies of all templates begin and end, outer ones before those inside."""
    starts, found = [], []
    for m in BRACES.finditer(text):
        if m[0] == "{{":
            starts.append(m.end())
        elif starts:
            found.append((starts.pop(), m.start()))
    return sorted(found)


def outermost(text: str):
    """(start, end) of the templates that lie in no other."""
    depth, at = 0, 0
    for m in BRACES.finditer(text):
        if m[0] == "{{":
            if not depth:
                at = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                yield at, m.end()


def is_block(template: str) -> bool:
    """Whether a template stands above the prose (an infobox, a quote, a cross-reference) and not inside a sentence."""
    return parts(template[2:-2])[0] in HATNOTES or "\n" in template or len(template) > BLOCK_LENGTH


def prose(text: str) -> str | None:
    """The paragraphs at the top of an article that may be its lead, templates rendered; None without a bold name."""
    top = text[:WINDOW]
    if "'''" not in top:
        return None
    top = re.sub(r"(?s)<!--.*?-->", "", top)
    out, at = [], 0
    for start, end in outermost(top):
        if is_block(top[start:end]):
            out.append(top[at:start])
            at = end
    top = "".join([*out, top[at:]])
    top = re.sub(r"(?m)^=+.*?=+\s*$", "", re.sub(X.FILE_LINK, "", top))
    letters = lambda s: len(re.sub(r"[^A-Za-z]", "", s))
    return "\n\n".join(render(p) for p in map(str.strip, re.split(r"\n\s*\n", top)) if p[:1] not in (":", ";") and letters(p) >= 20)


def ordered(pages: DataFrame) -> DataFrame:
    """pages with ord, their order, if it isn't there."""
    return pages if "ord" in pages.columns else pages.withColumn("ord", F.monotonically_increasing_id())


def infoboxes(pages: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """(title, ns, kind, root, tabbed, raw, ord) of every infobox in page order; raw: map of its parameters, templates rendered; pages: (title, ns, text, ord).

    The cheap test on namespace and text comes first, below the Python stage; of the templates only those that begin with a kind's name are taken apart.
    """
    some = ordered(pages).where(F.col("ns").isin("0", "10") & F.contains("text", F.lit("Box"))).select("title", "ns", "text", "ord")
    schema = pa.schema([("title", pa.string()), ("ns", pa.string()), ("kind", pa.string()), ("root", pa.string()), ("tabbed", pa.bool_()), ("raw", pa.map_(pa.string(), pa.string())), ("ord", pa.int64())])

    head = re.compile(rf"\s*(?:{'|'.join(map(re.escape, kinds))})\s*(?:\||\Z)", re.IGNORECASE)

    def run(batches):
        for b in batches:
            rows = []
            for title, ns, text, at in zip(*(c.to_pylist() for c in b.columns)):
                for i, (start, end) in enumerate(spans(text)):
                    if not head.match(text, start, end):
                        continue
                    name, _, named = parts(text[start:end])
                    if name in kinds:
                        root = named.get("root")
                        raw = {k: render(v) for k, v in named.items() if k not in SKIPPED}
                        rows.append({"title": title, "ns": ns, "kind": kinds[name], "root": root if root is None or "{{{" in root else render(root), "tabbed": root is not None, "raw": list(raw.items()), "ord": at * BOXES + min(i, BOXES - 1)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return some.mapInArrow(run, "title string, ns string, kind string, root string, tabbed boolean, raw map<string, string>, ord long")


def articles(pages: DataFrame) -> DataFrame:
    """(title, article_len, summary) of every article (namespace 0), the last page of a title."""

    def run(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in text], pa.int64()), pa.array([prose(t or "") for t in text], pa.string()), b.column(2)], names=["title", "article_len", "prose", "ord"])

    rows = ordered(pages).where("ns = '0'").select("title", "text", "ord").mapInArrow(run, "title string, article_len long, prose string, ord long")
    last = rows.groupBy("title").agg(F.max_by(F.struct("article_len", "prose"), "ord").alias("x"))
    return last.select("title", "x.article_len", lead_summary(F.col("x.prose"), bold=False).alias("summary"))


#: More templates than a page has.
BOXES = 1 << 20


def facts(boxes: DataFrame, base: str, about: DataFrame | None = None) -> DataFrame:
    """Entities: one per (title, kind), the one with the most fields, of equals the first; with length and lead of the article of that title (see articles())."""
    fields = F.map_filter(F.transform_values("raw", lambda _, v: X.clean_field(v)), lambda _, v: v.isNotNull())
    title = F.when(F.col("tabbed"), F.get(X.clean_field(F.col("root")), 0)).when(F.col("ns") == "0", F.col("title"))
    rows = boxes.where(F.col("root").isNull() | ~F.contains("root", F.lit("{{{"))).withColumn("title", title).withColumn("fields", fields).where("title is not null and title <> ''").where(~F.contains("title", F.lit("{{{")) & (F.size("fields") > 0))
    one = rows.groupBy("title", "kind").agg(F.max_by(F.struct("tabbed", "fields"), F.struct(F.size("fields"), -F.col("ord"))).alias("x"), F.min("ord").alias("ord"))
    one = one.select("title", "kind", X.source_url(F.col("title"), base).alias("source"), "x.tabbed", "x.fields", "ord")
    if about is None:
        return one.withColumn("article_len", F.lit(0).cast("long")).withColumn("summary", F.lit(None).cast("string"))
    return one.join(about, "title", "left").withColumn("article_len", F.coalesce("article_len", F.lit(0).cast("long")))


def _let(value: Column, of) -> Column:
    """of(value), with value computed once however often it stands in there."""
    return F.get(F.transform(F.array(value), of), 0)


def tidy(s: Column) -> Column:
    """A sentence without spaces before punctuation, empty parentheses and last clauses that end on a connective, until none does."""
    dangling = rf"(?i)[,;]?\s+(?:{'|'.join(CONNECTIVES)})$"
    t = F.regexp_replace(F.regexp_replace(s, r"\s+([.,;:!?])", "$1"), r"\(\s*\)", "")
    t = F.btrim(F.regexp_replace(t, "[ \\t\u00a0]+", " "), F.lit(" ,;."))
    # from the last clause back: what is left once a clause doesn't dangle is kept
    cut = lambda a: F.when(a.rlike("[,;]"), F.btrim(F.regexp_replace(a, "[,;][^,;]*$", ""), F.lit(" ,;"))).otherwise("")

    def undangled(t):
        clauses = F.sequence(F.lit(1), F.size(F.split(t, "[,;]")))
        return F.when(t.rlike(dangling), F.aggregate(clauses, t, lambda a, _: F.when(a.rlike(dangling), cut(a)).otherwise(a))).otherwise(t)

    return _let(t, undangled)


def lead_summary(c: Column, window: int = WINDOW, most: int = LONGEST, bold: bool = True) -> Column:
    """The first prose paragraph's one or two sentences, at most `most` characters; templates are rendered before.

    Null where the top has no bold marker (unless bold is false) or no paragraph of 20 letters.
    """
    top = F.regexp_replace(F.substring(c, 1, window), r"(?s)<!--.*?-->", "")
    top = F.regexp_replace(F.regexp_replace(top, X.FILE_LINK, ""), r"(?m)^=+.*=+\s*$", "")
    letters = lambda s: F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    good = F.filter(F.transform(F.split(top, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: ~p.rlike("^[:;]") & (letters(p) >= 20))

    def summary(p):
        value = F.trim(F.regexp_replace(F.array_join(X.clean_field(p), " "), "[ \\t\u00a0]+", " "))
        # a sentence behind the first two counts for nothing
        two = F.aggregate(F.split(value, r"(?<=[.!?])\s+"), F.array().cast("array<string>"), lambda a, s: F.when(F.size(a) < 2, _let(tidy(s), lambda t: F.when(t != "", F.array_append(a, t)).otherwise(a))).otherwise(a))
        return _let(two, lambda two: F.when((F.length(F.get(two, 0)) < 120) & (F.size(two) > 1), F.concat(F.get(two, 0), F.lit(". "), F.get(two, 1))).otherwise(F.get(two, 0)))

    # nothing behind the first paragraph that counts is cleaned
    got = F.aggregate(good, F.lit(None).cast("string"), lambda a, p: F.when(a.isNotNull(), a).otherwise(_let(summary(p), lambda s: F.when(letters(s) >= 20, s))))
    short = lambda s: F.concat(F.regexp_replace(F.regexp_replace(F.substring(s, 1, most), r"\s\S*$", ""), "[ ,;]+$", ""), F.lit("…"))
    out = _let(got, lambda s: F.when(F.length(s) > most, short(s)).otherwise(F.concat(s, F.lit("."))))
    return F.when(F.contains(F.substring(c, 1, window), F.lit("'''")), out) if bold else out
