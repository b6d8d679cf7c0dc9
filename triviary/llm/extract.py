"""Main text of web pages by a site style tree: branches of low importance on their host are removed.

The pages of a host are merged by element path (tags and classes from the root). Every path has the distribution of its styles (the
sequence of child tags) and of its contents over the host's pages. With m pages that have the path and n that have the
same content there, the content's importance is 1 - ln n / ln m; the presentation's is the entropy of the styles to the base m;
an element with l children weighs them (1 - g^l) : g^l, g = 0.9. A branch whose importance is under `low`, on a host with `pages` different pages
or more that have the path, is noise and is cut from the page. Pages with the same text count once, so copied articles don't become noise.

A priori importance: elements whose tag, role, class or id names a menu, header, footer, sidebar, notice, advert, form or comment
section have none, as such parts may differ from page to page and then look important to the tree; what <article> or <main> holds is the
page's content and the only one if there is one. The tree judges the elements inside it like all others, so a line that a site puts into
each of its articles goes too. A block of a page without <article> and <main> that is mostly links is a menu.

Statistics cover all pages of all hosts and are pre-aggregated per task. Branches are kept as 64-bit hashes in a table with their pages' keys; those that are cut
are joined to the pages by key, at any size.

Inside <article> and <main> a class or id names noise only if a whole name does (`comments`, not `article-header`); names that an article's own parts may bear,
such as `discussion` or `header`, don't count there.

Nulls: a null html is an empty page with an empty text; a null url counts as a host of its own name. Repeated rows are all extracted; an empty table gives no rows.
Unclosed and misnested tags are closed by their ancestors. Whole pages are used. Only key, url and html are read, so other columns can have any name; a key or url
named like a result raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, slices, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
# fixed values: HTML's elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select button xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion promotions nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs header masthead topbar footer foot bottombar sidebar side aside widget widgets related recommended recommendations "
    "notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login form search share sharing social comment comments disqus respond replies reply discussion pagination pager toolbar skip alert banner-ad".split()
)
#: Those that count inside an article too, as whole names.
INNER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar widget widgets related recommended recommendations "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies pagination pager toolbar banner-ad".split()
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
GAMMA = 0.9


def h64(*parts: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    __slots__ = ("tag", "parent", "path", "kids", "noise", "main", "blocks", "first", "last")

    def __init__(self, tag: str, parent: Element | None, attrs: str, first: int):
        names, noise = "", False
        inside = bool(parent and parent.main)
        if attrs:
            for m in NAMES.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                kind = m[1].lower()
                if kind == "role":
                    noise |= value.strip().lower() in NOISE_ROLES
                else:
                    names += f".{value}" if kind == "class" else ""
                    if inside:
                        noise |= any(word.lower() in INNER_NAMES for word in value.split())
                    else:
                        noise |= any(not NOISE_NAMES.isdisjoint(x.lower() for x in (word, *PARTS.findall(word))) for word in value.split())
            noise |= bool(HIDDEN.search(attrs))
        self.tag, self.parent, self.kids, self.first, self.last = tag, parent, [], first, first
        self.path = (parent.path if parent else "") + "/" + tag + names
        self.main = tag in ("article", "main") or inside
        self.noise = bool(parent and parent.noise) or tag not in ("html", "body", "article", "main") and (noise or tag in NOISE_TAGS or tag == "header" and not self.main)
        if parent:
            parent.kids.append(tag)


class Page:
    """blocks: (text, its element, share of it in links) in page order; elements in page order, each with its range of blocks."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, Element, float]] = []
        root = Element("html", None, "", 0)
        self.elements = [root]
        self._held: list[str] = []
        self._links = 0
        stack, links, at, end = [root], 0, 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                self._text(html[at:], links)
                break
            if m.start() > at:
                self._text(html[at : m.start()], links)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:  # an end
                if tag == "p" and not any(e.tag == "p" for e in stack) or tag == "br":
                    self._text(" ", links)
                k = len(stack) - 1
                while k > 0 and stack[k].tag != tag:
                    k -= 1
                if k > 0:
                    links -= sum(e.tag == "a" for e in stack[k:])
                    if tag in BLOCK:
                        self._flush(stack[-1])
                    for e in stack[k:]:
                        e.last = len(self.blocks)
                    del stack[k:]
                elif tag in BLOCK:
                    self._flush(stack[-1])
                continue
            attrs = m[3] or m[6] or ""
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                if not attrs.endswith("/") or tag not in ("svg", "math"):
                    at = close.end() if close else end
                self._text(" ", links)
                continue
            if tag in ("html", "body") and any(e.tag == tag for e in stack):
                continue
            if tag == "head":
                continue
            if tag in BLOCK:
                self._flush(stack[-1])
                k = len(stack) - 1
                while k > 0:  # what this start closes
                    if tag in CLOSES.get(stack[k].tag, ()):
                        links -= sum(e.tag == "a" for e in stack[k:])
                        for e in stack[k:]:
                            e.last = len(self.blocks)
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCK and stack[k].tag not in ("p",):
                        break
                    k -= 1
            if tag in VOID:
                if tag in ("br", "hr", "img", "wbr") and tag != "wbr":
                    self._text(" ", links)
                continue
            e = Element(tag, stack[-1], attrs, len(self.blocks))
            if tag == "a":
                links += 1
            self.elements.append(e)
            if not attrs.endswith("/") or tag in BLOCK or tag == "a":
                stack.append(e)
        self._flush(stack[-1])
        for e in stack:
            e.last = len(self.blocks)

    def _text(self, raw: str, links: int) -> None:
        self._held.append(raw)
        if links > 0:
            self._links += len(raw)

    def _flush(self, e: Element) -> None:
        if self._held:
            raw = "".join(self._held)
            text = " ".join(unescape(raw).split()) if "&" in raw else " ".join(raw.split())
            if text:
                while e.tag not in BLOCK and e.parent:
                    e = e.parent
                self.blocks.append((text, e, self._links / len(raw)))
            self._held, self._links = [], 0

    def features(self, host: str) -> Iterator[tuple[Element, int, int, int, int]]:
        """Elements that the statistics judge, with the hashes of host and path, style, and path, style and content; and the number of children."""
        for e in self.elements:
            if e.last > e.first and e.tag in BLOCK and not e.noise and e.parent and e.tag not in ("body", "article", "main"):
                style = " ".join(e.kids)
                yield e, h64(host, e.path), h64(style), h64(host, e.path, style, *(t for t, _, _ in self.blocks[e.first : e.last])), len(e.kids)

    def signature(self) -> int:
        return h64(*(t for t, e, _ in self.blocks if not e.noise))

    def text(self, host: str, cut: set[int] | frozenset[int]) -> str:
        main = any(e.main and not e.noise for _, e, _ in self.blocks)
        out = [False] * len(self.blocks)
        if cut:
            for e, _, _, key, _ in self.features(host):
                if key in cut:
                    out[e.first : e.last] = [True] * (e.last - e.first)
        return "\n\n".join(t for (t, e, links), gone in zip(self.blocks, out) if not e.noise and not gone and (e.main or not main and links < 0.8))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def branches(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(path, style, kids, content, page, key) of every judged branch of every page."""
    kind = pages.schema[key].dataType

    def run(batches):
        for b in slices(batches, 2):
            rows = set()
            for k, u, h in zip(*(c.to_pylist() for c in b.columns)):
                if h:
                    p, host = Page(h), host_of(u)
                    sig = p.signature()
                    rows.update((path, style, n, content, sig, k) for _, path, style, content, n in p.features(host))
            if rows:
                *cols, keys = zip(*rows)
                made = [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([*made, pa.array(keys, b.schema.types[0])], names=["path", "style", "kids", "content", "page", "key"])

    return pages.select(key, url, html).mapInArrow(run, f"path long, style long, kids int, content long, page long, key {kind.simpleString()}")


def noise(found: DataFrame, low: float, pages: int) -> DataFrame:
    """(content): hashes of branches whose importance is under `low`."""
    one = written(found.select("path", "style", "kids", "content", "page").distinct(), "branches")  # copies of a page count once
    m = one.groupBy("path", "page").agg(F.lit(1).alias("x")).groupBy("path").agg(F.count("*").alias("m")).where(F.col("m") >= pages)
    styles = one.groupBy("path", "style", "page").agg(F.lit(1).alias("x")).groupBy("path", "style").agg(F.count("*").alias("s"))
    total = styles.groupBy("path").agg(F.sum("s").alias("all"), F.sum(F.col("s") * F.log("s")).alias("slogs"))
    contents = one.groupBy("path", "kids", "content").agg(F.count("*").alias("n")).where("n > 1")
    weight = F.pow(F.lit(GAMMA), F.col("kids"))
    presentation = (F.log("all") - F.col("slogs") / F.col("all")) / F.log("m")
    content = 1 - F.log("n") / F.log("m")
    return contents.join(m, "path").join(total, "path").where((1 - weight) * presentation + weight * content < low).select("content")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", low: float = 0.3, least_pages: int = 4) -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    free(pages.select(key, url), "text", "n_chars")
    found = written(branches(pages, key, url, html), "pages-branches")  # pages are parsed once for all that is counted
    bad = written(noise(found, low, least_pages).distinct(), "noise")
    cuts = found.join(bad, "content").groupBy("key").agg(F.collect_set("content").alias("cut")).withColumnRenamed("key", "_page")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"))
    joined = rows.join(cuts, F.col("_key").eqNullSafe(F.col("_page")), "left").select("_key", "_url", "_html", "cut")
    schema = T.StructType([pages.schema[key], T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in slices(batches, 2):
            texts = [Page(h).text(host_of(u), frozenset(c or ())) if h else "" for u, h, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
