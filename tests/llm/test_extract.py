import math
import random
from collections import Counter

from triviary.llm.extract import BLOCK, Page, extract, host_of

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>{body}<footer>foot</footer></body></html>"


def text(html):
    return Page(html).text("h", frozenset())


def test_article_without_its_surroundings():
    html = PAGE.format(
        body="""<header>Site</header><div id="cookie-notice">We use cookies</div><aside>side</aside><article><h1>Title &amp; more</h1><p>One&nbsp;&nbsp; two<br>three <b>fo</b>ur<p>Next
        <script>var x = "</p><p>no";</script><!-- no --><form><p>mail</p></form><div class="ad">buy</div><ul><li>a<li>b</ul><section class="comments"><p>me too</p></section></article><div class="sidebar">x</div>"""
    )
    assert text(html) == "Title & more\n\nOne two three four\n\nNext\n\na\n\nb"


def test_odd_markup():
    assert text("") == "" and text("just text") == "just text" and text("a < b &lt; c") == "a < b < c"
    assert text("<p>x<!-- never closed") == "x"
    assert text("<div><p>one</div><p>two</p></p>three</section>") == "one\n\ntwo\n\nthree"
    assert text("<p>" + "word " * 100_000) == ("word " * 100_000).strip()
    assert text("<p hidden>x</p><p style='display:none'>y</p><p>z</p>") == "z"
    assert text("<div>" * 3000 + "deep") == "deep"


def test_branches_that_a_host_repeats_are_cut(spark):
    body = "<div class='x{i}'><p>story {i} {i}</p></div><div class='k'><p>All rights of this site are reserved</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body><div class='m'><p>story number {i}</p></div><div class='k'><p>The same words on each page</p></div></body></html>") for i in range(12)]
    rows += [(100, "http://other.example/", rows[0][2]), (101, None, None), (102, "http://h.example/", ""), (0, *rows[0][1:])]
    assert body
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", __import__("pyspark").sql.functions.lit(1))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    assert all(got[i, f"http://h.example/{i}"] == (f"story number {i}", len(f"story number {i}")) for i in range(12))
    assert got[100, "http://other.example/"][0] == "story number 0\n\nThe same words on each page"
    assert got[101, None] == ("", 0) and got[102, "http://h.example/"] == ("", 0)
    assert extract(df).count() == len(rows)
    assert extract(df.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    rows = [(i, "http://h.example/", "<html><body><div><p>one story that many pages copy</p></div></body></html>") for i in range(20)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"one story that many pages copy"}


def test_hosts():
    assert host_of("https://user@WWW.a.example:80/x?y") == "www.a.example" and host_of("//b.example") == "b.example" and host_of(None) == "" and host_of("nothing") == ""


def brute_tree(rows, low=0.3, least=4):
    """Contents of low importance of each host, from the definition, and the texts without them."""
    pages = [(host_of(u), Page(h or "")) for _, u, h in rows]
    seen = {}
    own = lambda p: [e for e in p.elements if e.last > e.first and e.tag in BLOCK and not e.noise and e.parent and e.tag not in ("body", "article", "main")]
    content = lambda p, e: (tuple(e.kids), tuple(t for t, _, _ in p.blocks[e.first : e.last]))
    for host, p in pages:
        different = tuple(t for t, e, _ in p.blocks if not e.noise)
        for e in own(p):
            seen.setdefault((host, e.path), set()).add((different, content(p, e)))
    bad = set()
    for path, held in seen.items():
        m = len({d for d, _ in held})
        if m < least:
            continue
        styles = Counter(style for _, style in {(d, c[0]) for d, c in held})
        n = sum(styles.values())
        entropy = -sum(x / n * math.log(x / n, m) for x in styles.values())
        for c in {c for _, c in held}:
            w = 0.9 ** len(c[0])
            if (1 - w) * entropy + w * (1 - math.log(sum(x == c for _, x in held), m)) < low:
                bad.add((*path, c))
    out = []
    for host, p in pages:
        gone = {i for e in own(p) if (host, e.path, content(p, e)) in bad for i in range(e.first, e.last)}
        main = any(e.main and not e.noise for _, e, _ in p.blocks)
        out.append("\n\n".join(t for i, (t, e, links) in enumerate(p.blocks) if i not in gone and not e.noise and (e.main or not main and links < 0.8)))
    return out


def test_against_the_definition(spark):
    rnd = random.Random(0)
    word = lambda: rnd.choice("alpha beta gamma delta omega".split())
    rows = []
    for i in range(90):
        host = f"h{i % 4}.example"
        story = "".join(f"<p>{word()} {word()} {rnd.randint(0, 60)}</p>" for _ in range(rnd.randint(1, 3)))
        own = f"<div class='end'><p>Written for {host}</p></div>" if rnd.random() < 0.9 else "<div class='end'><span>x</span><p>Guest</p></div>"
        body = f"<article><h1>{word()}</h1>{story}{own}</article>" if i % 3 else f"<div class='s'>{story}</div>{own}"
        rows.append((i, f"https://{host}/{i}", f"<html><body><div class='top'><p>Welcome to {host}</p></div>{body}<footer>{i}</footer></body></html>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(90)] == brute_tree(rows)
    # the tree alone removes what a site puts into its articles and beside them, and leaves what one page says
    assert not any("Written for" in t or "Welcome" in t for t in got.values())
    assert any("Guest" in t for t in got.values())


def test_parts_of_an_article_stay(spark):
    html = """<body><div class="discussion">out</div><article><div class="article-header"><h1>Title</h1></div><section class="discussion"><p>Results are discussed.</p></section>
    <div class="side-by-side"><p>Left and right</p></div><div class="header">Part one</div><section class="comments"><p>me too</p></section><div class="ad">buy</div><nav>menu</nav></article><div class="site-header">x</div></body>"""
    got = extract(spark.createDataFrame([(1, "http://a.example/1", html, "t")], "page_id long, url string, html string, cut string")).first()
    assert got.text == "Title\n\nResults are discussed.\n\nLeft and right\n\nPart one"


def test_edges(spark):
    import pytest

    df = spark.createDataFrame([(None, None, None), (None, "u", "<p>a</p>"), (1, "u", "<p>" + "long " * 300_000 + "</p>")], "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in extract(df).collect()}
    assert got[None, None] == "" and got[None, "u"] == "a" and len(got[1, "u"]) == 5 * 300_000 - 1
    assert extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        extract(df.withColumnRenamed("page_id", "text"), key="text")
