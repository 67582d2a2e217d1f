"""Link graph, sections, structured data and findings of a small site, against values worked out by hand."""

import json
import random
from html.parser import HTMLParser

import pytest
from corpuscle.functions.text import tokenize
from corpuscle.operators import blocks, graph, pages, scores, site
from pyspark.sql import functions as F

LONG = " ".join(f"word{i}" for i in range(40))


def page(path, links=(), head="", body=""):
    anchors = "".join(f"<a class='x' href='{t}'>{t}</a>" for t in links)
    return (f"https://x.it{path}", f"<html lang='it'><head><title>T {path}</title>{head}</head><body>{anchors}{body}</body></html>", f"https://x.it{path}old")


@pytest.fixture(scope="module")
def given(spark):
    chain = [page(f"/c{i}", [f"/c{i + 1}"]) for i in range(1, 10)] + [page("/c10")]
    rows = [page("/", ["/c1", "/gone", "#top", "mailto:a@x.it", "/moved/old", "b"]), *chain, page("/moved/"), page("/b", ["https://x.it/b/", "/"]), page("/lone", ["/c1"])]
    return spark.createDataFrame(rows + [(None, None, None)], "url string, html string, final_url string")


def test_links_orphans_and_depths_without_a_limit(spark, given):
    edges = site.page_edges(given, alias_col="final_url")
    got = {(r.src.removeprefix("https://x.it"), r.dst.removeprefix("https://x.it")) for r in edges.collect()}
    assert got == {("/", "/c1"), ("/", "/moved"), ("/", "/b"), ("/b", "/"), ("/lone", "/c1")} | {(f"/c{i}", f"/c{i + 1}") for i in range(1, 10)}
    nodes, home = site.page_nodes(given), site.homes(given)
    assert [r.node for r in home.collect()] == ["https://x.it/"]
    assert [r.node for r in graph.orphans(edges, nodes.select("node"), home).collect()] == ["https://x.it/lone"]
    depth = graph.depths(edges, home)
    assert {r.node.removeprefix("https://x.it"): r.depth for r in depth.collect()} == {"/": 0, "/moved": 1, "/b": 1, **{f"/c{i}": i for i in range(1, 11)}}
    assert {r.bucket: r.nodes for r in graph.depth_histogram(depth, nodes.select("node")).collect()} == {"0": 1, "1": 3, "2": 1, "3": 1, "4+": 7, "unreachable": 1}
    found = {r.key: r.severity for r in site.link_findings(edges, nodes, home, depth).collect()}
    assert found == {"tech.links.orphans": "warning", "tech.links.deep": "warning"}
    empty = given.limit(0)
    assert site.page_edges(empty).count() == 0 and graph.depths(site.page_edges(empty), site.homes(empty)).count() == 0


def test_heads_take_attributes_in_any_order(spark):
    head = """<meta content='D' name='Description'><link href="/c" rel=canonical><meta property="og:title" content="O"><META NAME=robots CONTENT='NoIndex, noarchive'><link rel='alternate' hreflang='fr' href='/fr'>"""
    rows = [page("/a", head=head, body="<img src=x alt=' '><img alt='y'><h2 class='k'>Q?</h2>"), ("https://x.it/n", None, None)]
    a, n = sorted(site.page_heads(spark.createDataFrame(rows, "url string, html string, f string")).collect(), key=lambda r: r.url)
    assert (a.lang, a.description, a.canonical, a.og_title, a.og_image, a.robots, a.hreflangs, a.images, a.images_with_alt) == ("it", "D", "/c", "O", "", "noindex, noarchive", 1, 2, 1)
    assert [(h.level, h.text) for h in a.headings] == [(2, "Q?")] and (n.title, n.images, n.headings) == ("", 0, [])


def test_site_findings(spark):
    head = "<meta name='robots' content='noindex'><meta name='bingbot' content='nocache'><meta property='og:title' content='O'><meta name='description' content='short'>"
    rows = [page("/sample-page", head=head, body="<h1>You won't believe</h1><img><img><img alt='a'>"), page("/z", body="<p>Lorem ipsum dolor</p>")]
    rows[1] = (rows[1][0], rows[1][1].replace("T /z", "T /sample-page"), None)
    given = spark.createDataFrame(rows, "url string, html string, f string")
    found = {r.key: (r.severity, r.weight) for r in site.site_findings(site.page_rows(given)).collect()}
    assert found == {
        "tech.pages.count": ("warning", 2.0), "tech.pages.placeholder": ("critical", 2.0), "tech.pages.noindex": ("warning", 1.0), "tech.msft.nocache": ("info", 1.0), "tech.meta.og_missing": ("warning", 1.0),
        "tech.meta.og_partial": ("warning", 1.0), "tech.hreflang.na": ("info", 1.0), "lex.desc.short": ("warning", 1.0), "lex.clickbait.found": ("warning", 1.5), "lex.title.dup": ("warning", 1.0), "lex.alt.partial": ("warning", 1.0),
    }


class Loop(HTMLParser):
    """Blocks by a parser of the standard library and a list of open elements."""

    heads, lists = ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.made, self.skip = [], [], 0

    def close(self, index):
        del self.open[index:]

    def index(self, names, above=-1):
        return next((i for i in range(len(self.open) - 1, above, -1) if self.open[i][0] in names), None)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "svg"):
            self.skip += 1
        list_at = self.index(self.lists)
        list_at = -1 if list_at is None else list_at
        at = None
        if tag == "li":
            at = self.index(("li",), list_at)
        elif tag in self.heads:
            at = self.index(self.heads)
        if at is None and (tag in ("p", "li", *self.heads, *self.lists) or tag in blocks.CLOSERS):
            at = self.index(("p",))
        if at is not None:
            self.close(at)
        if tag in ("p", "li", *self.heads, *self.lists):
            pieces = []
            self.open.append((tag, pieces))
            self.made.append((tag, pieces))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "svg"):
            self.skip -= 1
        list_at = self.index(self.lists)
        at = self.index((tag,)) if tag in self.lists else self.index(("li",), -1 if list_at is None else list_at) if tag == "li" else self.index(self.heads) if tag in self.heads else self.index(("p",)) if tag == "p" or tag in blocks.CLOSERS else None
        if at is not None:
            self.close(at)

    def handle_data(self, data):
        for _, pieces in self.open:
            if not self.skip:
                pieces.append(data)

    @classmethod
    def of(cls, html):
        loop = cls()
        loop.feed(html)
        rows = [(t, " ".join(" ".join(x).split())) for t, x in loop.made]
        return [("h" if t[0] == "h" else "p", int(t[1]) if t[0] == "h" else 0, x) for t, x in rows if t in ("h1", "h2", "h3", "h4", "p", "li") and x and (t[0] == "h" or len(x) >= 40)]


def test_blocks_match_a_loop(spark):
    draw = random.Random(2)
    bits = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<ol>", "</ol>", "<h2>", "</h2>", "<h5>", "</h5>", "<h1 class='a'>", "<div>", "</div>", "<b>", "</b>", "<br>", "<P ID=x>", "</LI>", LONG, LONG[:60], "x", " &amp; ", "&nbsp;", "é\n", "<!-- <p>no</p> -->", "<script>var a='<p>'</script>", "<table><tr><td>", "</td></tr></table>"]
    htmls = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(300)]
    given = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)] + [(-1, None), (-2, "")], "i int, html string")
    got = {r.i: [tuple(b) for b in r.blocks] for r in blocks.page_blocks(given, "i").collect()}
    assert got.pop(-1) == got.pop(-2) == []
    for i, h in enumerate(htmls):
        assert got[i] == Loop.of(h), h


def test_blocks_of_the_given_pages_match_a_loop(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: [tuple(b) for b in r.blocks] for r in blocks.page_blocks(rows, "page_id").collect()}
    want = {r.page_id: Loop.of(r.html or "") for r in rows.collect()}
    assert got == want and sum(map(len, want.values())) > 100


def by_hand(title, blocks, target):
    out, head, buf = [], title, []

    def close():
        if buf:
            out.append((head, " ".join(buf)))
            buf.clear()

    for kind, text in blocks:
        if kind == "h":
            close()
            head = text
        else:
            buf.extend(text.split())
            if len(buf) >= target:
                close()
    close()
    return [(h, t, i) for i, (h, t) in enumerate(out) if len(t.split()) >= 15]


def test_sections_follow_headings(spark):
    words = lambda n, at=0: " ".join(f"w{i}" for i in range(at, at + n))
    made = [("p", words(20)), ("h", "One"), ("p", words(14)), ("h", "Two"), ("p", words(30)), ("p", words(30, 50)), ("p", words(16)), ("h", "Three"), ("h", "Four"), ("p", words(60))]
    body = "".join(f"<h2>{t}</h2>" if k == "h" else f"<p class='a'>{t}</p>" for k, t in made) + "<p> </p><script>var a='<p>no</p>'</script>"
    got = site.sections(spark.createDataFrame([page("/s", body=body), ("u", None, None)], "url string, html string, f string"), target=50).orderBy("index").collect()
    assert [(r["heading"], r["text"], r["index"]) for r in got] == by_hand("T /s", made, 50)
    assert all(r.words == len(r.text.split()) for r in got)


def test_section_findings(spark):
    body = "<h2>What is it?</h2>" + f"<p>This {LONG}</p>" + f"<h2>FAQ</h2><p>{LONG} for example [1] [2] [3]</p>"
    given = spark.createDataFrame([page("/s", body=body), ("https://y.it/", "<html><h1>Hi</h1></html>", None)], "url string, html string, f string")
    found = site.section_findings(site.sections(given), site.page_rows(given), tokenize(F.col("text"))).collect()
    assert {(r.key, r.severity, r.weight) for r in found if r.owner == "y.it"} == {("sem.chunks.none", "critical", 3.0)}
    assert {r.key: r.severity for r in found if r.owner == "x.it"} == {
        "sem.chunks.few": "warning", "sem.anaphora.high": "warning", "sem.questions.few": "ok", "sem.faq.missing": "ok", "sem.defs.low": "warning", "sem.examples.few": "ok", "sem.vocab.narrow": "warning", "sem.refs.missing": "ok",
    }


def ld(*blocks):
    return "".join(f"<script type='application/ld+json'>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks)


def test_jsonld_types_and_checks(spark):
    faq = {"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q", "acceptedAnswer": {"text": "a"}}]}
    good = ld(faq, {"@graph": [{"@type": ["Organization", "Thing"], "name": "n", "url": "https://x.it", "logo": "https://x.it/l.png"}, {"@type": "WebSite", "name": "n", "url": "u"}, {"@type": "BreadcrumbList", "itemListElement": [1]}]}, "{broken")
    bad = ld(
        [{"@type": "FAQPage", "mainEntity": {"@type": "Question", "name": "q"}}, {"@type": "Product", "name": "p"}],
        {"@type": "Offer", "price": "12 €", "priceCurrency": "EUR"}, {"@type": "AggregateRating", "ratingValue": 7}, {"@type": "Article", "headline": "h", "datePublished": "May 2020", "image": ["a.png"]},
    )
    rows = [("https://good.it/", good, None), ("https://bad.it/", bad, None), ("https://bad.it/b", "<p>x", None), ("https://none.it/", None, None)]
    given = spark.createDataFrame(rows, "url string, html string, f string")
    nodes = site.jsonld_nodes(given)
    types = sorted({t for r in nodes.filter("url = 'https://good.it/'").collect() for t in r.types})
    assert types == ["BreadcrumbList", "FAQPage", "Organization", "Question", "Thing", "WebSite"]
    found = {}
    for r in site.jsonld_findings(nodes, given).collect():
        found.setdefault(r.owner, {})[r.key] = r.severity
    assert found["none.it"] == {"sd.jsonld.none": "critical"}
    assert found["good.it"] == {"sd.jsonld.ok": "ok", "sd.entity.missing": "ok", "sd.check.ok": "ok"}
    assert found["bad.it"] == {
        "sd.jsonld.ok": "ok", "sd.entity.missing": "critical", "sd.type.breadcrumblist": "info", "sd.type.website": "info", "sd.jsonld.partial": "warning",
        **{f"sd.check.{k}": "warning" for k in ("incomplete", "faq", "offers", "product", "rating", "dates", "urls")},
    }


def test_scores_round_halves_to_even(spark):
    rows = [("o", "a", "ok", 1.0), ("o", "a", "critical", 15.0), ("p", "a", "ok", 3.0), ("p", "a", "critical", 5.0)]
    got = {r.owner: r.score for r in scores.area_scores(spark.createDataFrame(rows, "owner string, area string, severity string, weight double")).collect()}
    assert got == {"o": 6.2, "p": 37.5}


def test_topics_of_headings_and_retrieval_findings(spark):
    from corpuscle.operators import retrieval

    given = spark.createDataFrame([page("/t", body="<h2>Deep water diving</h2><h3>what does diving</h3><h3>How it is</h3>"), (None, None, None)], "url string, html string, f string")
    got = {r.topic: r.weight for r in retrieval.heading_topics(site.page_heads(given), ["what", "does"]).collect()}
    assert got == {"deep water": 3, "water diving": 3, "diving": 1}
    agreed = spark.createDataFrame([("a", 5, True), ("b", 0, True), ("c", 0, False)], "query string, consensus long, covered boolean")
    assert {r.key: (r.severity, r.weight) for r in retrieval.retrieval_findings(agreed, 5).collect()} == {"rrf.consensus": ("warning", 2.0), "rrf.uncovered": ("critical", 2.0)}
    assert [r.key for r in retrieval.retrieval_findings(agreed.limit(0), 5).collect()] == ["rrf.not_runnable"]
    slots = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "query long, owner string")
    owners = spark.createDataFrame([("a",), ("b",), ("c",)], "owner string")
    got = {r.owner: tuple(r)[1:] for r in retrieval.share_findings(slots, owners).collect()}
    assert got == {"a": (3, 75.0, 0, "ok", "ok"), "b": (1, 25.0, 1, "warning", "warning"), "c": (0, 0.0, 2, "critical", "critical")}


def test_links_are_resolved_decoded_and_counted_by_occurrence(spark):
    rows = [
        ("https://a.it/x/y", '<a href="../c">1</a><a href="./d">2</a><a href=\'/e?x=1&amp;y=2\'>3</a><a href="../c#part">again</a><a href="https://b.it/x">out</a><a href="../../../c/">third</a>'),
        ("https://a.it/c", '<a href="/x/./y">b</a>'),
        ("https://a.it/x/d", ""),
        ("https://a.it/e?x=1&y=2", '<a href="https://a.it/x/d">abs</a>'),
        ("https://b.it/x", '<a href="//a.it/c">other host</a><a>none</a><a href="">empty</a>'),
        ("https://b.it/", ""),
    ]
    given = spark.createDataFrame(rows, "url string, html string")
    links = site.page_links(given)
    degree = {r.node: (r.links, r.sources) for r in graph.in_degree(links, site.page_nodes(given).select("node")).collect()}
    assert degree == {"https://a.it/x/y": (1, 1), "https://a.it/c": (3, 1), "https://a.it/x/d": (2, 2), "https://a.it/e?x=1&y=2": (1, 1), "https://b.it/x": (0, 0), "https://b.it/": (0, 0)}
    assert {r.node for r in graph.orphans(links, site.page_nodes(given).select("node"), site.homes(given)).collect()} == {"https://b.it/x"}
    assert site.page_edges(given).count() == 5


def test_character_references(spark):
    row = spark.createDataFrame([("A &amp; B &#233;&#xE9; &#128512; &nope; &lt;p&gt; &; & &#0; &amp;amp; caf&eacute",)], "t string").select(site.decoded(F.col("t"))).first()
    assert row[0] == "A & B éé 😀 &nope; <p> &; & &#0; &amp; caf&eacute"


def test_jsonld_keeps_zeros_and_survives_depth(spark):
    deep = '{"a":' * 1500 + '{"@type":"Person"}' + "}" * 1500
    deeper = "[" * 200_000 + "]" * 200_000
    rows = [
        ("https://z.it/1", ld({"@type": "Product", "name": "x", "offers": {"@type": "Offer", "price": 0, "priceCurrency": "EUR"}})),
        ("https://z.it/2", ld({"@type": "AggregateRating", "ratingValue": 0, "reviewCount": 3})),
        ("https://z.it/3", f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">{deeper}</script>'),
        ("https://z.it/4", ld({"@type": ["Organization", "Brand"], "name": "", "url": 0}, {"@type": "ImageObject", "url": "https://z.it/i.png"})),
    ]
    given = spark.createDataFrame(rows, "url string, html string")
    nodes = site.jsonld_nodes(given)
    assert nodes.filter("url = 'https://z.it/3'").count() == 1501
    found = {r.key for r in site.jsonld_findings(nodes, given).collect()}
    assert "sd.check.offers" not in found and "sd.check.rating" in found
    types = {r.type: r.pages for r in site.jsonld_types(nodes).collect()}
    assert types == {"Product": 1, "Offer": 1, "AggregateRating": 1, "Person": 1, "Organization": 1, "Brand": 1, "ImageObject": 1}
    missing = {r.type: (r.checked, r.missing, r.pages) for r in site.jsonld_missing(nodes).collect()}
    assert missing["Organization"] == (1, ["name", "url"], 1) and missing["ImageObject"] == (1, [], 0) and missing["AggregateRating"] == (1, ["ratingValue"], 1)


def test_parsed_pages_take_attributes_in_any_quotes(spark):
    html = "<html lang='it'><head><meta content='d' NAME='description'><link href='/c' rel='canonical'><meta content='x' name=viewport></head><body>t</body></html>"
    row = pages.parse_pages(spark.createDataFrame([("https://x.it/a", html)], "url string, html string")).first()
    assert (row.lang, row.description, row.canonical, row.has_viewport) == ("it", "d", "/c", True)


def test_titles_with_the_host_and_pages_not_found(spark):
    def found(url, title, body):
        given = spark.createDataFrame([(url, f"<html><head><title>{title}</title></head><body>{body}</body></html>")], "url string, html string")
        return {r.key for r in pages.findings(pages.parse_pages(given)).filter("severity <> 'ok'").collect()}

    assert "lex.title.bad" in found("https://shop.it/a", "Everything about lamps | Shop.it store", "x")
    assert "lex.title.bad" not in found("https://shop.it/a", "Everything about lamps in the store", "x")
    assert "lex.title.bad" not in found("https://shop.it/a", "Everything about lamps, shop.it and all that goes with them, long", "x")
    many = "word " * 200
    assert "tech.pages.soft404" in found("https://shop.it/a", "Shop", f"<h1>Page not found</h1>{many}")
    assert "tech.pages.soft404" not in found("https://shop.it/a", "Shop", f"<h1>A</h1><h2>B</h2><h3>Page not found</h3>{many}")
    assert "tech.pages.soft404" in found("https://shop.it/a", "Shop", "page not found")
    assert "tech.pages.soft404" not in found("https://shop.it/a", "Shop", "w" * 1600 + " page not found")


def test_redirects(spark):
    rows = [
        ("http://a.it/x", "https://a.it/x/", "http_left"), ("http://a.it/x", "http://www.a.it/x", "www_mixed"), ("https://www.a.it/x?q=1", "http://a.it/x?q=1", "www_mixed"), ("https://a.it/x", "http://a.it/x", "moved"),
        ("http://a.it/x", "https://a.it/y", "moved"), ("http://a.it/x", "https://www.a.it/y", "moved"), ("http://a.it", "http://a.it/#t", None), ("http://a.it/x", "", None), ("http://a.it/x", None, None),
    ]
    given = spark.createDataFrame(rows, "url string, final_url string, want string")
    assert all(r.redirect == r.want for r in site.redirects(given).collect())
    found = site.redirect_findings(given.selectExpr("want as owner", "url", "final_url", "if(want = 'moved', 2, null) as redirects")).collect()
    assert {(r.owner, r.key) for r in found} == {(k, f"tech.redirect.{k or 'none'}") for k in ("http_left", "www_mixed", "moved", None)} | {("moved", "tech.redirect.chains")}


def test_share_map_has_every_owner(spark):
    from corpuscle.operators import retrieval

    owners = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, None)], "doc long, owner string")
    fused = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (2, 2, 1), (2, 3, 2)], "query long, doc long, rank long")
    asked = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "query long")
    got = {r.owner: tuple(r)[1:] for r in retrieval.share_map(retrieval.share_of_voice(fused, owners), owners, asked).collect()}
    assert got == {"a": (75.0, 0.5, 19.0), "b": (25.0, 0.25, 12.0), None: (0.0, 0.0, 12.0)}
    none = retrieval.share_map(retrieval.share_of_voice(fused.limit(0), owners), owners, asked.limit(0)).collect()
    assert {(r.share, r.presence) for r in none} == {(0.0, 0.0)} and len(none) == 3
