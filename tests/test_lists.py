"""Short lists, limits, visits, anchors and small texts on tables worked out by hand."""

import pytest
from corpuscle.functions import text
from corpuscle.operators import limits, lists, pages, site
from corpuscle.sources import history
from pyspark.sql import functions as F


def test_limits_are_checked():
    assert limits.checked({})["title_min"] == 30 and limits.checked({"title_min": 10, "extract_share": 1})["title_min"] == 10
    for wrong in ({"titel": 1}, {"title_min": True}, {"title_min": "3"}, {"title_min": 2.5}, {"title_min": 0}, {"title_min": 80}, {"title_max": 30}, {"thin_words": 900}, {"anchor_variety": 1.5}):
        with pytest.raises(ValueError):
            limits.checked(wrong)
    assert limits.checked({"title_min": 70, "title_max": 80})["title_max"] == 80


def test_limits_change_the_rules(spark):
    table = spark.createDataFrame([("title_min", "5"), ("extract_share", "0.5")], "name string, value string")
    found = limits.from_table(table)
    assert found["title_min"] == 5 and found["extract_share"] == 0.5
    for wrong in ([("title_min", "5"), ("title_min", "6")], [("title_min", None)], [("x", "1")]):
        with pytest.raises(ValueError):
            limits.from_table(spark.createDataFrame(wrong, "name string, value string"))
    parsed = pages.parse_pages(spark.createDataFrame([("https://x.it/", "<title>Short title</title>")], "url string, html string"))
    bad = lambda given: pages.findings(parsed, limits=given).filter("key = 'lex.title.bad'").first().severity
    assert (bad(None), bad(found)) == ("critical", "ok")


def test_lists(spark):
    ranked = spark.createDataFrame([("h", f"https://h/{c}", n, d, c == "z") for c, n, d in (("z", 0, 0), ("a", 3, 2), ("b", 3, 1), ("c", 5, None), ("d", 3, None))] + [("g", "https://g", 1, None, False), ("g", "https://g/1", 0, 1, False)], "host string, node string, incoming int, depth int, home boolean")
    shown = lists.graph_nodes(ranked, 4)
    assert [(r.place, r.node[-1], r.label) for r in shown.filter("host = 'h'").orderBy("place").collect()] == [(1, "z", "/z"), (2, "c", "/c"), (3, "a", "/a"), (4, "b", "/b")]
    edges = spark.createDataFrame([("https://h/z", "https://h/c"), ("https://h/z", "https://h/d"), ("https://h/b", "https://h/a")], "src string, dst string")
    assert {tuple(r) for r in lists.graph_links(edges, shown).collect()} == {("h", 1, 2), ("h", 4, 3)}
    assert [(r.host, r.node[-1]) for r in lists.representative_pages(ranked, 3).orderBy("host", "place").collect()] == [("g", "g"), ("g", "1"), ("h", "z"), ("h", "c"), ("h", "b"), ("h", "a")]
    assert [r.node for r in lists.representative_pages(ranked, 1).filter("host = 'g'").collect()] == ["https://g"]
    given = spark.createDataFrame([("o", "https://o/" + "x" * 40, 5), ("o", "https://o", 9), ("o", "https://o/e", 0), ("p", "https://p", 4)], "owner string, url string, words int")
    got = lists.largest_pages(given, spark.createDataFrame([("https://o", "critical")], "url string, severity string")).orderBy("place").collect()
    assert [(r.owner, r.label, r.words, r.severity) for r in got] == [("o", "/", 9, "critical"), ("o", "/" + "x" * 26 + "...", 5, "ok")]


def test_visits_anchors_and_small_texts(spark, tmp_path):
    visits = [("a", "u1", 200, None, 2.0, "same"), ("a", "u22", 200, "", 2.1, "same"), ("a", "u3", 500, "", 9.0, "same"), ("a", "u4", 200, "refused", 1.0, None), ("a", "u5", None, None, None, ""), ("b", "v", 200, "", 0.1, "x"), ("b", "w", 200, "", None, "")]
    found = pages.visit_findings(spark.createDataFrame(visits, "owner string, url string, status int, error string, elapsed double, text string"))
    assert {(r.owner, r.key, r.pages, r.example) for r in found.collect()} == {("a", "tech.pages.broken", 3, "u3"), ("a", "tech.slow", 1, "u22"), ("a", "tech.pages.duplicates", 1, "u22")}
    html = "".join(f"<a href='/p{i}'>Page <b>{i}</b> &amp; more</a>" for i in range(8)) + "<a href='/q'>here it is</a><a href=/r>Here it&nbsp;is</a><a href='https://b.it/'>outside</a><a href='/p1'>ab</a>"
    pairs = site.anchor_pairs(spark.createDataFrame([("https://a.it/1", html), ("https://a.it/2", html), ("https://b.it/", "<a href='/x'>only one</a>")], "url string, html string"))
    got = site.anchor_findings(pairs).collect()
    assert [(r.owner, r.key, r.texts, r.pairs, r.ambiguous) for r in got] == [("a.it", "tech.anchors.varied", 9, 10, 1)]
    assert site.anchor_findings(pairs, 0.95).first().severity == "warning"
    rows = spark.createDataFrame([("x", 1, "Tech", "3 bad: urls!"), ("x", 2, "Tech", "5 bad urls"), ("x", 3, "", "é"), ("y", 1, "A", "b" * 90)], "o string, n int, area string, title string")
    assert [r.anchor for r in text.numbered_anchors(rows, "o", "n").orderBy("o", "n").collect()] == ["r-tech-n-bad-urls", "r-tech-n-bad-urls-2", "r-rilievo", "r-a-" + "b" * 68]
    one = spark.range(1).select(text.score_verdict(F.lit(70.0)), text.score_verdict(F.lit(69.9)), text.score_verdict(F.lit(39.9)), text.score_verdict(F.lit(None).cast("double")), text.passage_label(F.lit("https://x"), F.lit(None).cast("string"))).first()
    assert tuple(one) == ("Buono", "Da migliorare", "Critico", None, "/  ·  (senza heading)")
    for name, content in (("semi.csv", "Top queries;Clicks;Impressions\na,b;1.000;5\nc;2;7\n"), ("comma.csv", "Query,Clicks,Impressions\nx;y,3,4\n")):
        (tmp_path / name).write_text(content)
    assert [tuple(r) for r in history.search_console(spark, str(tmp_path / "semi.csv")).collect()] == [("a,b", 1000, 5), ("c", 2, 7)]
    assert [tuple(r) for r in history.search_console(spark, str(tmp_path / "comma.csv")).collect()] == [("x;y", 3, 4)]
