"""Dates, authors, contacts, coverage, filler, acronyms and audit roll-ups, against values worked out by hand."""

import json
import re

from corpuscle.operators import audits, pages, site, trust
from pyspark.sql import functions as F

SCHEMA = "url string, html string"


def script(data):
    return f'<script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script>'


def test_declared_dates_and_freshness(spark):
    rows = [
        ("https://a.it/1", '<meta content="2024-03-01T10:00" property="article:published_time"><meta name="author" content="X">'),
        ("https://a.it/2", script({"@graph": [{"@type": "Article", "dateModified": "2025-02-28", "author": {"name": "Y"}}]}) + script("{not json, \"dateModified\": \"2025-12-01\"")),
        ("https://a.it/3", script({"datePublished": "soon", "dateModified": 20250101})),
        ("https://a.it/4", script({"datePublished": "20250228"})),
        ("https://a.it/4", "<p>again, and nothing</p>"),
        ("https://b.it/", script({"dateModified": "2025-02-30"})),
        ("https://c.it/", '<meta property="article:modified_time" content=" 2020-01-01">'),
        (None, script({"dateModified": "2025-03-01"})),
        ("https://d.it/", None),
    ]
    facts = trust.declared(spark.createDataFrame(rows, SCHEMA))
    got = {r.url: (r.author, r.dated, str(r.updated)) for r in facts.collect()}
    assert got == {
        "https://a.it/1": (True, True, "2024-03-01"), "https://a.it/2": (True, True, "2025-02-28"), "https://a.it/3": (False, True, "None"), "https://a.it/4": (False, True, "2025-02-28"),
        "https://b.it/": (False, True, "None"), "https://c.it/": (False, True, "2020-01-01"), "https://d.it/": (False, False, "None"),
    }
    age = lambda day: {r.owner: (r.key, r.severity, r.weight, r.url, r.days) for r in trust.freshness(facts, F.lit(day).cast("date")).collect()}
    assert age("2026-02-28")["a.it"] == ("sem.fresh.ok", "ok", 1.0, "https://a.it/4", 365)
    assert age("2026-03-01")["a.it"] == ("sem.fresh.stale", "warning", 1.0, "https://a.it/4", 366)
    assert age("2024-01-01")["a.it"][1:] == ("ok", 1.0, "https://a.it/4", 0)
    assert age("2026-03-01")["c.it"][:3] == ("sem.fresh.very_stale", "warning", 2.0) and set(age("2026-03-01")) == {"a.it", "c.it"}
    oldest = {r.owner: r.oldest for r in trust.freshness(facts, F.lit("2026-03-01").cast("date")).collect()}
    assert oldest["a.it"] == ["https://a.it/1 (2024-03-01)", "https://a.it/2 (2025-02-28)", "https://a.it/4 (2025-02-28)"]


def test_trust_findings(spark):
    rows = [
        ("https://a.it/", '<meta name="author" content="X"><a href="/Chi-Siamo/">us</a><a href="TEL:+39">call</a>'),
        ("https://b.it/", "<p>write to info@b.it</p><a href='https://other.it/about'>not here</a>"),
        ("https://c.it/contact", "<p>nothing</p>"),
        (None, "<a href='mailto:x@y.it'>x</a>"),
    ]
    given = spark.createDataFrame(rows, SCHEMA)
    found = trust.trust_findings(given, trust.declared(given), pages.parse_pages(given).select("url", "text")).collect()
    ok = {(r.owner, r.key.split(".")[2]) for r in found if r.severity == "ok"}
    assert ok == {("a.it", "author"), ("a.it", "about"), ("a.it", "contact"), ("b.it", "contact"), ("c.it", "contact")} and len(found) == 12


def test_topic_coverage_and_filler(spark):
    good = "<title>What is massage</title><h2>History</h2><h3>Use cases</h3><h4>Risks</h4><h5>Outlook</h5>"
    rows = [("https://a.it/", good), ("https://a.it/2", "<h1>FAQ</h1>"), ("https://b.it/", "<h1>Kidney brisk</h1>"), ("https://c.it/", "<p>no heads</p>")]
    cover = {r.owner: (r.covered, r.missing, r.severity, r.weight) for r in trust.topic_coverage(site.page_heads(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert cover == {"a.it": (5, "prospettive", "ok", 1.0), "b.it": (0, "definizione, storia, casi d'uso, limiti, faq, prospettive", "warning", 2.0)}
    words = "plain word " * 60
    texts = [("https://a.it/", words + "Market leader, cutting-edge and Read  More"), ("https://a.it/2", "follow us " * 10), ("https://b.it/", words * 3 + "follow us, follow us, learn more"), ("https://d.it/", "")]
    got = {r.owner: (r.pages, r.hits, r.saturated, r.severity, r.weight) for r in trust.filler(spark.createDataFrame(texts, "url string, text string")).collect()}
    assert got == {"a.it": (1, 3, 1, "warning", 1.5), "b.it": (1, 3, 0, "ok", 1.0)}


def test_acronyms_equal_a_search_for_each(spark):
    texts = {
        "https://a.it/1": "The WHO (World Health) and the NATO met; IVA: tax, XWHOX- and ABCDEFGH: long",
        "https://a.it/2": "FGH is a gas, GH too. NASA says CNS – and (UNO) ABC_D BÜRO",
        "https://b.it/": "QQ " * 3 + " ".join("R" + chr(65 + i // 26) + chr(65 + i % 26) for i in range(60)),
    }
    got = {}
    for r in trust.acronyms(spark.createDataFrame(list(texts.items()), "url string, text string")).collect():
        got.setdefault(r.owner, {})[r.acronym] = r.expanded
    for owner in ("a.it", "b.it"):
        text = " ".join(t for u, t in texts.items() if owner in u)
        want = {}
        for a in re.findall(r"\b[A-Z]{2,6}\b", text):
            if a not in trust.KNOWN_ACRONYMS:
                want[a] = bool(re.search(rf"{a}\s*[(—–:-]|[(—–:-]\s*{a}", text))
        assert got[owner] == dict(list(want.items())[:40])
    assert got["a.it"]["FGH"] and got["a.it"]["WHO"] and not got["a.it"]["NATO"]
    found = {r.owner: r.severity for r in trust.acronym_findings(trust.acronyms(spark.createDataFrame(list(texts.items()), "url string, text string"))).collect()}
    assert found == {"a.it": "ok", "b.it": "warning"}


def test_audit_roll_ups(spark):
    def audit(score, value=None, **more):
        return {"score": score, "title": "T", "description": "see [docs](https://x)", "displayValue": f"{value}", "numericValue": value, **more}

    def report(url, n, audited, perf, seo):
        refs = [{"id": "largest-contentful-paint", "weight": 25}, {"id": "note", "weight": 0}, {"id": "unknown", "weight": 1}]
        cats = {"performance": {"title": "Performance", "score": perf, "auditRefs": refs}, "seo": {"title": "SEO", "score": seo, "auditRefs": [{"id": "note", "weight": 1}, {"id": "fine", "weight": 1}]}}
        return (url, n, json.dumps({"audits": audited, "categories": cats}))

    lcp = "largest-contentful-paint"
    rows = [
        report("https://a.it/2", 2, {lcp: audit(0.4, 4500.0), "note": audit(0.95), "fine": audit(1)}, 0.5, 0.9),
        report("https://a.it/1", 1, {lcp: audit(0.8, 2600.0), "note": audit(0.7), "fine": audit(None)}, 0.6, 0.8),
        *[report(f"https://a.it/{i}", i, {lcp: audit(0.8, 4500.0, displayValue="late")}, None, None) for i in (3, 4, 5)],
        ("https://a.it/6", 6, "no report"),
        ("https://a.it/7", 7, None),
        report("https://b.it/", 1, {lcp: audit(0.99, 2500.0), "fine": audit(0.9)}, 0.985, 1),
    ]
    parsed = audits.reports(spark.createDataFrame(rows, "url string, n int, report string"))
    failed = {(r.owner, r.audit): r for r in audits.failed_audits(parsed).collect()}
    assert set(failed) == {("a.it", lcp), ("a.it", "note")}
    r = failed["a.it", lcp]
    assert (r.score, r.weight, r.severity, r.finding_weight, r.pages, r.urls, r.description) == (0.4, 25.0, "critical", 2.0, 5, [f"https://a.it/{i}" for i in (1, 2, 3)], "see docs")
    r = failed["a.it", "note"]
    assert (r.category, r.score, r.weight, r.severity, r.urls, r.key) == ("performance", 0.7, 1.0, "warning", ["https://a.it/1"], "lh.performance.note")
    cats = audits.category_scores(parsed)
    got = {(r.owner, r.category): (r.title, r.score, r.pages) for r in cats.collect()}
    assert got == {("a.it", "performance"): ("Performance", 55, 2), ("a.it", "seo"): ("SEO", 85, 2), ("b.it", "performance"): ("Performance", 98, 1), ("b.it", "seo"): ("SEO", 100, 1)}
    assert {r.owner: r.score for r in audits.area_score(cats).collect()} == {"a.it": 70.0, "b.it": 99.2}
    assert {(r.owner, r.key) for r in audits.clean_categories(cats, parsed).collect()} == {("b.it", "lh.performance.ok"), ("b.it", "lh.seo.ok")}
    vitals = {r.owner: (r.label, r.value, r.display, r.verdict) for r in audits.worst_vitals(parsed).collect()}
    assert vitals == {"a.it": ("LCP", 4500.0, "4500.0", "scarso"), "b.it": ("LCP", 2500.0, "2500.0", "buono")}
    before = cats.filter("owner = 'a.it' AND category = 'seo'").withColumn("score", F.lit(80))
    assert [(r.category, r.delta) for r in audits.category_changes(cats, before).collect()] == [("seo", 5.0)]
