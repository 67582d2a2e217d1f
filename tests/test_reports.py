"""Evidence, texts, judges, places, citation runs and slots against plain loops and values worked out by hand."""

import json
import re

import pytest
from corpuscle.operators import catalogue, checks, citations, evidence
from corpuscle.streaming import slots
from pyspark.sql import functions as F

FINDING = "owner string, n long, key string, severity string, title string, detail string"


def test_findings_merge_as_in_a_loop(spark):
    own = [
        ("a", 0, "lex.title.ok", "ok", "t", "fine"), ("a", 1, "lex.title.bad", "critical", "t", "two bad"), ("a", 2, "lex.title.dup", "warning", "t", None),
        ("a", 3, "tech.lang.missing", "warning", "l", ""), ("a", 4, "lh.seo.lex.desc.", "warning", "x", ""), ("b", 0, "tech.lang.missing", "ok", "l", "d"), ("b", 1, "tech.meta.viewport", "warning", "v", "d"),
    ]
    other = [
        ("a", 0, "lh.seo.document-title", "warning", "Lighthouse: Titles", "x", "document-title", 0.285), ("a", 1, "lh.seo.html-has-lang", "warning", "Lang", "x", "html-has-lang", 0.0), ("a", 2, "lh.seo.html-lang-valid", "warning", "Lighthouse: Valid", "x", "html-lang-valid", 0.5),
        ("a", 3, "lh.seo.meta-description", "warning", "Desc", "kept", "meta-description", 0.1), ("a", 4, "lh.a11y.contrast", "info", "Contrast", "kept", "color-contrast", 0.3), ("b", 0, "lh.seo.html-has-lang", "warning", "Lang", "kept", "html-has-lang", None), ("c", 0, "lh.x", "info", "X", None, "viewport", 0.2),
    ]
    want = {}
    for o in "abc":
        rows = [[k, s, t, d or "", None] for x, _, k, s, t, d in own if x == o]
        mine = len(rows)
        for x, _, k, s, t, d, audit, score in other:
            if x == o:
                prefix = evidence.SAME.get(audit)
                target = next((r for r in rows[:mine] if prefix and r[0].startswith(prefix) and r[1] != "ok" and not r[0].startswith("lh.")), None)
                if target is None:
                    rows.append([k, s, t, d or "", None])
                else:
                    note = f"Conferma Lighthouse: {t.removeprefix('Lighthouse: ')} (punteggio {round((score or 0) * 100)}/100)."
                    target[3], target[4] = f"{target[3]} {note}".strip(), audit
        want |= {(o, i + 1): tuple(r) for i, r in enumerate(rows)}
    got = evidence.merge_findings(spark.createDataFrame(own, FINDING), spark.createDataFrame(other, FINDING + ", audit string, score double")).collect()
    assert {(r.owner, r.place): (r.key, r.severity, r.title, r.detail, r.confirmed) for r in got} == want
    none = spark.createDataFrame([], FINDING + ", audit string, score double")
    assert evidence.merge_findings(spark.createDataFrame(own, FINDING), none).count() == len(own)


def test_item_labels_and_messages(spark):
    details = [
        {"items": [{"node": {"selector": "h1.x", "snippet": "<h1>"}}, {"node": {"selector": ""}, "url": 7, "source": "s.js"}, 3, {"url": "never"}]},
        {"items": [{"node": {"snippet": "<img>"}, "url": "u"}, {"text": "x" * 200}, {"origin": "o", "label": ""}]},
        {"items": [{}]}, {"items": "no list"}, {},
    ]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(details)] + [(9, None), (10, "{broken")], "i int, d string")
    got = {r.i: r.l for r in rows.select("i", evidence.item_labels(F.col("d")).alias("l")).collect()}
    assert got == {0: ["h1.x", "s.js"], 1: ["<img>", "x" * 120, "o"], 2: [], 3: [], 4: [], 9: [], 10: []}
    report = {"i18n": {"icuMessagePaths": {"m1": ["audits[a].title", {"path": "audits[b].title", "values": {"n": 1}}], "m2": [{"path": "audits[a].title"}, {"values": {}}], "m3": ["audits[c].title"]}}}
    paths = evidence.message_paths(spark.createDataFrame([("u", json.dumps(report)), ("v", "{}"), ("w", None)], "url string, report string"))
    texts = spark.createDataFrame([("m1", "One {n}"), ("m2", "Two"), ("m3", "")], "message string, text string")
    assert {(r.url, r.path, r.message, r.text) for r in evidence.message_texts(paths, texts).collect()} == {("u", "audits[a].title", "m2", "Two"), ("u", "audits[b].title", "m1", None), ("u", "audits[c].title", "m3", None)}


def test_pages_by_the_gravest_finding(spark):
    pages = spark.createDataFrame([("a", "a2", True), ("b", None, True), ("c", "c", True), ("d", "", False), ("e", "b", True)], "url string, final_url string, ok boolean")
    found = spark.createDataFrame([("a2", "warning"), ("a", "critical"), ("b", "info"), ("b", "warning"), ("", "critical"), ("d", "critical"), (None, "critical")], "url string, severity string")
    got = evidence.page_severities(pages, found)
    assert {r.url: r.severity for r in got.collect()} == {"a": "critical", "b": "warning", "c": "ok", "e": "warning"}
    assert [tuple(r) for r in evidence.status_counts(pages, got, F.lit("x")).collect()] == [("x", 1, 3, 1)]


@pytest.mark.parametrize("template,params", [
    ("%(n)d pages of %(m)s, 100%% sure", {"n": "3.9", "m": "x%s"}), ("%(a)s", {}), ("50% off", {"a": "1"}), ("%(n)d", {"n": "three"}), ("%(x).1f/%(y)f", {"x": "2.25", "y": "-0.5"}),
    ("plain", {}), ("", {}), ("%(n)d", {"n": "-3.9"}), ("%(a).2s!", {"a": "abc"}), ("%(x).2f", {"x": "1e3"}), ("line\n%(a)s%%", {"a": "b"}),
])
def test_templates_fill_as_the_language_does(spark, template, params):
    def typed(v):
        try:
            return float(v)
        except ValueError:
            return v

    numbers = {k: typed(v) if re.search(rf"%\({k}\)(\.\d)?[df]", template) else v for k, v in params.items()}
    try:
        want = template % numbers
    except (KeyError, TypeError, ValueError):
        want = None
    got = spark.createDataFrame([(template, params)], "t string, p map<string,string>").select(catalogue.filled(F.col("t"), F.col("p"))).first()[0]
    assert got == want


def test_texts_fall_back_field_by_field(spark):
    found = spark.createDataFrame([("k", {"n": "2"}, "T", "D", "F", "E", 1), ("other", None, "T", "D", None, "E", 2), (None, {}, "T", "D", "F", "E", 3)], "key string, params map<string,string>, title string, detail string, fix string, example string, i int")
    table = spark.createDataFrame([("en", "k", "title", "%(n)d things"), ("en", "k", "detail", "%(gone)s"), ("de", "k", "fix", "x"), ("en", "k", "other", "y")], "lang string, key string, field string, template string")
    got = {r.i: (r.title, r.detail, r.fix, r.example) for r in catalogue.finding_texts(found, table, "en").collect()}
    assert got == {1: ("2 things", "D", "F", "E"), 2: ("T", "D", "", "E"), 3: ("T", "D", "F", "E")}


def test_judges(spark):
    chunks = spark.createDataFrame([(1, "l1", "h", "old"), (2, "l1", "h2", "new"), (3, "l2", "g", "t")], "n long, label string, heading string, text string")
    fused = spark.createDataFrame([(1, "q1", 1, "l1"), (1, "q1", 2, "l2"), (2, "q2", 1, "gone"), (3, "q3", 1, "l1"), (4, "q4", 1, "l2")], "query_n long, query string, rank int, label string")
    sample = checks.judge_sample(fused, chunks)
    assert [tuple(r) for r in sample.orderBy("id").collect()] == [(1, "q1", "l1", "h2", "new"), (2, "q4", "l2", "g", "t")]
    assert checks.judge_sample(fused, chunks, 1).count() == 1
    answers = {
        "good": 'Sure: [{"id": 1, "score": 150.0, "reason": " r "}, {"id": "2", "score": "61.25"}, {"id": 7, "score": "x"}] done',
        "none": "no array", "open": '[{"id": 1', "far": '[{"id": 9, "score": 3}]', "bad": '[{"id": 1, "score": "high"}]', "noid": '[{"score": 1}]', "mixed": '[1, {"id": 1, "score": 2}]',
        "cut": '[{"id": 1.9, "score": -3}]', "empty": "[]", "null": None,
    }
    outcome, verdicts = checks.judge_verdicts(spark.createDataFrame(list(answers.items()), "model string, text string"), sample)
    got = {r.model: (r.status, r.sampled, r.average) for r in outcome.collect()}
    assert got == {k: ("error", 0, None) for k in answers} | {"good": ("ok", 2, 80.6), "cut": ("ok", 1, 0.0)}
    assert {(r.model, r.id, r.query, r.label, r.score, r.reason) for r in verdicts.collect()} == {("good", 1, "q1", "l1", 100.0, "r"), ("good", 2, "q4", "l2", 61.2, ""), ("cut", 1, "q1", "l1", 0.0, "")}


def test_places_in_results(spark):
    results = spark.createDataFrame([("q", ["https://www.A.it/x", None, "http://b.it/", "https://a.it/y"]), ("r", ["x", "http://a.it:8080/"]), ("s", [])], "query string, urls array<string>")
    got = checks.site_positions(results, spark.createDataFrame([("a.it",), ("b.it",)], "site string"))
    assert {(r.site, r.query): (r.position, r.url) for r in got.collect()} == {
        ("a.it", "q"): (1, "https://www.A.it/x"), ("b.it", "q"): (3, "http://b.it/"), ("a.it", "r"): (None, None), ("b.it", "r"): (None, None), ("a.it", "s"): (None, None), ("b.it", "s"): (None, None),
    }


def test_citation_runs(spark, tmp_path):
    lines = []
    for i in range(60):
        lines.append(json.dumps({"generated_at": str(i), "site": "a.it", "providers": {"p": {"answered": i % 4, "site_cited": min(1, i % 4)}, **({"q": {"answered": 2, "site_cited": 1}} if i % 2 else {})}}))
    lines[3:3] = ["{broken", "[]", json.dumps({"site": "", "providers": {}}), json.dumps({"site": "b.it"}), json.dumps({"site": "b.it", "providers": {"p": {"answered": 0, "site_cited": 0}}})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    runs = citations.read_runs(spark, str(tmp_path / "log.jsonl"))
    got = citations.provider_series(runs).collect()
    a = sorted((r for r in got if r.site == "a.it" and r.provider == "p"), key=lambda r: r.n)
    assert len(a) == 50 and {r.site_n < s.site_n for r in a for s in got if s.site == "b.it"} == {True}
    rates = [0.0 if i % 4 == 0 else round(100 / (i % 4), 1) for i in range(10, 60)]
    assert [r.rate for r in a] == rates and [r.before for r in a] == [None, *rates[:-1]]
    assert a[1].change == round(rates[1] - rates[0], 1)
    pooled = sorted((r for r in got if r.site == "a.it" and r.provider is None), key=lambda r: r.n)
    counts = [(i % 4 + 2 * (i % 2), min(1, i % 4) + i % 2) for i in range(10, 60)]
    assert [r.rate for r in pooled] == [None if not n else round(100 * c / n, 1) for n, c in counts]
    assert [(r.provider, r.rate) for r in got if r.site == "b.it"] in ([("p", 0.0), (None, None)], [(None, None), ("p", 0.0)])
    answers = spark.createDataFrame([("p", 1, True, ["x.c.it", "c.it"]), ("p", 2, True, ["d.it"]), ("p", 3, False, ["c.it"]), ("q", 4, True, None)], "provider string, n int, ok boolean, hosts array<string>")
    counts = citations.competitor_counts(answers, spark.createDataFrame([("c.it",), ("e.it",)], "host string"))
    assert {tuple(r) for r in counts.collect()} == {("p", "c.it", 1), ("p", "e.it", 0), ("q", "c.it", 0), ("q", "e.it", 0)}


def test_a_slot_is_held_for_an_hour(spark, tmp_path):
    spark.conf.set(*slots.STORE)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    events = spark.readStream.schema("user string, at timestamp, kind string").json(str(source))

    def feed(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("user", "at", "kind"), r))) for r in rows))
        query = slots.hourly_slots(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        return query.lastProgress

    feed("1.json", [("u", "2024-01-01 10:00:00", "start"), ("u", "2024-01-01 10:30:00", "start"), ("v", "2024-01-01 10:10:00", "start")])
    feed("2.json", [("u", "2024-01-01 10:59:59", "start"), ("u", "2024-01-01 11:00:00", "start"), ("v", "2024-01-01 10:20:30", "clear"), ("v", "2024-01-01 10:21:00", "start")])
    last = feed("3.json", [("w", "2024-01-01 15:00:00", "start")])
    got = spark.read.parquet(str(out)).select("user", F.date_format("at", "HH:mm:ss").alias("t"), "accepted", "wait_s").collect()
    assert {tuple(r) for r in got} == {
        ("u", "10:00:00", True, 0), ("u", "10:30:00", False, 1800), ("v", "10:10:00", True, 0), ("u", "10:59:59", False, 1), ("u", "11:00:00", True, 0), ("v", "10:21:00", True, 0), ("w", "15:00:00", True, 0),
    }
    # Only w still holds a slot.
    assert last["stateOperators"][0]["numRowsTotal"] <= 2
