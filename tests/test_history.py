"""Run logs, comparisons, reports and plans on small tables."""

import json
import re

from corpuscle.functions.text import TOKEN
from corpuscle.operators import history, scores
from corpuscle.plans import queries
from corpuscle.sources import history as sources
from corpuscle.streaming import history as streams
from pyspark.sql import functions as F


def test_pages_of_a_log(spark):
    rows = [(i, f"s{i % 3}", float(i // 50)) for i in range(500)]
    runs = spark.createDataFrame(rows, "run int, site string, created_at double")
    want = sorted(rows, key=lambda r: (-r[2], -r[0]))
    got = history.history_page(runs, 20, 95).orderBy("n").collect()
    assert [(r.n, r.run) for r in got] == [(i + 1, want[i][0]) for i in range(95, 115)]
    assert history.history_page(runs, 20, 495).count() == 5 and history.history_page(runs.limit(0), 20).count() == 0


def test_comparing_two_runs(spark):
    runs = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "run int, site string, created_at double")
    pairs = history.comparable(spark.createDataFrame([(2, 1), (1, 1), (1, 3), (2, 9)], "a int, b int"), runs)
    assert [tuple(r) for r in pairs.collect()] == [("a", 1, 2)]
    areas = spark.createDataFrame([(1, "x", 50.0), (2, "x", 50.25), (1, "y", None), (2, "y", 1.0), (2, "z", 2.0)], "run int, area string, score double")
    assert [tuple(r) for r in history.score_changes(pairs, areas).collect()] == [(1, 2, "x", 0.2)]
    found = [(1, 1, "x", "warning", "3 bad"), (2, 1, "x", "critical", "2 bad"), (1, 2, "x", "warning", "gone"), (2, 2, "x", "ok", "gone"), (2, 5, "y", "warning", "9 new"), (2, 3, "y", "warning", "8 new"), (3, 1, "y", "warning", "other")]
    got = history.finding_changes(pairs, spark.createDataFrame(found, "run int, n int, area string, severity string, title string"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, "resolved", "x", "gone"), (1, 2, "new", "y", "8 new")}


def test_reports_are_written_and_read_back(spark, tmp_path):
    overall = spark.createDataFrame([("a", 70.5), ("b", None)], "owner string, overall double")
    areas = spark.createDataFrame([("a", "x", 1.5), ("a", "y", None)], "owner string, area string, score double")
    found = spark.createDataFrame([("a", i, f"k{i}", "x", "ok", 1.0, "t") for i in (2, 1, 3)], "owner string, n int, key string, area string, severity string, weight double, title string")
    pages = spark.createDataFrame([("a", "u2", "t", 3), ("a", "u1", None, 4)], "owner string, url string, title string, words int")
    asked = spark.createDataFrame([("a", i, q, 2) for i, q in enumerate(["q0", "", "q2", None, "q4"])], "owner string, n int, query string, consensus int")
    reports = history.site_reports(overall, areas, found, pages, asked)
    got = {r.owner: json.loads(r.report) for r in reports.collect()}
    assert [f["key"] for f in got["a"]["findings"]] == ["k1", "k2", "k3"] and [p["url"] for p in got["a"]["pages"]] == ["u1", "u2"] and got["a"]["scores"] == {"x": 1.5}
    assert got["b"] == {"schema_version": 1, "site": "b"}
    path = history.write_reports(reports, str(tmp_path))
    assert [(r.site, r.n, r.query) for r in history.report_queries(spark, path, 2).orderBy("n").collect()] == [("a", 1, "q0"), ("a", 2, "q2")]
    (tmp_path / "one.json").write_text(json.dumps(got["a"], indent=2))
    assert [r.query for r in history.report_queries(spark, str(tmp_path / "one.json")).orderBy("n").collect()] == ["q0", "q2", "q4"]


def test_plan_by_gains(spark):
    found = [("a", 1, "k1", "lex", "warning", 1.0), ("a", 2, "k2", "lex", "ok", 3.0), ("a", 3, "k3", "tech", "critical", 2.0), ("a", 4, "k4", "tech", "warning", 2.0), ("a", 5, "k5", "sem", "info", 9.0), ("a", 6, "k6", "tech", "critical", 1.0)]
    findings = spark.createDataFrame(found, "owner string, n int, key string, area string, severity string, weight double")
    areas = scores.area_scores(findings).unionByName(scores.depth_scores(spark.createDataFrame([("a", 450), ("a", 451)], "owner string, words int")))
    assert {r.area: r.score for r in areas.collect()} == {"lex": 87.5, "tech": 20.0, "sem": None, "depth": 50.0}
    got = scores.gain_plan(findings, areas, {"p": {"lex": 0.5, "sem": 0.5}, "q": {"tech": 0.3, "depth": 0.3}, "r": {"sem": 1.0}}, {"p": 0.25, "q": 0.75, "r": 1.0}).orderBy("priority").collect()
    assert [(r.key, r.gains, r.best_profile, r.best_gain, r.index_gain, r.profiles_hit, r["cross"]) for r in got] == [
        ("k3", {"p": 0.0, "q": 20.0}, "q", 20.0, 15.0, ["q"], False), ("k6", {"p": 0.0, "q": 10.0}, "q", 10.0, 7.5, ["q"], False),
        ("k4", {"p": 0.0, "q": 10.0}, "q", 10.0, 7.5, ["q"], False), ("k1", {"p": 12.5, "q": 0.0}, "p", 12.5, 3.1, ["p"], False),
    ]


def test_logs_and_files(spark, tmp_path):
    log = str(tmp_path / "log")
    run = lambda at, site, overall: json.dumps({"generated_at": "g", "created_at": at, "site": site, "overall": overall, "scores": {"x": 1.0}, "findings": []})
    runs = spark.read.schema(sources.HISTORY).json(spark.sparkContext.parallelize([run(0, "a", 5.0), run(1800, "a", 6.0)]))
    sources.append_history(runs, log)
    sources.append_history(runs.limit(1).withColumn("created_at", F.lit(3700.0)), log)
    assert sorted(r.created_at for r in sources.history(spark, log).collect()) == [0, 1800, 3700]
    hours = streams.hourly_runs(streams.stream_history(spark, log)).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    hours.awaitTermination()
    assert {(r.site, str(r.hour), r.runs) for r in spark.table("hours").collect()} == {("a", "1970-01-01 00:00:00", 2), ("a", "1970-01-01 01:00:00", 1)}
    sources.findings_csv(spark.createDataFrame([("a;b", 'x "y"', None)], "area string, title string, url string"), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines()[0] == "area;title;url" and '"a;b"' in text
    (tmp_path / "events.jsonl").write_text("\n".join(json.dumps(x) for x in [{"date": "2024-02-01T10:00", "label": "late"}, {"date": "2024-01-01", "label": "early", "site": "a"}, {"date": "2024-01-01", "label": "other", "site": "b"}, {"date": "", "label": "x"}, {"label": "y"}]) + "\n{broken")
    assert [(r.date, r.label) for r in sources.event_pins(spark, str(tmp_path / "events.jsonl"), "a").collect()] == [("2024-01-01", "early"), ("2024-02-01", "late")]


def test_surface_of_the_documents(spark):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        passages, words = 0, 0
        for line in (r.text or "").split("\n"):
            words += len(re.findall(TOKEN, line))
            if words >= 220:
                passages, words = passages + 1, 0
        passages += words >= 15
        if passages:
            now, potential = want.get(r.source, (0, 0))
            want[r.source] = now + passages, potential + max(passages, 4) + 1
    assert {r.source: (r.now, r.potential) for r in queries.surface_math(spark, folder).collect()} == want
