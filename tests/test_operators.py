"""The reference's operators: values by hand, and loops beside the queries that SQL can't express."""

import json
import math
import re

import pytest
from corpuscle.functions import text as T
from corpuscle.operators import graph, pages, retrieval, scores
from corpuscle.sources import history
from corpuscle.streaming import history as stream
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_char_ngrams_of_characters_beyond_the_basic_plane(spark):
    text = "a😀b𠀀𠀁c\nd😀😀e"
    want = [" ".join(text.split())[i : i + 4] for i in range(len(text) - 3)]
    got = [r.gram for r in T.char_ngrams(spark.createDataFrame([(1, text), (2, "😀😀")], "k int, text string"), ["k"]).filter("k = 1").collect()]
    assert got == want


def test_text_functions(spark):
    assert one(spark, T.tokenize(F.lit("Il gatto NERO dorme"), ["il"])) == ["gatto", "nero", "dorme"]
    grams = T.char_ngrams(spark.createDataFrame([(1, "ab"), (2, "  "), (3, "Ab  cde"), (4, None)], "k int, text string"), ["k"])
    assert sorted((r.k, r.gram) for r in grams.collect()) == [(1, "ab"), (3, " cde"), (3, "ab c"), (3, "b cd")]
    for url, want in [("https://x.it/pagina/", "https://x.it/pagina"), ("https://x.it", "https://x.it/"), ("https://x.it/#f", "https://x.it/"), ("https://x.it/p/?a=1", "https://x.it/p?a=1")]:
        assert one(spark, T.norm_url(F.lit(url))) == want
    assert one(spark, T.host(F.lit("http://WWW.Example.com:80/x"))) == "example.com"
    assert one(spark, T.is_question(F.lit("¿Qué es?"))) and one(spark, T.is_question(F.lit("Istruzioni"))) and not one(spark, T.is_question(F.lit("Bene")))
    assert one(spark, T.effort(F.lit("Canonical assente"), F.lit(""))) == "minutes" and one(spark, T.effort(F.lit("poche pagine, title"), F.lit(""))) == "days"


def test_bm25_values(spark):
    docs = spark.createDataFrame([(0, "gatto dorme"), (1, "cane corre"), (2, "gatto salta")], "doc int, text string")
    idf = {r.term: r.idf for r in retrieval.term_statistics(docs).collect()}
    assert idf["cane"] == pytest.approx(math.log(1 + 2.5 / 1.5))
    queries = spark.createDataFrame([(7, "gatto gatto salta")], "query int, text string")
    got = {r.doc: r.score for r in retrieval.bm25(docs, queries).collect()}
    weight = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    assert got == {0: pytest.approx(2 * weight(2)), 2: pytest.approx(2 * weight(2) + weight(1))}
    own = retrieval.char_tfidf(docs, docs.select(F.col("doc").alias("query"), "text")).filter("query = doc").collect()
    assert len(own) == 3 and all(r.score == pytest.approx(1) for r in own)


def test_fusion_values(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "query int, doc int, rank int")
    a, b = ranks([(1, 0, 1), (1, 1, 2)]), ranks([(1, 2, 1), (1, 3, 2), (1, 1, 3)])
    got = retrieval.ranked(retrieval.fuse([(a, 1), (b, 1)]), 5).orderBy("rank").collect()
    assert got[0].doc == 1 and got[0].score == pytest.approx(1 / 62 + 1 / 63)
    weighted = {r.doc: r.score for r in retrieval.fuse([(ranks([(1, 0, 1), (1, 1, 2)]), 2), (ranks([(1, 1, 1), (1, 0, 2)]), 1)]).collect()}
    assert weighted[0] == pytest.approx(2 / 61 + 1 / 62) and weighted[0] > weighted[1]
    seen = retrieval.consensus(a, b, spark.createDataFrame([(1,), (2,)], "query int")).orderBy("query").collect()
    assert [(r.consensus, r.covered) for r in seen] == [(1, True), (0, False)]


def test_scores(spark):
    rows = [("s", "tech", "ok", 1.0, "a"), ("s", "tech", "critical", 2.0, "b"), ("s", "sem", "info", 5.0, "c")]
    found = spark.createDataFrame(rows, "owner string, area string, severity string, weight double, key string")
    areas = scores.area_scores(found)
    assert {r.area: r.score for r in areas.collect()} == {"tech": 33.3, "sem": None}
    mixed = spark.createDataFrame([("s", "tech", 100.0), ("s", "lex", 0.0), ("s", "sem", None)], "owner string, area string, score double")
    assert scores.overall_scores(mixed, {"tech": 1.0, "lex": 1.5, "sem": 1.5}).first().overall == 40.0
    assert [(r.key, r.priority) for r in scores.plan(found).collect()] == [("b", 1)]
    assert [(r.key, r.gain) for r in scores.gains(found).collect()] == [("b", 66.7)]
    runs = spark.createDataFrame([("x", 1.0, 1, 50.2), ("x", 2.0, 2, 60.6)], "site string, created_at double, run int, overall double")
    assert [r.change for r in scores.previous_run(runs).orderBy("run").collect()] == [None, 11.0]
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d")], "run int, key string")
    assert [tuple(r) for r in scores.findings_delta(runs, keys).collect()] == [(2, 2, 1)]


def test_graph(spark):
    links = spark.createDataFrame([("h", "a"), ("h", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a"), ("h", "?")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "habcdez"], "node string")
    assert {r.node: (r.links, r.sources) for r in graph.in_degree(links, nodes).collect()}["a"] == (2, 1)
    assert {r.node for r in graph.orphans(links, nodes, nodes.filter("node = 'h'")).collect()} == {"z"}
    found = graph.depths(links, nodes.filter("node = 'h'"))
    assert {r.bucket: r.nodes for r in graph.depth_histogram(found.filter("node <> '?'"), nodes).collect()} == {"0": 1, "1": 1, "2": 1, "3": 1, "4+": 2, "unreachable": 1}


def test_embedding_join_is_dealt_in_blocks(spark):
    vectors = {i: [math.sin((i + 1) * (j + 1)) for j in range(6)] for i in range(60)}
    docs = spark.createDataFrame(list(vectors.items()), "doc int, vector array<double>")
    queries = docs.filter("doc < 3").select(F.col("doc").alias("query"), "vector")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = retrieval.embedding_cosine(docs, queries, 16).select("*", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    assert {(r.query, r.doc): r.score for r in got} == {(a, b): pytest.approx(cosine(vectors[a], vectors[b])) for a in range(3) for b in range(60)}
    assert len({r.part for r in got}) > 1 and len(got) == 180


def test_long_chains_are_reachable(spark):
    chain = [f"n{i}" for i in range(12)]
    links = spark.createDataFrame([*zip(chain, chain[1:]), ("n11", "n0"), ("y", "z")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in [*chain, "y", "z"]], "node string")
    found = graph.depths(links, nodes.filter("node = 'n0'"))
    assert {r.node: r.depth for r in found.collect()} == {x: i for i, x in enumerate(chain)}
    assert {r.bucket: r.nodes for r in graph.depth_histogram(found, nodes).collect()} == {"0": 1, "1": 1, "2": 1, "3": 1, "4+": 8, "unreachable": 2}


def loop_passages(text, target=220, least=15):
    out, buf, words, k = [], [], 0, 0
    for line in re.split(r"\n+", text or ""):
        line = line.strip(" ")
        if not line:
            continue
        buf.append(line)
        words += len(re.findall(T.TOKEN, line))
        if words >= target:
            out.append((k, " ".join(buf), words))
            buf, words, k = [], 0, k + 1
    if buf:
        out.append((k, " ".join(buf), words))
    return [x for x in out if x[2] >= least]


def test_passages_equal_a_loop(spark):
    texts = [None, "", "short", "\n\n".join(f"line {i} " + "word " * (i % 70) for i in range(60)), "a b\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted((r.k, r["index"], r.text, r.words) for r in pages.passages(docs, ["k"]).collect())
    assert got == [(k, *p) for k, t in enumerate(texts) for p in loop_passages(t)]


def test_pages(spark):
    html = '<html lang="it"><head><title> A  b </title><meta charset="utf-8"><script>var t="</p>";</script></head><body><nav><a href="/x">Click here</a></nav><h1>One <b>two</b></h1><p>Text</p></body></html>'
    raw = spark.createDataFrame([(1, "https://www.x.it/p/", html), (2, "https://x.it/p", html), (3, "http://x.it/", None)], "page_id int, url string, html string")
    parsed = pages.parse_pages(raw)
    p = parsed.filter("page_id = 1").first()
    assert (p.title, p.lang, p.h1, p.anchors, p.host, p.slug, p.has_charset, p.text, p.words) == ("A b", "it", ["One two"], ["click here"], "x.it", "p", True, "Click here One two Text", 5)
    assert sorted(r.page_id for r in pages.dedupe_pages(parsed).collect()) == [2, 3]
    found = {r.key: r for r in pages.findings(parsed).collect()}
    assert found["lex.title.missing"].pages == 1 and found["tech.https.missing"].example == "http://x.it/" and found["tech.links.generic_anchors"].severity == "info"
    hosts = spark.createDataFrame([("a.x.it",), ("x.it",), ("notx.it",)], "host string")
    assert [tuple(r) for r in scores.cited_hosts(hosts, spark.createDataFrame([("x.it",)], "target string")).collect()] == [("x.it", 2)]


def test_history_and_streams(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" one \n\ntwo\n")
    assert [r.query for r in history.query_list(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]
    (tmp_path / "g.csv").write_text("Top queries,Clicks,Impressions\na,1.0,5\nB,20,7\nb,3,9\nc,20,8\n")
    assert [(r.query, r.clicks) for r in history.search_console(spark, str(tmp_path / "g.csv")).collect()] == [("c", 20), ("B", 20), ("a", 10)]
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"site": "x", "created_at": 1.0, "overall": 50.0}, {"site": "x", "created_at": 7200.0, "overall": 30.0}, {"site": "y", "created_at": 5.0, "overall": 80.0}]
    (log / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    runs = history.history(spark, str(log))
    assert {r.site: r.overall for r in history.latest_by_site(runs).collect()} == {"x": 30.0, "y": 80.0}
    live = stream.stream_history(spark, str(log))
    query = stream.latest_scores(live).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.site: r.overall for r in spark.table("latest").collect()} == {"x": 30.0, "y": 80.0}
    bad = []
    stream.watch_regressions(live, 40, lambda df, n: bad.extend(r.site for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert bad == ["x"]
