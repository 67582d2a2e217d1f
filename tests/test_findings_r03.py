"""Cases of the third round's findings."""

import re

from pyspark.sql import functions as F

from corpuscle import session
from corpuscle.functions import text as T
from corpuscle.operators import graph, nearest, retrieval, scores, site
from corpuscle.plans import queries as own
from corpuscle.plans import report_queries, site_queries


def test_only_pages_that_answered_give_findings(spark, tmp_path):
    """Of pages with one url the one that didn't answer (ids divisible by 11) marks no other."""
    rows = [(66, "http://a.example/x", ""), (3, "http://a.example/x", ""), (55, "http://a.example/y", ""), (1, "http://a.example/y", ""), (5, "http://a.example/z", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in report_queries.page_severities(spark, str(tmp_path)).collect()}
    assert got == {("http://a.example/x", "ok"), ("http://a.example/y", "ok"), ("http://a.example/z", "warning")}
    assert [tuple(r) for r in report_queries.page_status_counts(spark, str(tmp_path)).collect()] == [("a.example", 2, 1, 2)]


def best(scores, most, digits):
    by = {}
    for query, doc, score in scores.collect():
        by.setdefault(query, []).append((-round(score, digits) if score is not None else 9.0, doc))
    return {q: sorted(rows)[:most] for q, rows in by.items()}


def test_best_by_grams_are_those_of_all_scores(spark, monkeypatch):
    """Copies, short and empty texts, characters beyond 16 bits, an id that repeats; with few known n-grams bounds decide."""
    texts = ["abc", "", "the cat sat on the mat", "the cat sat", "the cat sat", "\U0001f600\U0001f600 the cat \U0001f600\U0001f600", "A  Dog\tsat", None, "ABC"] + [f"word{i % 7} and the cat number {i * i} sat {'on ' * (i % 5)}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "on a mat again")], "doc long, text string")
    queries = spark.createDataFrame([(1, "the cat sat on 16 mats"), (2, "abc"), (3, "\U0001f600\U0001f600 the"), (4, ""), (5, "zzzzzz")], "query long, text string")
    want = best(retrieval.char_tfidf(docs, queries), 4, 9)
    for hot in (500_000, 3, 0):
        monkeypatch.setattr(nearest, "HOT_GRAMS", hot)
        monkeypatch.setattr(nearest, "PASS_WEIGHTS", 10 if hot == 3 else 2_000_000)
        assert best(nearest.top_gram_cosine(docs, queries, 4), 4, 9) == want
    assert set(want) == {1, 2, 3}


def test_best_by_vectors_are_those_of_all_scores(spark, monkeypatch):
    """Blocks of a few vectors, copies of one vector, two lengths."""
    monkeypatch.setattr(nearest, "VECTORS", 7)
    rows = [(i, [float((i * 7) % 11 - 5), float(i % 5) + 0.5, 1.0]) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(200, [1.0, 0.5]), (201, [2.0, 1.0])]
    docs = spark.createDataFrame(rows, "doc long, vector array<float>")
    queries = docs.filter("doc % 20 = 0").withColumnRenamed("doc", "query")
    got = nearest.top_embedding_cosine(docs, queries, 5)
    assert best(got, 5, 6) == best(retrieval.embedding_cosine(docs, queries), 5, 6)
    # The product of blocks never hands on all pairs, as the plain join does.
    assert got.count() < retrieval.embedding_cosine(docs, queries).count() / 2


def filtered(df):
    """The filters of a plan."""
    return " ".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_blocks_and_links_are_not_read_in_filters(spark):
    """Neither tokens nor links are worked out again in filters that Spark draws from their explosion and joins."""
    folder = "/root/testdata/sf0.001"
    pages = site_queries.customer_pages(spark, folder)
    for df in (site_queries.part_lists(spark, folder), site_queries.page_blocks(spark, folder), site.page_links(pages), site.anchor_pairs(pages)):
        assert "regexp_extract_all" not in filtered(df)


def test_shares_of_tasks_do_not_grow(spark, monkeypatch):
    """More rows than the session's partitions hold are dealt to more tasks; two sites, a run without findings, one key twice, a null date."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    runs = spark.createDataFrame([(i % 2, i // 2 if i else None, i) for i in range(60)], "site long, created_at long, run long")
    rows = [(i, f"k{(i // 2 + j) % 7}") for i in range(60) if i != 8 for j in (0, 1, 1)]
    has = {i: {k for r, k in rows if r == i} for i in range(60)}
    got = scores.findings_delta(runs, spark.createDataFrame(rows, "run long, key string"))
    assert got.rdd.getNumPartitions() == 42
    assert {tuple(r) for r in got.collect()} == {(i, len(has[i] - has[i - 2]), len(has[i - 2] - has[i])) for i in range(2, 60)}


def test_pages_of_types_are_dealt_by_url(spark, monkeypatch):
    """One url twice, an object with a type twice, no url; as many tasks as the rows ask for."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    html = '<script type="application/ld+json">[{"@type": ["A", "A", "Product"], "name": "%s"}, {"@type": "Product"}]</script>'
    nodes = site.jsonld_nodes(spark.createDataFrame([("http://a.example/1", html % "x"), ("http://a.example/1", html % ""), ("http://a.example/2", html % ""), (None, html % "x")], "url string, html string"))
    types = site.jsonld_types(nodes, rows=90)
    assert "hashpartitioning(url" in (plan := types._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in types.collect()} == {("a.example", "A", 2), ("a.example", "Product", 2), (None, "A", 0), (None, "Product", 0)}
    missing = {r.owner: (r.checked, r.pages) for r in site.jsonld_missing(nodes, 90).collect()}
    assert missing == {"a.example": (6, 2), None: (2, 0)}


def test_links_to_one_node_are_one_row(spark, monkeypatch):
    """Orphans: lines are dealt to as many tasks as they ask for, and links are made distinct before they meet the nodes."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    found = own.link_orphans(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 1\d\), REPARTITION_BY_NUM", plan) and "HashAggregate(keys=[node" in plan
    links, nodes = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d"), (None, "c")], "src string, dst string"), spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert {r.node for r in graph.orphans(links, nodes).collect()} == set("acd")


def test_signals_are_those_of_plain_patterns(spark):
    """Signals that look at no more of a text than they must equal the patterns as they stand, on odd openings, letters that fold, empty texts."""
    parts = ["", " ", "¿¡ ", "Is a", "ıs a", "İs a", "ſi tratta di", "xis a", "è un", "È\tUN", "eè un", "désigne", "DÉSIGNE", "it", "It's", "its", "lo \n stesso", "Ce dernier", "Wie geht", "what?", "? ", "don't ’x -y 9-a", "\U0001f600is a", "K means", "\n"]
    rows = spark.createDataFrame([(a + s + b,) for a in parts for b in parts for s in ("", " ")] + [(None,)], "text string")
    t = T.text_of("text")
    bare = F.regexp_replace(F.lower(F.trim(t)), r"^[¿¡ ]+", "")
    asks = bare.endswith("?") | F.exists(F.array(*map(F.lit, T.QUESTION_STARTERS)), lambda s: bare.startswith(s))
    pairs = [(T.defines(t), T.matches(t, T.DEFINITION)), (T.refers_back(t), T.matches(t, T.ANAPHORA)), (T.is_question(t), asks), (T.word_count(t), F.regexp_count(t, F.lit(T.TOKEN)))]
    for new, plain in pairs:
        assert rows.filter(new != plain).limit(5).collect() == [] and rows.filter(new.isNull()).isEmpty()
    plan = own.text_signals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # no value of its own for each word


def test_places_are_ranked_once(spark):
    """The lists' places, read by several branches of the plan, are not worked out again in each."""
    plan = site_queries.share_map(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Window" not in plan
