"""Topics, languages and questions of sites against loops and values worked out by hand."""

import random
import re
from collections import Counter

from corpuscle.functions.text import TOKEN
from corpuscle.operators import questions, retrieval
from pyspark.sql import functions as F

KIND = "host string, url string, lang string, title string, headings array<struct<level:int,text:string>>, text string"


def by_hand(rows, banned, most):
    """Topics of each host by a loop over its pages."""
    out = {}
    for host in {r[0] for r in rows}:
        mine, found = [r for r in rows if r[0] == host], Counter()
        terms = lambda s, least: [t.lower() for t in re.findall(TOKEN, s or "") if len(t) > least and t.lower() not in banned]
        for r in mine:
            for s in [h["text"] for h in r[4] or []] + [(r[3] or "").split("|")[0]]:
                t = terms(s, 3)
                for a, b in zip(t, t[1:]):
                    found[f"{a} {b}"] += 3
                if len(t) == 1:
                    found[t[0]] += 1
        if not found:
            for r in mine:
                found.update(terms(r[5], 4))
        out[host] = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
    return {h: t for h, t in out.items() if t}


def test_topics_fall_back_to_texts_by_host(spark):
    rng = random.Random(4)
    words = ["what", "water", "deep", "diving", "sea", "of", "salty", "coral", "it", "fishes"]
    some = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(most)))
    rows = []
    for i in range(80):
        named = i % 4 < 2
        heads = [{"level": 2, "text": some(5)} for _ in range(rng.randrange(3))] if named else [{"level": 1, "text": "what is it"}]
        rows.append((f"h{i % 8}", f"u{i}", "en", f"{some(4)} | water deep" if named else None, heads, some(12)))
    rows += [(None, "n", None, None, None, "corals corals water"), ("bare", "b", "", "", [], None), ("h0", "n2", None, None, None, None)]
    got = {}
    for r in questions.site_topics(spark.createDataFrame(rows, KIND), ["what"], 5).orderBy("rank").collect():
        got.setdefault(r.owner, []).append((r.topic, r.weight))
    assert got == by_hand(rows, ["what"], 5) and got[None] == [("corals", 2), ("water", 1)] and "bare" not in got
    assert questions.site_topics(spark.createDataFrame([], KIND)).count() == 0


def test_languages_and_questions(spark):
    tags = [("a", "en-GB"), ("a", "EN"), ("a", "de"), ("b", "pt"), ("b", "pt-BR"), ("b", "fr"), ("c", ""), ("c", None), ("d", "fr"), ("d", "de "), ("e", ""), ("e", "es")]
    heads = spark.createDataFrame([(h, f"u{i}", lang) for i, (h, lang) in enumerate(tags)], "host string, url string, lang string")
    langs = questions.site_languages(heads)
    assert {r.owner: r.lang for r in langs.collect()} == {"a": "en", "b": "it", "c": "it", "d": "fr", "e": "es"}
    topics = spark.createDataFrame([("a", f"t{k}", k) for k in range(1, 6)] + [("d", "x {}", 1)], "owner string, topic string, rank int")
    got = {}
    for r in questions.site_questions(topics, langs).orderBy("n").collect():
        got.setdefault(r.owner, []).append((r.n, r["query"]))
    assert got["d"] == [(1, "qu'est-ce que x {}"), (2, "comment fonctionne x {}"), (3, "combien coûte x {}")]
    assert [n for n, _ in got["a"]] == list(range(1, 13)) and got["a"][4] == (5, "how does t2 work") and len(got) == 2


def test_term_statistics_count_in_rows(spark):
    texts = [None, "", "b a b", "a", "c a c c", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {r.term: (r.df, r.tf) for r in retrieval.term_statistics(docs).collect()}
    assert got == {"a": (4, 4), "b": (1, 2), "c": (1, 3)}


def test_hot_grams_are_weighed_like_others(spark):
    grams = spark.createDataFrame([(d, g, 1) for d in range(5) for g in ("hot ", f"g{d % 2}")], "doc long, gram string, tf long")
    idf = spark.createDataFrame([("hot ", True, 1.0), ("g0", False, 2.0), ("g1", False, 3.0)], "gram string, hot boolean, idf double")
    want = sorted((d, g, w) for d in range(5) for g, w in (("hot ", 1.0), (f"g{d % 2}", 2.0 + d % 2)))
    assert sorted((r.doc, r.gram, r.idf) for r in retrieval.weighed(grams, idf).collect()) == want
    most, retrieval.HOT_GRAMS = retrieval.HOT_GRAMS, 0
    try:
        assert sorted((r.doc, r.gram, r.idf) for r in retrieval.weighed(grams, idf).collect()) == want
    finally:
        retrieval.HOT_GRAMS = most
