"""Hybrid retrieval for many queries at once: BM25, character n-grams, rank fusion, share of voice.

All inputs are DataFrames of ``(doc, text)`` and ``(query, text)``; statistics are computed
once for all queries. For BM25 the query side prunes the document side before any shuffle:
only postings of terms that a query holds are moved. Cosines need every n-gram for the
documents' norms; their counts are gathered within a document and written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import char_ngrams, text_of, tokenize
from corpuscle.operators.nearest import top_gram_cosine
from corpuscle.session import written

K1, B, RRF_K = 1.5, 0.75, 60.0
#: N-grams in more than this share of the documents are hot. There are at most 1 / share times a document's mean distinct n-grams of
#: them; they are broadcast up to this number.
HOT_SHARE, HOT_GRAMS = 0.01, 500_000


def bm25(docs: DataFrame, queries: DataFrame, stopwords: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """``query, doc, score`` of every document that shares a term with a query; terms that a query repeats count as often."""
    terms = docs.select("doc", tokenize(text_of("text"), stopwords).alias("terms"))
    stats = terms.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    asked = queries.select("query", F.explode(tokenize(text_of("text"), stopwords)).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term").distinct()
    # A document's term counts leave its row only for terms that some query asks for.
    postings = terms.select("doc", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    # Written once: frequencies and scores read them, whatever else the plan repeats.
    postings = written(postings.groupBy("doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf")), "bm25-postings")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").join(F.broadcast(stats))  # one row of statistics
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("query", "term", "times", idf.alias("idf"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)).alias("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(weights, "term").groupBy("query", "doc").agg(F.sum(part).alias("score")).filter("score > 0")


def char_tfidf(docs: DataFrame, queries: DataFrame, size: int = 4) -> DataFrame:
    """``query, doc, score``: cosine of (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) vectors over character n-grams.

    N-grams that no document has get the weight 1 and count in the query's norm. Texts are
    moved once, so that a document's n-grams are counted where they arise; these counts are
    written once and read for document frequencies, norms and dot products. Only n-grams of
    queries take part in dot products.
    """
    grams = char_ngrams(docs.select("doc", "text").repartition("doc"), ["doc"], "text", size).groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("tf"))
    grams = written(grams, "tfidf-grams", "lz4")
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total))
    idf = written(df.select("gram", (F.col("df") > HOT_SHARE * F.col("n")).alias("hot"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "tfidf-idf", "lz4")
    asked = char_ngrams(queries, ["query"], "text", size).groupBy("query", "gram").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.join(idf.drop("hot"), "gram", "left").select("query", "gram", "idf", ((1 + F.log("times")) * F.coalesce("idf", F.lit(1.0))).alias("qw"))
    asked = asked.select("*", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query"))).alias("qn"))
    dw = (1 + F.log("tf")) * F.col("idf")
    norms = weighed(grams, idf).groupBy("doc").agg(F.sqrt(F.sum(dw * dw)).alias("dn"))
    dots = grams.join(asked, "gram").groupBy("query", "doc", "qn").agg(F.sum(F.col("qw") * dw).alias("dot"))
    return dots.join(norms, "doc").select("query", "doc", (F.col("dot") / (F.col("qn") * F.col("dn"))).alias("score")).filter("score > 0")


def weighed(grams: DataFrame, idf: DataFrame) -> DataFrame:
    """``grams`` with ``idf`` (``gram, hot, idf``): rows of hot n-grams, most of all rows, get theirs where they lie; only the others are shuffled."""
    hot, rest = idf.filter("hot").select("gram", "idf"), idf.filter("NOT hot").select("gram", "idf")
    if hot.count() > HOT_GRAMS:
        return grams.join(idf.drop("hot"), "gram")
    met = grams.join(F.broadcast(hot), "gram", "left")
    return met.filter("idf IS NOT NULL").unionByName(met.filter("idf IS NULL").drop("idf").join(rest, "gram"))


def embedding_cosine(docs: DataFrame, queries: DataFrame, blocks: int | None = None) -> DataFrame:
    """``query, doc, score`` of dense vectors (``vector``).

    Documents are dealt to ``blocks`` by hash (as many as shuffle partitions if not given)
    and every query goes to each of them, so that no task holds more than its blocks'
    documents with the queries, also where Spark doesn't broadcast the query side.
    """
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    q = queries.select("query", F.col("vector").alias("qv"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("qn"))
    q = q.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = docs.select("doc", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("_block"), F.col("vector").alias("dv"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("dn"))
    return d.join(q, (F.col("_block") == F.col("_to")) & (F.size("dv") == F.size("qv"))).select("query", "doc", (dot(F.col("qv"), F.col("dv")) / (F.col("qn") * F.col("dn"))).alias("score"))


def ranked(scores: DataFrame, most: int, digits: int = 9) -> DataFrame:
    """The ``most`` best documents of each query with ``rank`` from 1; equal scores (to ``digits``) by document."""
    order = Window.partitionBy("query").orderBy(F.round("score", digits).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def fuse(lists: Sequence[tuple[DataFrame, float]], k: float = RRF_K) -> DataFrame:
    """``query, doc, score``: reciprocal rank fusion of ranked lists with weights."""
    union = None
    for ranks, weight in lists:
        part = ranks.select("query", "doc", (F.lit(float(weight)) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query", "doc").agg(F.sum("part").alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, top_n: int = 5, stopwords: Sequence[str] = (), k: float = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``query, doc, rank, score``: the ``top_n`` of fused lists of four times as many lexical and vector results."""
    lexical = ranked(bm25(docs, queries, stopwords), 4 * top_n)
    vector = ranked(top_gram_cosine(docs, queries, 4 * top_n), 4 * top_n)
    return ranked(fuse([(lexical, weights[0]), (vector, weights[1])], k), top_n)


def consensus(lexical: DataFrame, vector: DataFrame, queries: DataFrame, top_n: int = 5) -> DataFrame:
    """``query, consensus, covered``: documents in both top lists, and whether both have any."""
    a = lexical.filter(F.col("rank") <= top_n).select("query", "doc")
    b = vector.filter(F.col("rank") <= top_n).select("query", "doc")
    both = a.join(b, ["query", "doc"]).groupBy("query").agg(F.count(F.lit(1)).alias("consensus"))
    has = a.select("query").distinct().join(b.select("query").distinct(), "query").withColumn("covered", F.lit(True))
    out = queries.select("query").join(both, "query", "left").join(has, "query", "left")
    return out.select("query", F.coalesce("consensus", F.lit(0)).cast("long").alias("consensus"), F.coalesce("covered", F.lit(False)).alias("covered"))


def share_of_voice(fused: DataFrame, owners: DataFrame, digits: int = 1) -> DataFrame:
    """``owner, slots, share, presence, best_rank``: of all fused places, who holds how many, in how many queries."""
    fused = written(fused.select("query", "doc", "rank"), "share-places")  # a few for each query, read twice
    held = fused.join(owners, "doc")
    total = fused.agg(F.count(F.lit(1)).alias("total"))
    per = held.groupBy("owner").agg(F.count(F.lit(1)).alias("slots"), F.countDistinct("query").alias("presence"), F.min("rank").alias("best_rank"))
    return per.join(F.broadcast(total)).select("owner", "slots", F.round(100 * F.col("slots") / F.col("total"), digits).alias("share"), "presence", "best_rank")


def frequent_terms(docs: DataFrame, share: float) -> list[str]:
    """Stop words by rule: tokens in more than ``share`` of all documents. At most 1 / ``share`` times a document's mean distinct tokens."""
    n = docs.count()
    terms = docs.select("doc", F.explode(F.array_distinct(tokenize(text_of("text")))).alias("term"))
    found = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > share * n)
    return sorted(r["term"] for r in found.select("term").collect())


def term_statistics(docs: DataFrame) -> DataFrame:
    """``term, df, tf, idf`` over all documents, a row each."""
    tokens = docs.select(F.sort_array(tokenize(text_of("text"))).alias("_t"))
    # Sorted in its row, a document's term is counted as new where it follows another one; only sums by term move.
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))))
    seen = F.when(F.size("_t") > 0, F.zip_with("_t", before, lambda t, b: F.struct(t.alias("term"), (~t.eqNullSafe(b)).cast("long").alias("new"))))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = tokens.select(F.inline(seen)).groupBy("term").agg(F.sum("new").alias("df"), F.count(F.lit(1)).alias("tf"))
    return stats.join(F.broadcast(n)).select("term", "df", "tf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def topics(docs: DataFrame, most: int = 12) -> DataFrame:
    """``topic, weight``: adjacent token pairs count 3, single tokens 1; the ``most`` heaviest, ties by topic."""
    tokens = docs.select(F.filter(tokenize(text_of("text")), lambda t: F.char_length(t) > 2).alias("t"))
    pairs = F.transform(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b")), lambda p: F.struct(F.concat_ws(" ", p["a"], p["b"]).alias("topic"), F.lit(3).alias("w")))
    singles = F.transform("t", lambda x: F.struct(x.alias("topic"), F.lit(1).alias("w")))
    found = tokens.select(F.explode(F.concat(pairs, singles)).alias("x")).groupBy("x.topic").agg(F.sum("x.w").alias("weight"))
    return found.orderBy(F.col("weight").desc(), "topic").limit(most)


def generated_queries(found: DataFrame, templates: Sequence[str], most: int = 12) -> DataFrame:
    """``n, query``: every template filled with every topic, heaviest topic first, then in the templates' order; the first ``most``."""
    filled = F.posexplode(F.transform(F.array(*map(F.lit, templates)), lambda t: F.replace(t, F.lit("{}"), F.col("topic"))))
    rows = found.select("topic", "weight", filled.alias("place", "query")).orderBy(F.col("weight").desc(), "topic", "place").limit(most)
    return rows.select(F.row_number().over(Window.orderBy(F.col("weight").desc(), "topic", "place")).cast("long").alias("n"), "query")


def heading_topics(heads: DataFrame, banned: Sequence[str], most: int = 12) -> DataFrame:
    """``topic, weight`` from ``title`` (up to a bar) and ``headings`` of pages: neighbouring terms count 3, a text's only term 1; the ``most`` heaviest, ties by topic.

    Terms have four characters and more and are not ``banned`` (words of the query templates).
    """
    dropped = F.array(*map(F.lit, banned)) if banned else F.array().cast("array<string>")
    sources = F.concat(F.transform("headings", lambda h: h["text"]), F.array(F.get(F.split("title", r"\|"), F.lit(0))))
    rows = heads.select(F.explode(sources).alias("_s")).select(F.filter(tokenize(F.col("_s")), lambda t: (F.char_length(t) > 3) & ~F.array_contains(dropped, t)).alias("t"))
    last = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.transform(F.arrays_zip(F.slice("t", F.lit(1), last).alias("a"), F.slice("t", F.lit(2), last).alias("b")), lambda p: F.struct(F.concat_ws(" ", p["a"], p["b"]).alias("topic"), F.lit(3).alias("w")))
    alone = F.when(F.size("t") == 1, F.transform("t", lambda x: F.struct(x.alias("topic"), F.lit(1).alias("w")))).otherwise(F.array().cast("array<struct<topic:string,w:int>>"))
    found = rows.select(F.explode(F.concat(pairs, alone)).alias("x")).groupBy("x.topic").agg(F.sum("x.w").alias("weight"))
    return found.orderBy(F.col("weight").desc(), "topic").limit(most)


def retrieval_findings(agreed: DataFrame, top_n: int) -> DataFrame:
    """``key, area, severity, weight`` from queries with ``consensus, covered``: mean consensus in ``top_n``, and queries that a list leaves empty."""
    per = agreed.agg((F.avg("consensus") / top_n).alias("share"), F.count_if(~F.col("covered")).alias("open"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("n") == 0, None).when(F.col("share") < 0.2, "critical").when(F.col("share") < 0.45, "warning").otherwise("ok")
    one = lambda key, severity, weight: F.struct(F.lit(key).alias("key"), F.lit("retrieval").alias("area"), severity.alias("severity"), weight.alias("weight"))
    open_ = F.col("open") > 0
    rows = F.array(
        one("rrf.not_runnable", F.when(F.col("n") == 0, "critical"), F.lit(2.0)),
        one("rrf.consensus", level, F.lit(2.0)),
        one("rrf.uncovered", F.when(open_, "critical").when(F.col("n") > 0, "ok"), F.when(open_, 2.0).otherwise(1.0)),
    )
    return per.select(F.inline(rows)).filter("severity IS NOT NULL")


def share_findings(slots: DataFrame, owners: DataFrame) -> DataFrame:
    """``owner, slots, share, lost, share_severity, lost_severity`` of every owner, those without a slot too.

    ``slots`` are the queries' best documents with their ``owner``. A share below half of
    parity (100 / owners) is critical, below parity a warning. Queries in which an owner has
    no slot are lost: critical if more than half.
    """
    queries = slots.select("query").distinct().agg(F.count(F.lit(1)).alias("_q"))
    every = owners.select("owner").distinct()
    parity = every.agg((100.0 / F.count(F.lit(1))).alias("_p"))
    per = slots.groupBy("owner").agg(F.count(F.lit(1)).alias("slots"), F.countDistinct("query").alias("_in"))
    total = slots.agg(F.count(F.lit(1)).alias("_t"))
    # One row each: figures over all queries and owners.
    rows = every.join(per, every["owner"].eqNullSafe(per["owner"]), "left").select(every["owner"], F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("_in", F.lit(0)).alias("_in"))
    rows = rows.join(F.broadcast(queries)).join(F.broadcast(parity)).join(F.broadcast(total))
    share = F.round(100 * F.col("slots") / F.col("_t"), 1)
    lost = F.col("_q") - F.col("_in")
    return rows.select("owner", "slots", share.alias("share"), lost.alias("lost"),
        F.when(share < F.col("_p") / 2, "critical").when(share < F.col("_p"), "warning").otherwise("ok").alias("share_severity"),
        F.when(lost == 0, "ok").when(2 * lost > F.col("_q"), "critical").otherwise("warning").alias("lost_severity"))


#: Radius of an owner without a chunk, and what the largest owner's has on top.
LEAST_RADIUS, MORE_RADIUS = 5.0, 14.0


def share_map(shares: DataFrame, owners: DataFrame, queries: DataFrame) -> DataFrame:
    """``owner, share, presence, radius``: every owner's place on a map of share against presence.

    ``shares`` are from :func:`share_of_voice`; ``owners`` has a row for each chunk, so owners
    without a place come too, with zeros. ``presence`` is the part of all ``queries`` in which
    the owner has a place (0 without queries); the radius grows with the root of its chunks
    against the largest owner's.
    """
    sizes = owners.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"))
    # One row: figures over all owners and queries.
    most = sizes.agg(F.max("_n").alias("_most")).join(F.broadcast(queries.agg(F.countDistinct("query").alias("_q"))))
    rows = sizes.join(shares.select(F.col("owner").alias("_o"), "share", "presence"), F.col("owner").eqNullSafe(F.col("_o")), "left").join(F.broadcast(most))
    return rows.select(
        "owner",
        F.coalesce("share", F.lit(0.0)).alias("share"),
        F.coalesce(F.try_divide("presence", "_q"), F.lit(0.0)).alias("presence"),
        (LEAST_RADIUS + MORE_RADIUS * F.sqrt(F.col("_n") / F.col("_most"))).alias("radius"),
    )
