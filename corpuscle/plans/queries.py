"""The registered queries of the reference's own operators, over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import graph, nearest, pages, retrieval, scores
from corpuscle.session import spread, table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: benchmark items whose id is divisible by 20."""
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query"), "text")


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def bm25_top20(spark, sf_dir):
    found = retrieval.ranked(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir)), 20)
    return found.select("query", "doc", "rank", r("score"))


def char_tfidf_top20(spark, sf_dir):
    found = retrieval.ranked(nearest.top_gram_cosine(corpus(spark, sf_dir), asked(spark, sf_dir), 20), 20)
    return found.select("query", "doc", "rank", r("score"))


def hybrid_top5(spark, sf_dir):
    return retrieval.hybrid(corpus(spark, sf_dir), asked(spark, sf_dir), 5).select("query", "doc", "rank", r("score"))


def retrieval_consensus(spark, sf_dir):
    docs, queries = corpus(spark, sf_dir), asked(spark, sf_dir)
    lexical, vector = retrieval.ranked(retrieval.bm25(docs, queries), 5), retrieval.ranked(nearest.top_gram_cosine(docs, queries, 5), 5)
    return retrieval.consensus(lexical, vector, queries)


def share_of_voice(spark, sf_dir):
    owners = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("owner"))
    lexical = retrieval.ranked(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir)), 5)
    return retrieval.share_of_voice(lexical, owners)


def embedding_top5(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    docs = vectors.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    queries = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return retrieval.ranked(nearest.top_embedding_cosine(docs, queries, 5, 6), 5, 6).select("query", "doc", "rank", r("score", 5))


def term_statistics(spark, sf_dir):
    return retrieval.term_statistics(corpus(spark, sf_dir)).select("term", "df", "tf", r("idf"))


def topic_terms(spark, sf_dir):
    return retrieval.topics(corpus(spark, sf_dir))


def vocabulary(spark, sf_dir):
    """Distinct tokens and tokens by language."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("lang", F.explode(T.tokenize(T.text_of("text"))).alias("term"))
    return tokens.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("tokens"))


def text_signals(spark, sf_dir):
    """Word counts, questions, definitions and openings that refer back, of every document."""
    t = T.text_of("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).cast("long").alias("words"), T.is_question(t).alias("question"), T.defines(t).alias("definition"), T.refers_back(t).alias("anaphora"))


def dominant_language(spark, sf_dir):
    """Each source's most frequent language, ties by the smallest id."""
    per = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return per.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"), F.max("n").alias("n"))


def document_passages(spark, sf_dir):
    return pages.passages(table(spark, sf_dir, "documents"), ["doc_id"])


def surface_math(spark, sf_dir):
    """Passages now and to be had: every document at least four, and one more."""
    per = pages.passages(table(spark, sf_dir, "documents"), ["doc_id", "source"]).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy("source").agg(F.sum("c").alias("now"), F.sum(F.greatest("c", F.lit(4)) + 1).alias("potential"))
    return out.select("source", "now", "potential", F.round(F.col("potential") / F.col("now"), 1).alias("multiplier"))


def parsed(spark, sf_dir):
    return pages.parse_pages(table(spark, sf_dir, "pages"))


def page_fields(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return p.select("page_id", "host", "slug", "title", "lang", "has_charset", "has_viewport", F.size("h1").alias("h1"), "paragraphs", F.size("anchors").alias("anchors"), "images", "script_chars", "semantic_kinds", "divs", "elements", "words")


def page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.norm_url(F.col("url")).alias("norm"), T.host(F.col("url")).alias("host"), T.slug(F.col("url")).alias("slug"))


def deduped_pages(spark, sf_dir):
    return pages.dedupe_pages(parsed(spark, sf_dir), id_col="page_id").select("page_id", "url")


def page_findings(spark, sf_dir):
    return pages.findings(parsed(spark, sf_dir))


def page_scores(spark, sf_dir):
    areas = scores.area_scores(pages.findings(parsed(spark, sf_dir)))
    return scores.overall_scores(areas, {"technical": 1.0, "lexical": 1.5, "structured": 1.0})


def remediation_plan(spark, sf_dir):
    return scores.plan(pages.findings(parsed(spark, sf_dir))).select("owner", "key", "severity", "weight", "priority")


def cited_domains(spark, sf_dir):
    """How many urls lie on each registered domain or below it."""
    hosts = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host"))
    targets = hosts.select(F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("target")).filter(F.size(F.split("target", r"\.")) == 2).distinct()
    return scores.cited_hosts(hosts, targets)


def line_findings(spark, sf_dir):
    """Lines of orders as findings of runs: what came back is critical, what went out is a warning, the rest is in order."""
    severity = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "warning").otherwise("ok")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("area"), severity.alias("severity"), F.col("l_quantity").cast("double").alias("weight"), F.concat_ws(" part ", "l_linestatus", "l_partkey").alias("title"))


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run"), (F.col("o_totalprice").cast("double") / 1000).alias("overall"))


def area_scores(spark, sf_dir):
    return scores.area_scores(line_findings(spark, sf_dir))


def finding_gains(spark, sf_dir):
    lines = line_findings(spark, sf_dir).withColumn("key", T.finding_key(F.col("area"), F.col("title")))
    return scores.gains(lines, "owner").groupBy("area").agg(F.round(F.sum("gain"), 1).alias("gain"), F.count(F.lit(1)).alias("findings"))


def severity_counts(spark, sf_dir):
    return scores.severity_pivot(line_findings(spark, sf_dir))


def run_changes(spark, sf_dir):
    return scores.previous_run(runs(spark, sf_dir)).select("run", "site", "change")


def last_twelve_runs(spark, sf_dir):
    return scores.last_runs(runs(spark, sf_dir), 12).select("site", "run", "age")


def findings_delta(spark, sf_dir):
    lines = line_findings(spark, sf_dir).select(F.col("owner").alias("run"), T.finding_key(F.col("area"), F.col("title")).alias("key"))
    return scores.findings_delta(runs(spark, sf_dir), lines)


def trade_links(spark, sf_dir):
    """Links between customers (``c``) and suppliers (``s``) that traded."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey")).alias("c"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"))
    lines = spread(lines, lines.count(), "l_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c").alias("src"), F.col("s").alias("dst"))


def trade_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node")))


def link_in_degree(spark, sf_dir):
    return graph.in_degree(trade_links(spark, sf_dir), trade_nodes(spark, sf_dir))


def link_orphans(spark, sf_dir):
    return graph.orphans(trade_links(spark, sf_dir), trade_nodes(spark, sf_dir))


def link_depths(spark, sf_dir):
    links = trade_links(spark, sf_dir)
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = trade_nodes(spark, sf_dir)
    found = graph.depths(both, nodes.filter("node = 's1'"))
    return graph.depth_histogram(found, nodes)


def citation_rate(spark, sf_dir):
    """Turns of each role: those with text answered, those that mention a number or address cited."""
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("provider"), (F.length(T.text_of("text")) > 0).alias("ok"), T.text_of("text").rlike(r"https?://|www\.|@|\d").alias("cited"))
    return scores.citation_rates(turns)


def anchor_variety(spark, sf_dir):
    return pages.anchor_variety(table(spark, sf_dir, "pages"))


# Weights of areas in profiles, and of profiles in the index.
PROFILES = {"extract": {"lexical": 0.4, "technical": 0.35, "structured": 0.25}, "markup": {"structured": 0.6, "technical": 0.4}}
INDEX = {"extract": 0.7, "markup": 0.3}


def profile_scores(spark, sf_dir):
    return scores.profile_scores(scores.area_scores(pages.findings(parsed(spark, sf_dir))), PROFILES)


def composite_index(spark, sf_dir):
    return scores.composite_index(profile_scores(spark, sf_dir), INDEX)


def generated_queries(spark, sf_dir):
    return retrieval.generated_queries(retrieval.topics(corpus(spark, sf_dir)), ["what is {}", "how does {} work", "{} guide"])


QUERIES = {f.__name__: f for f in (
    hybrid_top5, bm25_top20, char_tfidf_top20, retrieval_consensus, share_of_voice, embedding_top5, term_statistics, topic_terms, vocabulary, text_signals, dominant_language,
    document_passages, surface_math, page_fields, page_urls, deduped_pages, page_findings, page_scores, remediation_plan, cited_domains, area_scores, finding_gains, severity_counts,
    run_changes, last_twelve_runs, findings_delta, link_in_degree, link_orphans, link_depths, citation_rate,
    anchor_variety, profile_scores, composite_index, generated_queries,
)}
