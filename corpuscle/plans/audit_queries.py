"""Registered queries over page audit reports, short lists and visits, derived from the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import audits, graph, lists, pages, scores, site
from corpuscle.plans import queries as own
from corpuscle.plans.site_queries import customer_pages
from corpuscle.plans.sql import SQL as OWN_SQL
from corpuscle.session import discard, table, written


def reports(spark, sf_dir, shift=0):
    """A report for every page, its scores and values from the page's number."""
    k = F.col("page_id") + shift
    audit = lambda title, score, value, shown: F.struct(score.alias("score"), F.lit(title).alias("title"), F.lit("See [the docs](http://x.example) now").alias("description"), shown.alias("displayValue"), value.alias("numericValue"))
    lcp = audit("LCP", (k % 10) / 10, (k % 7) * 1000.0, F.concat((k % 7).cast("string"), F.lit(" s")))
    alt = audit("", F.when(k % 3 > 0, (k % 5) / 5), F.lit(None).cast("double"), F.lit(None).cast("string"))
    ref = lambda name, weight: F.struct(F.lit(name).alias("id"), F.lit(weight).alias("weight"))
    performance = F.struct(F.lit("Performance").alias("title"), ((k % 10) / 10).alias("score"), F.array(ref("largest-contentful-paint", 10.0)).alias("auditRefs"))
    seo = F.struct(F.lit("").alias("title"), F.when(k % 3 > 0, (k % 5) / 5).alias("score"), F.array(ref("image-alt", 1.0), ref("gone", 1.0)).alias("auditRefs"))
    report = F.to_json(F.struct(F.struct(lcp.alias("largest-contentful-paint"), alt.alias("image-alt")).alias("audits"), F.struct(performance.alias("performance"), seo.alias("seo")).alias("categories")))
    return audits.reports(table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("url", report.alias("report"), F.col("page_id").alias("n")))


def audit_failures(spark, sf_dir):
    found = audits.failed_audits(reports(spark, sf_dir))
    return found.select("owner", "audit", "category", "score", "weight", "title", "description", "display", F.array_join("urls", " ").alias("urls"), "pages", "severity", "finding_weight", "key")


def audit_categories(spark, sf_dir):
    return audits.category_scores(reports(spark, sf_dir)).select("owner", "category", "title", "score", "pages")


def audit_vitals(spark, sf_dir):
    return audits.worst_vitals(reports(spark, sf_dir))


def audit_changes(spark, sf_dir):
    return audits.category_changes(audits.category_scores(reports(spark, sf_dir)), audits.category_scores(reports(spark, sf_dir, 4)))


def ranked(rows, links):
    """Nodes of the pages ``rows`` by the links that lead there; their depths are not looked up."""
    nodes = site.page_nodes(rows)
    return lists.ranked_nodes(nodes.select("host", "node"), graph.in_degree(links, nodes.select("node")), None, site.homes(rows))


def graph_nodes(spark, sf_dir):
    rows = customer_pages(spark, sf_dir)
    return lists.graph_nodes(ranked(rows, site.page_links(rows)), 10).select("host", "place", "node", "label", "incoming", "home")


def representative_pages(spark, sf_dir):
    rows = customer_pages(spark, sf_dir)
    links = written(site.page_links(rows), "page-links")
    found = written(ranked(rows, links).drop("depth"), "page-nodes")
    depths = graph.depths(links, found.filter("home"), onward=lists.unsettled(found, 5))
    discard(links)
    return lists.representative_pages(found.join(depths, "node", "left"), 5)


def largest_pages(spark, sf_dir):
    rows = own.parsed(spark, sf_dir).select(F.col("host").alias("owner"), "url", "words").filter("url IS NOT NULL")
    return lists.largest_pages(rows.distinct(), rows.filter("words < 100").select("url", F.lit("warning").alias("severity")).distinct())


def top_actions(spark, sf_dir):
    return lists.top_actions(scores.plan(pages.findings(own.parsed(spark, sf_dir)))).select("owner", "priority", "key")


def finding_anchors(spark, sf_dir):
    lines = own.line_findings(spark, sf_dir).select("owner", "area", "title", F.concat_ws("|", "area", "title").alias("o"))
    return T.numbered_anchors(lines, "owner", "o").select("owner", "area", "title", "anchor")


def score_verdicts(spark, sf_dir):
    """Areas of orders by verdict."""
    return scores.area_scores(own.line_findings(spark, sf_dir)).groupBy("area", T.score_verdict(F.col("score")).alias("verdict")).agg(F.count(F.lit(1)).alias("orders"))


def passage_labels(spark, sf_dir):
    heading = F.when(F.col("page_id") % 4 > 0, F.repeat("url", 2))
    return table(spark, sf_dir, "pages").select("page_id", T.passage_label(F.col("url"), heading).alias("label"))


def visit_findings(spark, sf_dir):
    """Documents as visits: their sources answer, fail, are slow and repeat themselves."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), k.cast("string").alias("url"), F.when(k % 50 == 0, 404).otherwise(200).alias("status"), F.when(k % 77 == 0, "timeout").otherwise("").alias("error"), ((k % 25) / 10).alias("elapsed"), "text")
    return pages.visit_findings(rows)


def anchor_findings(spark, sf_dir):
    return site.anchor_findings(site.anchor_pairs(customer_pages(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (audit_failures, audit_categories, audit_vitals, audit_changes, graph_nodes, representative_pages, largest_pages, top_actions, finding_anchors, score_verdicts, passage_labels, visit_findings, anchor_findings)}

HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]+://)?([^/?#:]*)', 1)), '^www\.', '')"
REPORTS = f"""p AS (SELECT {HOST} AS owner, url, page_id AS n FROM pages WHERE url IS NOT NULL),
r AS (SELECT owner, url, n, 'performance' AS category, 'Performance' AS title, 'largest-contentful-paint' AS audit, 'LCP' AS label, (n % 10) / 10 AS score, 10.0::DOUBLE AS weight, (n % 7) || ' s' AS display FROM p
  UNION ALL SELECT owner, url, n, 'seo', 'seo', 'image-alt', 'image-alt', CASE WHEN n % 3 > 0 THEN (n % 5) / 5 END, 1.0, '' FROM p)"""
CATEGORIES = """SELECT owner, category, any_value(title) AS title, round_even((avg(score))::DECIMAL(30,12) * 100, 0)::BIGINT AS score, count(score) AS pages FROM r GROUP BY owner, category HAVING count(score) > 0"""
GRAPH = """SELECT host, node, incoming, home, row_number() OVER (PARTITION BY host ORDER BY home DESC, incoming DESC, node) AS place FROM
(SELECT 's' || s || '.example' AS host, n.node, count(src) AS incoming, n.node = first_value(n.node) OVER (PARTITION BY s ORDER BY length(n.node), n.node) AS home FROM n LEFT JOIN e USING (node) GROUP BY n.node, s)"""

# Edges; pages that only depth tells apart, with the number of places they have; depths, in hosts where fewer of these than that have been reached.
DEPTHS = """x AS MATERIALIZED (SELECT DISTINCT 'http://s' || CASE WHEN src < 0 THEN (-2 - src) % 25 || '.example/lone/' || (-2 - src) ELSE src % 25 || '.example/c/' || src END AS src, node AS dst FROM e),
w AS MATERIALIZED (SELECT host, node, incoming, least(size, 7 - first) AS need FROM (SELECT *, count(*) OVER (PARTITION BY host, home, incoming) AS size, rank() OVER (PARTITION BY host ORDER BY home DESC, incoming DESC) AS first FROM g) WHERE NOT home AND first <= 6 AND size > 1),
d(node, host, depth) USING KEY (node) AS (SELECT node, host, 0 FROM g WHERE home UNION SELECT dst, host, min(depth) + 1 FROM d JOIN x ON src = node WHERE dst NOT IN (SELECT node FROM recurring.d)
 AND host IN (SELECT w.host FROM w LEFT JOIN recurring.d r ON r.node = w.node AND r.depth < 99 GROUP BY w.host, incoming HAVING count(r.node) < any_value(need)) GROUP BY dst, host)"""


def graph_sql(more: str = "") -> str:
    from corpuscle.plans.site_queries import CUSTOMERS

    return f"WITH {'RECURSIVE ' if more else ''}{CUSTOMERS}, g AS {'MATERIALIZED ' if more else ''}({GRAPH}){more}"


SQL = {
    "audit_failures": f"""WITH {REPORTS}, f AS (SELECT * FROM r WHERE score < 0.9),
u AS (SELECT owner, audit, url, min(n) AS n FROM f WHERE url <> '' GROUP BY ALL), v AS (SELECT owner, audit, array_to_string(list(url ORDER BY n)[1:3], ' ') AS urls, count(*) AS pages FROM u GROUP BY ALL)
SELECT owner, audit, any_value(category) AS category, min(score) AS score, max(weight) AS weight, any_value(label) AS title, 'See the docs now' AS description, min_by(display, n) AS display, any_value(urls) AS urls, any_value(pages) AS pages,
 CASE WHEN max(weight) <= 0 THEN 'info' WHEN min(score) < 0.5 AND max(weight) >= 3 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN max(weight) >= 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS finding_weight, 'lh.' || any_value(category) || '.' || audit AS key
FROM f JOIN v USING (owner, audit) GROUP BY owner, audit""",
    "audit_categories": f"WITH {REPORTS} {CATEGORIES}",
    "audit_vitals": f"""WITH {REPORTS}, w AS (SELECT owner, max(n % 7) AS m FROM p GROUP BY owner)
SELECT owner, 'largest-contentful-paint' AS id, 'LCP' AS label, m * 1000.0::DOUBLE AS value, m || ' s' AS display, CASE WHEN m * 1000 <= 2500 THEN 'buono' WHEN m * 1000 <= 4000 THEN 'da migliorare' ELSE 'scarso' END AS verdict FROM w""",
    "audit_changes": f"""WITH {REPORTS}, a AS ({CATEGORIES}), o AS (SELECT owner, category, CASE category WHEN 'seo' THEN CASE WHEN (n + 4) % 3 > 0 THEN ((n + 4) % 5) / 5 END ELSE ((n + 4) % 10) / 10 END AS score FROM r),
b AS (SELECT owner, category, round_even((avg(score))::DECIMAL(30,12) * 100, 0)::BIGINT AS score FROM o GROUP BY ALL HAVING count(score) > 0)
SELECT owner, category, title, (a.score - b.score)::DOUBLE AS delta FROM a JOIN b USING (owner, category)""",
    "graph_nodes": graph_sql() + " SELECT host, place, node, CASE WHEN contains(node, '/list') THEN '/list' ELSE regexp_extract(node, 'example(.*)$', 1) END AS label, incoming, home FROM g WHERE place <= 10",
    "representative_pages": graph_sql(f", {DEPTHS}") + """ SELECT host, place, node FROM (SELECT host, node, row_number() OVER (PARTITION BY host ORDER BY home DESC, incoming DESC, coalesce(depth, 99), node) AS place FROM g LEFT JOIN (SELECT node, depth FROM d) USING (node)) WHERE place <= 6""",
    "largest_pages": f"""WITH p AS (SELECT DISTINCT x.host AS owner, pages.url, x.words, regexp_extract(pages.url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM ({OWN_SQL["page_fields"]}) x JOIN pages USING (page_id) WHERE pages.url IS NOT NULL AND x.words > 0)
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY words DESC, url) AS place, url, CASE WHEN path = '' THEN '/' WHEN length(path) > 30 THEN substr(path, 1, 27) || '...' ELSE path END AS label, words,
 CASE WHEN words < 100 THEN 'warning' ELSE 'ok' END AS severity FROM p QUALIFY count(*) OVER (PARTITION BY owner) > 1 AND row_number() OVER (PARTITION BY owner ORDER BY words DESC, url) <= 40""",
    "top_actions": f"SELECT owner, priority, key FROM ({OWN_SQL['remediation_plan']}) WHERE priority <= 3",
    "finding_anchors": """WITH li AS (SELECT l_orderkey AS owner, 'line ' || l_linenumber AS area, l_linestatus || ' part ' || l_partkey AS title, l_linenumber AS n FROM lineitem),
a AS (SELECT *, 'r-line-' || n || '-' || lower(title[1]) || '-part-n' AS s FROM li), k AS (SELECT *, row_number() OVER (PARTITION BY owner, s ORDER BY area || '|' || title) AS k FROM a)
SELECT owner, area, title, CASE WHEN k > 1 THEN s || '-' || k ELSE s END AS anchor FROM k""",
    "score_verdicts": f"SELECT area, CASE WHEN score >= 70 THEN 'Buono' WHEN score >= 40 THEN 'Da migliorare' WHEN score IS NOT NULL THEN 'Critico' END AS verdict, count(*) AS orders FROM ({OWN_SQL['area_scores']}) GROUP BY ALL",
    "passage_labels": r"""SELECT page_id, CASE WHEN regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END || '  · ' || ' ' || CASE WHEN page_id % 4 > 0 THEN substr(repeat(url, 2), 1, 60) ELSE '(senza heading)' END AS label FROM pages""",
    "visit_findings": """WITH v AS (SELECT source AS owner, doc_id::VARCHAR AS url, doc_id % 50 <> 0 AND doc_id % 77 <> 0 AS ok, (doc_id % 25) / 10 AS elapsed, coalesce(text, '') AS t FROM documents),
d AS (SELECT owner, t, count(*) - 1 AS c, max_by(url, {'l': length(url), 'u': url}) AS u FROM v WHERE ok AND t <> '' GROUP BY owner, t HAVING count(*) > 1)
SELECT owner, 'tech.pages.broken' AS key, 'critical' AS severity, 1.0::DOUBLE AS weight, count(*)::BIGINT AS pages, min(url) AS example FROM v WHERE NOT ok GROUP BY owner
UNION ALL SELECT owner, 'tech.slow', 'warning', 1.0, count(*), min(url) FROM v WHERE ok AND elapsed > 2.0 GROUP BY owner
UNION ALL SELECT owner, 'tech.pages.duplicates', 'warning', 1.0, sum(c)::BIGINT, min(u) FROM d GROUP BY owner""",
    "anchor_findings": """WITH c AS (SELECT 's' || c_custkey % 25 || '.example' AS owner, c_custkey AS k FROM customer),
a AS (SELECT owner, 'next' AS text, k + 25 AS t FROM c UNION SELECT owner, 'second', k + 50 FROM c UNION SELECT owner, 'again', k + 25 FROM c WHERE k % 3 = 0 UNION SELECT owner, 'back', k - 25 FROM c UNION SELECT owner, 'list', -999 FROM c),
b AS (SELECT owner, text, count(*) AS n FROM a GROUP BY ALL), s AS (SELECT owner, count(*) AS texts, sum(n)::BIGINT AS pairs, count_if(n > 1)::BIGINT AS ambiguous FROM b GROUP BY owner HAVING sum(n) >= 10)
SELECT owner, CASE WHEN texts / pairs >= 0.8 THEN 'tech.anchors.varied' ELSE 'tech.anchors.repetitive' END AS key, 'technical' AS area, CASE WHEN texts / pairs >= 0.8 THEN 'ok' ELSE 'warning' END AS severity, 1.0::DOUBLE AS weight, texts, pairs, ambiguous FROM s""",
}
