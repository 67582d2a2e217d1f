"""Registered queries over signals of trust and coverage, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions.text import TOKEN
from corpuscle.operators import site, trust
from corpuscle.plans.site_queries import given, texts
from corpuscle.plans.sql import HOST, PARSED, bounded, plain, q


def page_updates(spark, sf_dir):
    return trust.declared(given(spark, sf_dir))


def site_freshness(spark, sf_dir):
    """Age of the sites' latest updates on a fixed day, so that runs agree."""
    return trust.freshness(trust.declared(given(spark, sf_dir)), F.lit("2026-01-01").cast("date"))


def trust_findings(spark, sf_dir):
    rows = given(spark, sf_dir)
    return trust.trust_findings(rows, trust.declared(rows), texts(spark, sf_dir))


def topic_coverage(spark, sf_dir):
    return trust.topic_coverage(site.page_heads(given(spark, sf_dir)))


def filler_findings(spark, sf_dir):
    return trust.filler(texts(spark, sf_dir))


def site_acronyms(spark, sf_dir):
    return trust.acronyms(texts(spark, sf_dir))


def acronym_findings(spark, sf_dir):
    return trust.acronym_findings(site_acronyms(spark, sf_dir))


QUERIES = {f.__name__: f for f in (page_updates, site_freshness, trust_findings, topic_coverage, filler_findings, site_acronyms, acronym_findings)}

FLAGS = ", ".join(f"bool_or(regexp_matches(s, {q('(?i)' + bounded(p))})) AS s{i}" for i, p in enumerate(trust.LIFECYCLE.values()))
COUNT = " + ".join(f"s{i}::INT" for i in range(len(trust.LIFECYCLE)))
MISSING = ", ".join(f"CASE WHEN NOT s{i} THEN {q(name)} END" for i, name in enumerate(trust.LIFECYCLE))
ENDS = "list_transform(list_filter(range(2, 7), lambda n: n <= length(x)), lambda n: {})"
ACRONYMS = rf"""WITH {PARSED},
w AS (SELECT host AS owner, url, list_filter(regexp_extract_all(text, '[\pL\pN_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}') AND x NOT IN ({", ".join(map(q, trust.KNOWN_ACRONYMS))})) AS w FROM pg),
f AS (SELECT owner, acronym, min(ROW(url, place)) AS seen FROM (SELECT owner, url, unnest(range(len(w))) AS place, unnest(w) AS acronym FROM w) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seen, acronym) AS k FROM f),
x AS (SELECT host AS owner, unnest(regexp_extract_all(text, '([A-Z]{{2,}})\s*[(—–:-]', 1)) AS x, true AS tail FROM pg UNION ALL SELECT host, unnest(regexp_extract_all(text, '[(—–:-]\s*([A-Z]{{2,}})', 1)), false FROM pg),
l AS (SELECT DISTINCT owner, unnest(CASE WHEN tail THEN {ENDS.format("right(x, n)")} ELSE {ENDS.format("left(x, n)")} END) AS acronym FROM x)
SELECT k.owner, acronym, l.acronym IS NOT NULL AS expanded FROM k LEFT JOIN l USING (owner, acronym) WHERE k <= {trust.ACRONYMS}"""
SQL = {
    "topic_coverage": rf"""WITH r AS (SELECT {HOST} AS owner, coalesce(html, '') AS h FROM pages),
t AS (SELECT owner, {plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS s FROM r
 UNION ALL SELECT owner, unnest(list_transform(list_filter(regexp_extract_all(h, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>'), lambda x: regexp_matches(x, '(?i)^<h[1-4]')), lambda x: {plain('x')})) FROM r),
f AS (SELECT owner, {FLAGS} FROM t WHERE s <> '' GROUP BY owner), c AS (SELECT *, {COUNT} AS covered FROM f)
SELECT owner, covered, array_to_string(list_filter([{MISSING}], lambda x: x IS NOT NULL), ', ') AS missing, CASE WHEN covered < {trust.SECTIONS_GOOD} THEN 'warning' ELSE 'ok' END AS severity,
 CASE WHEN covered <= 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM c""",
    "filler_findings": rf"""WITH {PARSED}, c AS (SELECT host AS owner, len(regexp_extract_all(text, {q(TOKEN)})) AS w, len(regexp_extract_all(text, {q('(?i)' + trust.FILLER)})) AS h FROM pg),
p AS (SELECT owner, count(*) AS pages, sum(h)::BIGINT AS hits, count_if(h >= {site.FILLER_HITS} AND h / w >= {site.FILLER_DENSITY})::BIGINT AS saturated FROM c WHERE w >= {trust.FILLER_WORDS} GROUP BY owner)
SELECT *, CASE WHEN saturated > 0 THEN 'warning' ELSE 'ok' END AS severity, CASE WHEN saturated > 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM p""",
    "site_acronyms": ACRONYMS,
    "acronym_findings": rf"""WITH a AS ({ACRONYMS}), p AS (SELECT owner, count(*) AS n, count_if(expanded) AS l FROM a GROUP BY owner)
SELECT owner, 'lex.acronyms.bare' AS key, 'lexical' AS area, CASE WHEN l < n / 2 THEN 'warning' ELSE 'ok' END AS severity, 1.0::DOUBLE AS weight FROM p""",
}
