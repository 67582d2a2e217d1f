"""DuckDB SQL for the registered queries."""

import re

from corpuscle.functions.text import ANAPHORA, BAD_SLUG, DEFINITION, GENERIC_ANCHOR, QUESTION_STARTERS, SOFT_404, TOKEN
from corpuscle.operators.pages import SEMANTIC_TAGS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bounded(pattern: str) -> str:
    """Word boundaries that know letters beyond ASCII, spelt out."""
    return re.sub(r"(^|\|)\\b", r"\1(?:^|[^\\pL\\pN_])", pattern).replace(r"\b", r"(?:$|[^\pL\pN_])")


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {q(TOKEN)})"


LEXICAL = f"""
tok AS (SELECT doc_id AS doc, source, list_filter(list_transform({words("coalesce(text, '')")}, lambda x: lower(x)), lambda x: length(x) > 2) AS t FROM documents),
st AS (SELECT greatest(count(*), 1) AS n, avg(len(t)) AS avgdl FROM tok),
qs AS (SELECT item_id AS query, text FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(list_filter(list_transform({words("coalesce(text, '')")}, lambda x: lower(x)), lambda x: length(x) > 2)) AS term FROM qs) GROUP BY ALL),
po AS (SELECT doc, term, dl, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bm AS (
  SELECT query, doc, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))) AS score
  FROM po JOIN qt USING (term) JOIN df USING (term), st GROUP BY query, doc
), lex AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bm WHERE score > 0)
"""
VECTOR = r"""
nm AS (SELECT doc_id AS doc, regexp_replace(regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS s FROM documents),
qn AS (SELECT item_id AS query, regexp_replace(regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS s FROM benchmark WHERE item_id % 20 = 0),
dg AS (SELECT doc, gram, count(*) AS tf FROM (SELECT doc, unnest(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 4 THEN [s] ELSE list_transform(range(1, length(s) - 2), lambda i: substring(s, i, 4)) END) AS gram FROM nm) GROUP BY ALL),
qg AS (SELECT query, gram, count(*) AS tf FROM (SELECT query, unnest(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 4 THEN [s] ELSE list_transform(range(1, length(s) - 2), lambda i: substring(s, i, 4)) END) AS gram FROM qn) GROUP BY ALL),
gi AS (SELECT gram, ln((1 + (SELECT count(*) FROM nm)) / (1 + count(*))) + 1 AS idf FROM dg GROUP BY gram),
qw AS (SELECT query, gram, (1 + ln(tf)) * coalesce(idf, 1.0) AS w FROM qg LEFT JOIN gi USING (gram)),
qx AS (SELECT query, sqrt(sum(w * w)) AS n FROM qw GROUP BY query),
dw AS (SELECT doc, gram, (1 + ln(tf)) * idf AS w FROM dg JOIN gi USING (gram)),
dx AS (SELECT doc, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc),
co AS (SELECT query, doc, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (gram) GROUP BY query, doc),
cs AS (SELECT query, doc, dot / (qx.n * dx.n) AS score FROM co JOIN qx USING (query) JOIN dx USING (doc)),
vec AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM cs WHERE score > 0)
"""
HYBRID = f"""WITH {LEXICAL}, {VECTOR},
fu AS (SELECT query, doc, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score FROM (SELECT query, doc, rank FROM lex WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM vec WHERE rank <= 20) GROUP BY query, doc),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM fu)
SELECT query, doc, rank, round(score, 6) AS score FROM fr WHERE rank <= 5"""

PLAIN = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))"


def plain(expr: str) -> str:
    return PLAIN.format(expr)


KINDS = " + ".join(f"(regexp_matches(h, '(?i)<{t}\\b'))::INT" for t in SEMANTIC_TAGS)
URL = r"""regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]+://)?([^/?#:]*)', 1)), '^www\.', '') AS host,
 regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[^:/?#]+://[^/]*(.*)$', 1), '^/+|/+$', '', 'g') AS path"""
PARSED = rf"""
raw AS (SELECT page_id, url, coalesce(html, '') AS h, {URL} FROM pages),
cl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '(?is)<svg\b.*?</svg>', ' ', 'g') AS c FROM raw),
pg AS (
  SELECT page_id, url, host, CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '' THEN '/' ELSE regexp_extract(path, '([^/]*)$', 1) END AS slug,
    {plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
    regexp_extract(h, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang,
    regexp_extract(h, '(?i)<meta\s+name="description"\s+content="([^"]*)"', 1) AS description,
    regexp_extract(h, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical,
    regexp_matches(h, '(?i)<meta[^>]*charset=') AS has_charset, regexp_matches(h, '(?i)<meta[^>]*name="viewport"') AS has_viewport,
    len(regexp_extract_all(c, '(?is)<h1\b[^>]*>(.*?)</h1>')) AS h1, list_transform(regexp_extract_all(c, '(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>', 1)[1:2], lambda x: {plain('x')}) AS first_headings, len(regexp_extract_all(c, '(?is)<p\b[^>]*>(.*?)</p>')) AS paragraphs,
    list_transform(regexp_extract_all(c, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: lower({plain('x')})) AS anchors,
    len(regexp_extract_all(h, '(?i)<img\b')) AS images,
    coalesce(list_sum(list_transform(regexp_extract_all(h, '(?is)<script\b[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0)::BIGINT AS script_chars,
    {KINDS} AS semantic_kinds, len(regexp_extract_all(h, '(?i)<div\b')) AS divs, len(regexp_extract_all(h, '<[a-zA-Z]')) AS elements,
    regexp_matches(h, '(?i)application/ld\+json') AS has_jsonld, length(h) AS html_chars,
    {plain("regexp_replace(c, '(?is)^.*?<body\\b[^>]*>', '')")} AS text
  FROM cl
), pw AS (SELECT *, len({words("text")}) AS words FROM pg)
"""
RULES = [
    ("lex.title.missing", "lexical", "critical", 2.0, "title = ''"),
    ("lex.title.bad", "lexical", "critical", 2.0, "title <> '' AND (length(title) < 30 OR length(title) > 65 OR (length(title) < 65 AND regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) <> '' AND contains(replace(lower(title), 'www.', ''), lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)))))"),
    ("lex.h1.missing", "lexical", "critical", 1.5, "h1 = 0"),
    ("lex.h1.multi", "lexical", "warning", 1.0, "h1 > 1"),
    ("lex.words.thin", "lexical", "critical", 2.0, "words < 300"),
    ("lex.slug.bad", "lexical", "warning", 1.0, f"regexp_matches(slug, {q(BAD_SLUG)})"),
    ("lex.desc.missing", "lexical", "critical", 1.5, "description = ''"),
    ("tech.lang.missing", "technical", "warning", 1.0, "lang = ''"),
    ("tech.meta.charset", "technical", "warning", 1.0, "NOT has_charset"),
    ("tech.meta.viewport", "technical", "warning", 1.0, "NOT has_viewport"),
    ("tech.canonical.missing", "technical", "warning", 1.0, "canonical = ''"),
    ("tech.https.missing", "technical", "critical", 2.0, "NOT starts_with(url, 'https://')"),
    ("tech.links.generic_anchors", "technical", "info", 1.0, f"len(list_filter(anchors, lambda a: regexp_matches(a, {q('(?i)' + GENERIC_ANCHOR)}))) > 0"),
    ("tech.pages.soft404", "technical", "warning", 2.0, f"regexp_matches(concat_ws(' ', title, array_to_string(first_headings, ' ')), {q('(?i)' + SOFT_404)}) OR (words <= 120 AND regexp_matches(substr(text, 1, 1500), {q('(?i)' + SOFT_404)}))"),
    ("tech.js.heavy", "technical", "critical", 2.0, "html_chars > 0 AND words < 120 AND script_chars > 0.4 * html_chars"),
    ("sd.semantic.poor", "structured", "warning", 1.0, "elements >= 30 AND semantic_kinds < 2"),
    ("sd.semantic.divitis", "structured", "warning", 1.0, "elements >= 30 AND divs > 0.5 * elements"),
    ("sd.jsonld.none", "structured", "critical", 2.0, "NOT has_jsonld"),
]
FINDINGS = f"{PARSED}, fi AS (" + " UNION ALL ".join(
    f"SELECT host AS owner, {q(k)} AS key, {q(a)} AS area, CASE WHEN count_if({c}) > 0 THEN {q(s)} ELSE 'ok' END AS severity, {w}::DOUBLE AS weight, count_if({c})::BIGINT AS pages, min(url) FILTER (WHERE {c}) AS example FROM pw GROUP BY host"
    for k, a, s, w, c in RULES
) + ")"
LINES = "li AS (SELECT l_orderkey AS owner, 'line ' || l_linenumber AS area, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'ok' END AS severity, l_quantity::DOUBLE AS weight, l_linestatus || ' part ' || l_partkey AS title FROM lineitem)"
FACTOR = "CASE severity WHEN 'ok' THEN 1.0 WHEN 'warning' THEN 0.5 WHEN 'critical' THEN 0.0 END::DOUBLE"
RUNS = "ru AS (SELECT o_custkey AS site, o_orderdate AS created_at, o_orderkey AS run, o_totalprice::DOUBLE / 1000 AS overall FROM orders)"
TRADE = "tr AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), no AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)"
STARTS = " OR ".join(f"starts_with(s, {q(x)})" for x in QUESTION_STARTERS)

HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]+://)?([^/?#:]*)', 1)), '^www\.', '')"
PROFILE = f"""ga AS (SELECT *, {FACTOR} AS f FROM fi),
aa AS (SELECT owner, area, round_even(100 * sum(weight * f) / sum(weight) FILTER (WHERE f IS NOT NULL), 1) AS score FROM ga GROUP BY owner, area),
pw2(profile, area, w) AS (VALUES ('extract', 'lexical', 0.4::DOUBLE), ('extract', 'technical', 0.35), ('extract', 'structured', 0.25), ('markup', 'structured', 0.6), ('markup', 'technical', 0.4)),
ps AS (SELECT owner, profile, round_even(sum(w * score) / sum(w), 1) AS score FROM aa JOIN pw2 USING (area) WHERE score IS NOT NULL GROUP BY owner, profile)"""

SQL = {
    "hybrid_top5": HYBRID,
    "bm25_top20": f"WITH {LEXICAL} SELECT query, doc, rank, round(score, 6) AS score FROM lex WHERE rank <= 20",
    "char_tfidf_top20": f"WITH {VECTOR} SELECT query, doc, rank, round(score, 6) AS score FROM vec WHERE rank <= 20",
    "retrieval_consensus": f"""WITH {LEXICAL}, {VECTOR}
SELECT query, (SELECT count(*) FROM lex l JOIN vec v ON l.query = v.query AND l.doc = v.doc WHERE l.query = qs.query AND l.rank <= 5 AND v.rank <= 5) AS consensus,
       query IN (SELECT query FROM lex) AND query IN (SELECT query FROM vec) AS covered FROM qs""",
    "share_of_voice": f"""WITH {LEXICAL}, f AS (SELECT * FROM lex WHERE rank <= 5)
SELECT source AS owner, count(*) AS slots, round(100 * count(*) / (SELECT count(*) FROM f), 1) AS share, count(DISTINCT query) AS presence, min(rank) AS best_rank
FROM f JOIN documents ON doc = doc_id GROUP BY source""",
    "embedding_top5": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM s)
SELECT query, doc, rank, round(score, 5) AS score FROM r WHERE rank <= 5""",
    "term_statistics": f"""WITH t AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(list_transform({words("coalesce(text, '')")}, lambda x: lower(x))) AS term FROM documents) GROUP BY ALL)
SELECT term, count(*) AS df, sum(c)::BIGINT AS tf, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term""",
    "topic_terms": f"""WITH t AS (SELECT list_filter(list_transform({words("coalesce(text, '')")}, lambda x: lower(x)), lambda x: length(x) > 2) AS t FROM documents),
x AS (SELECT unnest(t) AS topic, 1 AS w FROM t UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 3 FROM t)
SELECT topic, sum(w)::BIGINT AS weight FROM x GROUP BY topic ORDER BY weight DESC, topic LIMIT 12""",
    "vocabulary": f"""WITH t AS (SELECT lang, unnest(list_transform({words("coalesce(text, '')")}, lambda x: lower(x))) AS term FROM documents)
SELECT lang, count(DISTINCT term) AS terms, count(*) AS tokens FROM t GROUP BY lang""",
    "text_signals": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(lower(trim(coalesce(text, ''), ' ')), '^[¿¡ ]+', '') AS s FROM documents)
SELECT doc_id, len({words("t")})::BIGINT AS words, ends_with(s, '?') OR {STARTS} AS question,
       regexp_matches(t, {q('(?i)' + bounded(DEFINITION))}) AS definition, regexp_matches(t, {q('(?i)' + bounded(ANAPHORA))}) AS anaphora FROM t""",
    "dominant_language": """WITH p AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source, lang)
SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM p) WHERE k = 1""",
    "page_fields": f"WITH {PARSED} SELECT page_id, host, slug, title, lang, has_charset, has_viewport, h1, paragraphs, len(anchors) AS anchors, images, script_chars, semantic_kinds, divs, elements, words FROM pw",
    "page_urls": rf"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b, {URL} FROM pages),
p AS (SELECT *, regexp_extract(b, '^([^:/?#]+://[^/?]*)', 1) AS head, regexp_extract(b, '^[^:/?#]+://[^/?]*([^?]*)', 1) AS pt, regexp_extract(b, '(\?.*)$', 1) AS qu FROM u)
SELECT page_id, head || CASE WHEN pt = '' THEN '/' WHEN length(pt) > 1 THEN regexp_replace(pt, '/$', '') ELSE pt END || CASE WHEN qu = '?' THEN '' ELSE qu END AS norm, host,
       CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '' THEN '/' ELSE regexp_extract(path, '([^/]*)$', 1) END AS slug FROM p""",
    "deduped_pages": f"WITH {PARSED} SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY length(url), url) AS n FROM pw) WHERE n = 1 OR text = ''",
    "page_findings": f"WITH {FINDINGS} SELECT * FROM fi",
    "page_scores": f"""WITH {FINDINGS}, g AS (SELECT *, {FACTOR} AS f FROM fi),
a AS (SELECT owner, area, round_even(100 * sum(weight * f) / sum(weight) FILTER (WHERE f IS NOT NULL), 1) AS score FROM g GROUP BY owner, area)
SELECT owner, coalesce(round_even(sum(w * score) / sum(w), 1), 0) AS overall FROM (SELECT *, CASE WHEN score IS NOT NULL THEN CASE area WHEN 'lexical' THEN 1.5 ELSE 1.0 END END::DOUBLE AS w FROM a) GROUP BY owner""",
    "remediation_plan": f"""WITH {FINDINGS} SELECT owner, key, severity, weight, row_number() OVER (PARTITION BY owner ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, weight DESC, key) AS priority
FROM fi WHERE severity IN ('critical', 'warning')""",
    "cited_domains": rf"""WITH h AS (SELECT {URL} FROM pages), t AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS target FROM h WHERE len(string_split(host, '.')) >= 2)
SELECT target, count(*)::BIGINT AS urls FROM h JOIN t ON host = target OR ends_with(host, '.' || target) GROUP BY target""",
    "area_scores": f"""WITH {LINES}, g AS (SELECT *, {FACTOR} AS f FROM li)
SELECT owner, area, round_even(100 * sum(weight * f) / sum(weight), 1) AS score FROM g GROUP BY owner, area""",
    "finding_gains": f"""WITH {LINES}, g AS (SELECT *, {FACTOR} AS f FROM li),
w AS (SELECT area, f, round_even(100 * weight * (1 - f) / sum(weight) OVER (PARTITION BY owner, area), 1) AS gain FROM g)
SELECT area, round_even(sum(gain), 1) AS gain, count(*) AS findings FROM w WHERE f < 1 GROUP BY area""",
    "severity_counts": f"""WITH {LINES} SELECT area, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'warning')::BIGINT AS warning, count_if(severity = 'ok')::BIGINT AS ok, count_if(severity = 'info')::BIGINT AS info FROM li GROUP BY area""",
    "run_changes": f"WITH {RUNS} SELECT run, site, round_even(overall, 0) - round_even(lag(overall) OVER (PARTITION BY site ORDER BY created_at, run), 0) AS change FROM ru",
    "last_twelve_runs": f"WITH {RUNS} SELECT site, run, age FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run DESC) AS age FROM ru) WHERE age <= 12",
    "findings_delta": rf"""WITH {LINES}, {RUNS}, k AS (SELECT DISTINCT owner AS run, area || '|' || regexp_replace(title, '\d+', 'N', 'g') AS key FROM li),
b AS (SELECT run, lag(run) OVER (PARTITION BY site ORDER BY created_at, run) AS before FROM ru),
n AS (SELECT run, key FROM b JOIN k USING (run) WHERE before IS NOT NULL), p AS (SELECT b.run, key FROM b JOIN k ON b.before = k.run)
SELECT run, (SELECT count(*) FROM n WHERE n.run = b.run AND (n.run, n.key) NOT IN (SELECT run, key FROM p)) AS new,
       (SELECT count(*) FROM p WHERE p.run = b.run AND (p.run, p.key) NOT IN (SELECT run, key FROM n)) AS resolved FROM b WHERE before IS NOT NULL""",
    "link_in_degree": f"WITH {TRADE} SELECT node, count(dst) AS links, count(DISTINCT src) AS sources FROM no LEFT JOIN tr ON dst = node AND src <> dst GROUP BY node",
    "link_orphans": f"WITH {TRADE} SELECT node FROM no WHERE node NOT IN (SELECT dst FROM tr WHERE src <> dst)",
    "link_depths": f"""WITH RECURSIVE {TRADE}, ed AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr),
de(node, depth) USING KEY (node) AS (SELECT 's1', 0 UNION SELECT dst, min(depth) + 1 FROM de JOIN ed ON src = node WHERE dst NOT IN (SELECT node FROM recurring.de) GROUP BY dst)
SELECT CASE WHEN depth IS NULL THEN 'unreachable' WHEN depth >= 4 THEN '4+' ELSE depth::VARCHAR END AS bucket, count(*) AS nodes FROM no LEFT JOIN de USING (node) GROUP BY 1""",
    "citation_rate": r"""SELECT role AS provider, count_if(coalesce(text, '') <> '')::BIGINT AS answered, count_if(coalesce(text, '') = '')::BIGINT AS failed,
 count_if(coalesce(text, '') <> '' AND regexp_matches(text, 'https?://|www\.|@|\d'))::BIGINT AS cited,
 coalesce(round_even(100.0::DOUBLE * count_if(coalesce(text, '') <> '' AND regexp_matches(text, 'https?://|www\.|@|\d')) / nullif(count_if(coalesce(text, '') <> ''), 0), 1), 0.0) AS rate FROM conversations GROUP BY role""",
    "anchor_variety": rf"""WITH a AS (SELECT DISTINCT {HOST} AS owner, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a FROM pages),
p AS (SELECT DISTINCT owner, lower({plain('a')}) AS text, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS target FROM a WHERE length(lower({plain('a')})) >= 3),
t AS (SELECT owner, text, count(*) AS n FROM p GROUP BY ALL)
SELECT owner, count(*) AS texts, sum(n)::BIGINT AS pairs, round(count(*) / sum(n), 3) AS variety, count_if(n > 1)::BIGINT AS ambiguous FROM t GROUP BY owner""",
    "profile_scores": f"WITH {FINDINGS}, {PROFILE} SELECT owner, profile, score FROM ps",
    "composite_index": f"WITH {FINDINGS}, {PROFILE} SELECT owner, round_even(sum(score * CASE profile WHEN 'extract' THEN 0.7 ELSE 0.3 END::DOUBLE) / sum(CASE profile WHEN 'extract' THEN 0.7 ELSE 0.3 END::DOUBLE), 1) AS index FROM ps GROUP BY owner",
}
SQL["generated_queries"] = f"""WITH tt AS ({SQL["topic_terms"]}), q AS (SELECT weight, topic, t.i, replace(t.p, '{{}}', topic) AS query FROM tt, (VALUES (0, 'what is {{}}'), (1, 'how does {{}} work'), (2, '{{}} guide')) t(i, p))
SELECT row_number() OVER (ORDER BY weight DESC, topic, i) AS n, query FROM q ORDER BY n LIMIT 12"""
