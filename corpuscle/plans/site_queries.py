"""Registered queries over the pages of sites together, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import blocks, graph, pages, questions, retrieval, site
from corpuscle.plans import queries as own
from corpuscle.plans.sql import HOST, PARSED, bounded, plain, q, words
from corpuscle.plans.sql import SQL as OWN_SQL
from corpuscle.session import dealt, table, written


def given(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def texts(spark, sf_dir):
    return pages.parse_pages(given(spark, sf_dir)).select("url", "slug", "text")


def page_heads(spark, sf_dir):
    return site.page_heads(given(spark, sf_dir)).withColumn("headings", F.size("headings"))


def page_links(spark, sf_dir):
    return site.page_edges(given(spark, sf_dir))


def page_in_degree(spark, sf_dir):
    return graph.in_degree(site.page_links(given(spark, sf_dir)), site.page_nodes(given(spark, sf_dir)).select("node"))


def customer_pages(spark, sf_dir):
    """A page for every customer, on 25 hosts, that links to others in all ways a link is written."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    to = lambda n: (k + n).cast("string")
    links = [
        text("<a href='./", to(25), "'>next</a>"),
        text('<A class=x HREF="../c/../c/', to(50), '#top">second</A>'),
        F.when(k % 3 == 0, text("<a href=", to(25), ">again</a>")).otherwise(""),
        text('<a href="/c/', to(-25), '/">back</a>'),
        text('<a href="/list?a=1&amp;b=', (k % 25).cast("string"), '">list</a>'),
        text('<a href="http://s', ((k + 1) % 25).cast("string"), ".example/c/", to(1), '">elsewhere</a>'),
        text('<a href="mailto:', to(25), '@x.example">mail</a>'),
    ]
    at = F.concat(F.lit("http://s"), (k % 25).cast("string"), F.lit(".example"))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k, at.alias("at"), F.concat(*links).alias("html"))
    lone = rows.filter(k % 10 == 0).select(F.concat("at", F.lit("/lone/"), k.cast("string")).alias("url"), F.concat(F.lit("<a href=../c/"), k.cast("string"), F.lit(">in</a>")).alias("html"))
    lists = rows.filter(k < 25).select(F.concat("at", F.lit("/list?a=1&b="), (k % 25).cast("string")).alias("url"), F.lit("<p>list</p>").alias("html"))
    return rows.select(F.concat("at", F.lit("/c/"), k.cast("string")).alias("url"), "html").unionByName(lists).unionByName(lone)


def customer_in_degree(spark, sf_dir):
    rows = customer_pages(spark, sf_dir)
    return graph.in_degree(site.page_links(rows), site.page_nodes(rows).select("node"))


def customer_orphans(spark, sf_dir):
    rows = customer_pages(spark, sf_dir)
    return graph.orphans(site.page_links(rows), site.page_nodes(rows).select("node"), site.homes(rows))


def customer_redirects(spark, sf_dir):
    """Findings over where customers' pages would lead: a kind for each host, chains on some."""
    k = F.col("c_custkey")
    at, path = F.concat(F.lit("s"), (k % 25).cast("string"), F.lit(".example")), F.concat(F.lit("/c/"), k.cast("string"))
    final = F.when(k % 5 == 0, F.concat(F.lit("https://"), at, path)).when(k % 5 == 1, F.concat(F.lit("http://www."), at, path)).when(k % 5 == 2, F.concat(F.lit("http://"), at, F.lit("/moved"), path)).when(k % 5 == 3, F.concat(F.lit("http://"), at, path, F.lit("/#top")))
    rows = table(spark, sf_dir, "customer").select(at.alias("owner"), F.concat(F.lit("http://"), at, path).alias("url"), final.alias("final_url"), F.when(k % 25 < 10, k % 4).alias("redirects"))
    return site.redirect_findings(rows)


#: Pages that a task makes of parts, and typed objects of a page at most.
PART_PAGES, PART_OBJECTS = 100_000, 6


def part_pages(spark, sf_dir):
    """A page for every part with its structured data: prices that are 0 or missing, brands, questions."""
    k = F.col("p_partkey")
    offer = F.when(k % 4 == 0, F.struct(F.lit("Offer").alias("@type"), (k % 3).alias("price"), F.lit("EUR").alias("priceCurrency")))
    product = F.struct(F.lit("Product").alias("@type"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("name"), offer.alias("offers"), F.struct(F.array(F.lit("Organization"), F.lit("Brand")).alias("@type"), F.col("p_brand").alias("name"), F.when(k % 7 == 0, F.lit("https://b.example")).alias("url")).alias("brand"))
    item = F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(F.struct(F.lit("ListItem").alias("@type"), F.lit(0).alias("position"))).alias("itemListElement"))
    scripts = F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(product), F.lit("</script>"), F.when(k % 2 == 0, F.concat(F.lit('<SCRIPT id=x TYPE="application/ld+json">['), F.to_json(item), F.lit("]</SCRIPT>"))).otherwise(F.when(k % 9 == 0, F.lit("<script type='application/ld+json'>{broken</script>")).otherwise("")))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return dealt(parts, "p_partkey", least=parts.count() // PART_PAGES + 1).select(F.concat(F.lit("https://p"), (k % 5).cast("string"), F.lit(".example/"), k.cast("string")).alias("url"), scripts.alias("html"))


def part_jsonld_types(spark, sf_dir):
    return site.jsonld_types(site.jsonld_nodes(part_pages(spark, sf_dir)), rows=PART_OBJECTS * table(spark, sf_dir, "part").count())


def part_jsonld_missing(spark, sf_dir):
    rows = PART_OBJECTS * table(spark, sf_dir, "part").count()
    return site.jsonld_missing(site.jsonld_nodes(part_pages(spark, sf_dir)), rows).withColumn("missing", F.array_join("missing", ","))


def page_orphans(spark, sf_dir):
    rows = given(spark, sf_dir)
    return graph.orphans(site.page_edges(rows), site.page_nodes(rows).select("node"), site.homes(rows))


def page_depths(spark, sf_dir):
    rows = given(spark, sf_dir)
    nodes = site.page_nodes(rows).select("node")
    return graph.depth_histogram(graph.depths(site.page_edges(rows), site.homes(rows)), nodes)


def page_link_findings(spark, sf_dir):
    rows = given(spark, sf_dir)
    edges, home = site.page_edges(rows), site.homes(rows)
    return site.link_findings(edges, site.page_nodes(rows), home, graph.depths(edges, home))


def site_findings(spark, sf_dir):
    return site.site_findings(site.page_rows(given(spark, sf_dir)))


def page_blocks(spark, sf_dir):
    """Headings and paragraphs of every page in document order."""
    found = blocks.page_blocks(given(spark, sf_dir), "page_id")
    return found.select("page_id", F.posexplode_outer("blocks").alias("n", "b")).filter("b IS NOT NULL").select("page_id", "n", "b.kind", "b.level", "b.text")


def part_lists(spark, sf_dir):
    """Blocks of lists that are written from parts: paragraphs in items, items without ends, references."""
    k = F.col("p_partkey").cast("string")
    html = F.concat(F.lit("<h2 id=a>List&nbsp;"), k, F.lit(" &amp; more</h2><ul><li>"), F.col("p_name"), F.lit(" short<li><p>"), F.repeat("p_name", 3), F.lit(" <b>and</b> on</p> tail<ol><li>"), F.repeat("p_brand", 5), F.lit("</ol></ul><p>"), F.repeat("p_name", 4), F.lit("<div>no block of its own</div><h5>"), k, F.lit("</h5>"))
    found = blocks.page_blocks(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey")
    return found.select("p_partkey", F.posexplode_outer("blocks").alias("n", "b")).filter("b IS NOT NULL").select("p_partkey", "n", "b.kind", "b.level", "b.text")


def page_sections(spark, sf_dir):
    return site.sections(given(spark, sf_dir))


def section_findings(spark, sf_dir):
    rows = given(spark, sf_dir)
    return site.section_findings(site.sections(rows), site.page_rows(rows), T.tokenize(F.col("text")))


def extractable_paragraphs(spark, sf_dir):
    return site.extractable(given(spark, sf_dir))


def jsonld_findings(spark, sf_dir):
    rows = given(spark, sf_dir)
    return site.jsonld_findings(site.jsonld_nodes(rows), rows)


#: Words of the query templates: no topics.
BANNED = ["what", "does", "work", "guide"]


def page_topics(spark, sf_dir):
    return retrieval.heading_topics(site.page_heads(given(spark, sf_dir)), BANNED)


def nation_pages(spark, sf_dir):
    """Pages that a part's supplier would have, two in three without a title and headings that name anything; languages as they are declared."""
    k = F.col("s_suppkey")
    lang = F.element_at(F.array(*map(F.lit, ["en-US", "de", " DE -AT", "", "pt-BR", "fr", "en"])), (k % 7 + 1).cast("int"))
    head = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("<title>"), F.col("s_name"), F.lit(" of supply chains | "), F.col("s_acctbal").cast("string"), F.lit("</title><h2>what does "), F.col("s_name"), F.lit(" cost</h2>"))).otherwise("<h2>what is it</h2>")
    html = F.concat(F.lit("<html lang='"), lang, F.lit("'>"), head, F.lit("<body><p>"), F.col("s_name"), F.lit(" address delivers "), F.col("s_name"), F.lit(" delivers what</p></html>"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".example/s/"), k.cast("string")).alias("url"), html.alias("html"))


def site_topics(spark, sf_dir):
    """Topics of the given pages' hosts."""
    return questions.site_topics(site.page_rows(given(spark, sf_dir))).select("owner", "topic", "weight", "rank")


def site_languages(spark, sf_dir):
    return questions.site_languages(site.page_heads(given(spark, sf_dir)))


def nation_languages(spark, sf_dir):
    return questions.site_languages(site.page_heads(nation_pages(spark, sf_dir)))


def nation_questions(spark, sf_dir):
    """Questions for hosts of which most have no topics but in their texts."""
    rows = site.page_rows(nation_pages(spark, sf_dir))
    return questions.site_questions(questions.site_topics(rows), questions.site_languages(rows))


def site_questions(spark, sf_dir):
    rows = site.page_rows(given(spark, sf_dir))
    return questions.site_questions(questions.site_topics(rows), questions.site_languages(rows))


def retrieval_findings(spark, sf_dir):
    return retrieval.retrieval_findings(own.retrieval_consensus(spark, sf_dir), 5)


def share_findings(spark, sf_dir):
    """Sources' shares of the fused lists' places."""
    owners = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("owner"))
    slots = written(own.hybrid_top5(spark, sf_dir).join(owners, "doc").select("query", "owner"), "share-slots")
    return retrieval.share_findings(slots, owners)


def share_map(spark, sf_dir):
    """Sources by their share of the lexical lists' places and the queries in which they have one."""
    owners = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("owner"))
    shares = own.share_of_voice(spark, sf_dir)
    return retrieval.share_map(shares, owners, own.asked(spark, sf_dir)).select("owner", "share", F.round("presence", 6).alias("presence"), F.round("radius", 6).alias("radius"))


QUERIES = {f.__name__: f for f in (page_heads, page_links, page_in_degree, customer_in_degree, customer_orphans, customer_redirects, part_jsonld_types, part_jsonld_missing, page_orphans, page_depths, page_link_findings, site_findings, page_blocks, part_lists, page_sections, section_findings, extractable_paragraphs, jsonld_findings, page_topics, site_topics, site_languages, site_questions, nation_languages, nation_questions, retrieval_findings, share_findings, share_map)}


def attribute(tag: str, name: str) -> str:
    pattern = "(?is)[\\s\"']" + name + "\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    return " || ".join(f"regexp_extract({tag}, {q(pattern)}, {i})" for i in (1, 2, 3))


def meta(name: str, key: str = "name") -> str:
    return f"coalesce({attribute(f'list_filter(m, lambda t: lower({attribute("t", key)}) = {q(name)})[1]', 'content')}, '')"


def norm(url: str) -> str:
    """The url without fragment, closing slash and bare question mark."""
    b = f"regexp_replace({url}, '#.*$', '')"
    head, path, query = (f"regexp_extract({b}, {q(p)}, 1)" for p in ("^([^:/?#]+://[^/?]*)", "^[^:/?#]+://[^/?]*([^?]*)", r"(\?.*)$"))
    return f"{head} || CASE WHEN {path} = '' THEN '/' WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END || CASE WHEN {query} = '?' THEN '' ELSE {query} END"


SITE = r"regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
FOLDER = r"regexp_replace(regexp_extract(b, '^[^?#]*', 0), '(://[^/]*/(?:.*/)?)[^/]*$', '\1')"
EDGES = rf"""
no AS (SELECT DISTINCT {norm("url")} AS node, {HOST} AS host FROM pages WHERE url IS NOT NULL),
ho AS (SELECT node FROM (SELECT node, row_number() OVER (PARTITION BY host ORDER BY length(node), node) AS k FROM no) WHERE k = 1),
hr AS (SELECT b, regexp_replace(trim(h, ' '), '#.*$', '') AS c FROM (SELECT url AS b, unnest(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*>', 0), lambda t: {attribute("t", "href")})) AS h FROM pages)),
re AS (SELECT b, CASE WHEN c = '' THEN NULL WHEN regexp_matches(c, '(?i)^https?://') THEN c WHEN regexp_matches(c, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN starts_with(c, '//') THEN regexp_extract(b, '^[^:]*:', 0) || c WHEN starts_with(c, '/') THEN {SITE} || c WHEN starts_with(c, '?') THEN regexp_extract(b, '^[^?#]*', 0) || c
  ELSE CASE WHEN ends_with({FOLDER}, '/') THEN {FOLDER} ELSE {SITE} || '/' END || c END AS t FROM hr),
oc AS (SELECT src, node AS dst FROM (SELECT {norm("b")} AS src, {norm("t")} AS dst FROM re WHERE t IS NOT NULL AND regexp_extract(b, '://([^/?#]*)', 1) = regexp_extract(t, '://([^/?#]*)', 1)) JOIN (SELECT DISTINCT node FROM no) ON dst = node WHERE src <> node),
ed AS (SELECT DISTINCT * FROM oc)"""
# Steps from the home pages; no shortest path has more of them than there are pages.
DEPTHS = """bf(node, depth) AS (SELECT node, 0 FROM ho UNION SELECT dst, depth + 1 FROM bf JOIN ed ON src = bf.node WHERE depth < (SELECT count(*) FROM no)),
dp AS (SELECT node, min(depth) AS depth FROM bf GROUP BY node)"""

CUSTOMERS = """n AS (SELECT 'http://s' || c_custkey % 25 || '.example/c/' || c_custkey AS node, c_custkey AS k, c_custkey % 25 AS s FROM customer
  UNION ALL SELECT 'http://s' || c_custkey % 25 || '.example/list?a=1&b=' || c_custkey % 25, NULL, c_custkey % 25 FROM customer WHERE c_custkey < 25
  UNION ALL SELECT 'http://s' || c_custkey % 25 || '.example/lone/' || c_custkey, -1, c_custkey % 25 FROM customer WHERE c_custkey % 10 = 0),
l AS (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey % 3 = 0 THEN [25, 25, 50, -25] ELSE [25, 50, -25] END) + c_custkey AS t FROM customer UNION ALL SELECT -2 - c_custkey, c_custkey FROM customer WHERE c_custkey % 10 = 0),
e AS (SELECT n.node, k.c_custkey AS src FROM (SELECT t, k AS c_custkey FROM l) k JOIN n ON n.k = k.t AND k.t >= 0 UNION ALL SELECT n.node, c_custkey FROM customer JOIN n ON n.k IS NULL AND n.s = c_custkey % 25)"""
PARTS = """a AS (SELECT 'p' || p_partkey % 5 || '.example' AS owner, p_partkey AS k, p_name FROM part),
t AS (SELECT owner, k, unnest(['Product', 'Organization', 'Brand']) AS type FROM a UNION ALL SELECT owner, k, 'Offer' FROM a WHERE k % 4 = 0 UNION ALL SELECT owner, k, unnest(['BreadcrumbList', 'ListItem']) FROM a WHERE k % 2 = 0)"""

# Pages as title, headings, text and declared language: of the given table, and of the suppliers' pages as they are made.
GIVEN_ROWS = rf"""{PARSED}, r0 AS (SELECT url, host AS owner, {plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, list_transform(regexp_extract_all(h, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1), lambda x: {plain('x')}) AS hs,
 {plain("regexp_replace(c, '(?is)^.*?<body\\b[^>]*>', '')")} AS text, {attribute(r"regexp_extract(h, '(?is)<html\b[^>]*>', 0)", "lang")} AS lang FROM cl)"""
NATION_ROWS = """r0 AS (SELECT 'https://n' || s_nationkey || '.example/s/' || s_suppkey AS url, 'n' || s_nationkey || '.example' AS owner, ['en-US', 'de', ' DE -AT', '', 'pt-BR', 'fr', 'en'][s_suppkey % 7 + 1] AS lang,
 CASE WHEN s_nationkey % 3 = 0 THEN s_name || ' of supply chains ' ELSE '' END AS title, CASE WHEN s_nationkey % 3 = 0 THEN ['what does ' || s_name || ' cost'] ELSE ['what is it'] END AS hs, s_name || ' address delivers ' || s_name || ' delivers what' AS text FROM supplier)"""
TERMS = f"list_filter(list_transform({words('{0}')}, lambda x: lower(x)), lambda x: length(x) > {{1}} AND NOT list_contains({questions.BANNED}, x))"
TOPICS = f"""r1 AS (SELECT row_number() OVER () AS id, * FROM r0),
x1 AS (SELECT id, owner, {TERMS.format("s", 3)} AS t FROM (SELECT id, owner, unnest(list_concat(hs, [string_split(title, '|')[1]])) AS s FROM r1)),
y1 AS (SELECT id, owner, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS topic, 3 AS w FROM x1 UNION ALL SELECT id, owner, t[1], 1 FROM x1 WHERE len(t) = 1),
z1 AS (SELECT owner, topic, w FROM y1 UNION ALL SELECT owner, unnest({TERMS.format("text", 4)}), 1 FROM r1 WHERE owner NOT IN (SELECT owner FROM y1)),
tp AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY weight DESC, topic) AS rank FROM (SELECT owner, topic, sum(w)::BIGINT AS weight FROM z1 GROUP BY ALL) QUALIFY rank <= 12)"""
LANGUAGES = f"""l1 AS (SELECT owner, tag, count(*) AS n, min(url) AS first FROM (SELECT owner, url, CASE WHEN lang <> '' THEN lower(trim(split_part(lang, '-', 1), ' ')) END AS tag FROM r0) GROUP BY ALL),
lg AS (SELECT owner, CASE WHEN tag IN ({", ".join(map(q, questions.TEMPLATES))}) THEN tag ELSE 'it' END AS lang FROM l1 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY tag IS NULL, n DESC, first, tag) = 1)"""
QUESTIONS = f"""{TOPICS}, {LANGUAGES}, tm(lang, place, t) AS (VALUES {", ".join(f"({q(lang)}, {i}, {q(t)})" for lang, ts in questions.TEMPLATES.items() for i, t in enumerate(ts))})
SELECT owner, (rank - 1) * 3 + place + 1 AS n, replace(t, '{{}}', topic) AS query FROM tp JOIN lg USING (owner) JOIN tm USING (lang) WHERE (rank - 1) * 3 + place < 12"""

SQL = {
    "site_topics": f"WITH {GIVEN_ROWS}, {TOPICS} SELECT owner, topic, weight, rank FROM tp",
    "site_languages": f"WITH {GIVEN_ROWS}, {LANGUAGES} SELECT * FROM lg",
    "site_questions": f"WITH {GIVEN_ROWS}, {QUESTIONS}",
    "nation_languages": f"WITH {NATION_ROWS}, {LANGUAGES} SELECT * FROM lg",
    "nation_questions": f"WITH {NATION_ROWS}, {QUESTIONS}",
    "customer_redirects": """WITH h AS (SELECT 's' || c_custkey % 25 || '.example' AS owner, c_custkey % 5 AS k, bool_or(c_custkey % 25 < 10 AND c_custkey % 4 > 1) AS chains FROM customer GROUP BY ALL)
SELECT owner, 'tech.redirect.' || CASE k WHEN 0 THEN 'http_left' WHEN 1 THEN 'www_mixed' WHEN 2 THEN 'moved' ELSE 'none' END AS key, 'technical' AS area, CASE WHEN k < 3 THEN 'warning' ELSE 'ok' END AS severity, 1.0::DOUBLE AS weight FROM h
UNION ALL SELECT owner, 'tech.redirect.chains', 'technical', 'warning', 2.0 FROM h WHERE chains""",
    "part_lists": """WITH a AS (SELECT p_partkey, unnest([
  {'o': 0, 'kind': 'h', 'level': 2, 'text': 'List ' || p_partkey || ' & more'}, {'o': 1, 'kind': 'p', 'level': 0, 'text': p_name || ' short'},
  {'o': 2, 'kind': 'p', 'level': 0, 'text': repeat(p_name, 3) || ' and on tail ' || repeat(p_brand, 5)}, {'o': 3, 'kind': 'p', 'level': 0, 'text': repeat(p_name, 3) || ' and on'},
  {'o': 4, 'kind': 'p', 'level': 0, 'text': repeat(p_brand, 5)}, {'o': 5, 'kind': 'p', 'level': 0, 'text': repeat(p_name, 4)}], recursive := true) FROM part),
b AS (SELECT p_partkey, o, kind, level, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM a)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY o) - 1)::INT AS n, kind, level, text FROM b WHERE kind = 'h' OR length(text) >= 40""",
    "customer_in_degree": f"WITH {CUSTOMERS} SELECT n.node, count(src) AS links, count(DISTINCT src) AS sources FROM n LEFT JOIN e USING (node) GROUP BY n.node",
    "customer_orphans": f"""WITH {CUSTOMERS}, h AS (SELECT node FROM n QUALIFY row_number() OVER (PARTITION BY s ORDER BY length(node), node) = 1)
SELECT node FROM n ANTI JOIN e USING (node) ANTI JOIN h USING (node)""",
    "part_jsonld_types": f"WITH {PARTS} SELECT owner, type, count(DISTINCT k) AS pages FROM t GROUP BY owner, type QUALIFY row_number() OVER (PARTITION BY owner ORDER BY count(DISTINCT k) DESC, type) <= 12",
    "part_jsonld_missing": f"""WITH {PARTS} SELECT owner, type, count(*) AS checked,
 CASE type WHEN 'Product' THEN CASE WHEN bool_or(k % 5 = 0) THEN 'name' ELSE '' END WHEN 'Organization' THEN CASE WHEN bool_or(k % 7 <> 0) THEN 'url' ELSE '' END ELSE '' END AS missing,
 count(DISTINCT CASE WHEN type = 'Product' AND k % 5 = 0 OR type = 'Organization' AND k % 7 <> 0 THEN k END) AS pages FROM t WHERE type IN ('Product', 'Organization', 'BreadcrumbList') GROUP BY owner, type""",
    "page_heads": rf"""WITH r AS (SELECT url, {HOST} AS host, coalesce(html, '') AS h FROM pages),
t AS (SELECT *, regexp_extract_all(h, '(?is)<meta\b[^>]*>', 0) AS m, regexp_extract_all(h, '(?is)<link\b[^>]*>', 0) AS l, regexp_extract_all(h, '(?is)<img\b[^>]*>', 0) AS i FROM r)
SELECT url, host, {plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {attribute(r"regexp_extract(h, '(?is)<html\b[^>]*>', 0)", "lang")} AS lang,
 {meta("description")} AS description, lower({meta("robots")}) AS robots, lower({meta("bingbot")}) AS bingbot,
 {meta("og:title", "property")} AS og_title, {meta("og:description", "property")} AS og_description, {meta("og:image", "property")} AS og_image,
 coalesce({attribute("list_filter(l, lambda t: lower(" + attribute("t", "rel") + ") = 'canonical')[1]", "href")}, '') AS canonical,
 len(list_filter(l, lambda t: ({attribute("t", "hreflang")}) <> ''))::INT AS hreflangs, len(i)::INT AS images, len(list_filter(i, lambda t: trim({attribute("t", "alt")}, ' ') <> ''))::INT AS images_with_alt,
 len(regexp_extract_all(h, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>'))::INT AS headings FROM t""",
    "page_links": f"WITH {EDGES} SELECT * FROM ed",
    "page_depths": f"""WITH RECURSIVE {EDGES}, {DEPTHS}
SELECT CASE WHEN depth IS NULL THEN 'unreachable' WHEN depth > 3 THEN '4+' ELSE depth::VARCHAR END AS bucket, count(*) AS nodes FROM (SELECT DISTINCT node FROM no) LEFT JOIN dp USING (node) GROUP BY bucket""",
    "page_link_findings": f"""WITH RECURSIVE {EDGES}, {DEPTHS},
f AS (SELECT host AS owner, count(*) AS n, count_if(node NOT IN (SELECT dst FROM ed) AND node NOT IN (SELECT node FROM ho)) AS orphans, count_if(depth > 3) AS deep FROM no LEFT JOIN dp USING (node) GROUP BY host)
SELECT owner, 'tech.links.orphans' AS key, 'technical' AS area, CASE WHEN orphans > 0 THEN 'warning' ELSE 'ok' END AS severity, 1.0::DOUBLE AS weight FROM f WHERE n >= 2
UNION ALL SELECT owner, 'tech.links.deep', 'technical', 'warning', 1.0 FROM f WHERE n >= 2 AND deep > 0""",
    "page_in_degree": f"WITH {EDGES} SELECT n.node, count(dst) AS links, count(DISTINCT src) AS sources FROM (SELECT DISTINCT node FROM no) n LEFT JOIN oc ON dst = n.node GROUP BY n.node",
    "page_orphans": f"WITH {EDGES} SELECT DISTINCT node FROM no WHERE node NOT IN (SELECT dst FROM ed) AND node NOT IN (SELECT node FROM ho)",
    "extractable_paragraphs": rf"""WITH p AS (SELECT {HOST} AS owner, unnest(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: {plain('x')})) AS t FROM pages),
w AS (SELECT *, len(regexp_split_to_array(t, '\s+')) AS w FROM p), s AS (SELECT owner, count(*) AS paragraphs, count_if(w BETWEEN {site.EXTRACT_MIN} AND {site.EXTRACT_MAX}
 AND (regexp_matches(t, {q('(?i)' + site.DIRECT_ANSWER)}) OR regexp_matches(substring(t, 1, 90), {q('(?i)' + bounded(T.DEFINITION))})))::BIGINT AS direct FROM w WHERE w >= 10 GROUP BY owner)
SELECT *, round(direct / paragraphs, 4) AS share FROM s""",
    "page_topics": rf"""WITH h AS (SELECT coalesce(html, '') AS h FROM pages),
x AS (SELECT unnest(list_transform(regexp_extract_all(h, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1), lambda x: {plain('x')})) AS s FROM h
 UNION ALL SELECT string_split({plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '|')[1] FROM h),
t AS (SELECT list_filter(list_transform({words("s")}, lambda x: lower(x)), lambda x: length(x) > 3 AND NOT list_contains({BANNED}, x)) AS t FROM x),
y AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS topic, 3 AS w FROM t UNION ALL SELECT t[1], 1 FROM t WHERE len(t) = 1)
SELECT topic, sum(w)::BIGINT AS weight FROM y GROUP BY topic ORDER BY weight DESC, topic LIMIT 12""",
    "retrieval_findings": f"""WITH c AS ({OWN_SQL["retrieval_consensus"]}), a AS (SELECT avg(consensus) / 5 AS share, count_if(NOT covered) AS open, count(*) AS n FROM c)
SELECT 'rrf.consensus' AS key, 'retrieval' AS area, CASE WHEN share < 0.2 THEN 'critical' WHEN share < 0.45 THEN 'warning' ELSE 'ok' END AS severity, 2.0::DOUBLE AS weight FROM a WHERE n > 0
UNION ALL SELECT 'rrf.uncovered', 'retrieval', CASE WHEN open > 0 THEN 'critical' ELSE 'ok' END, CASE WHEN open > 0 THEN 2.0 ELSE 1.0 END FROM a WHERE n > 0
UNION ALL SELECT 'rrf.not_runnable', 'retrieval', 'critical', 2.0 FROM a WHERE n = 0""",
    "share_findings": f"""WITH f AS ({OWN_SQL["hybrid_top5"]}), s AS (SELECT query, source AS owner FROM f JOIN documents ON doc = doc_id), o AS (SELECT DISTINCT source AS owner FROM documents),
p AS (SELECT owner, count(*) AS slots, count(DISTINCT query) AS n FROM s GROUP BY owner),
r AS (SELECT o.owner, coalesce(slots, 0) AS slots, round(100 * coalesce(slots, 0) / (SELECT count(*) FROM s), 1) AS share, (SELECT count(DISTINCT query) FROM s) AS q, (SELECT count(DISTINCT query) FROM s) - coalesce(n, 0) AS lost, 100.0::DOUBLE / (SELECT count(*) FROM o) AS parity FROM o LEFT JOIN p ON o.owner IS NOT DISTINCT FROM p.owner)
SELECT owner, slots, share, lost, CASE WHEN share < parity / 2 THEN 'critical' WHEN share < parity THEN 'warning' ELSE 'ok' END AS share_severity,
 CASE WHEN lost = 0 THEN 'ok' WHEN 2 * lost > q THEN 'critical' ELSE 'warning' END AS lost_severity FROM r""",
    "share_map": f"""WITH v AS ({OWN_SQL["share_of_voice"]}), o AS (SELECT source AS owner, count(*) AS n FROM documents GROUP BY source)
SELECT o.owner, coalesce(v.share, 0.0)::DOUBLE AS share, round(coalesce(v.presence / nullif((SELECT count(DISTINCT item_id) FROM benchmark WHERE item_id % 20 = 0), 0), 0), 6)::DOUBLE AS presence,
 round(5 + 14 * sqrt(o.n / (SELECT max(n) FROM o)), 6) AS radius FROM o LEFT JOIN v ON o.owner IS NOT DISTINCT FROM v.owner""",
}
