"""DuckDB SQL for the queries that SQL can express."""

from corpuscle.llm.license_scan import LOWER, PHRASES, SPREAD, TEMPLATES, THRESHOLD, UPPER
from corpuscle.llm.secret_scan import BASE, RULES

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT) AS w
  FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank
  FROM c
), l AS (SELECT *, (total - before) / rest AS level FROM o),
f AS (SELECT min(rank) AS first_open, min_by(level, rank) AS level FROM l WHERE level * w <= cap),
t AS (
  SELECT l.source, source_size, CASE WHEN first_open IS NULL OR rank < first_open THEN cap ELSE f.level * w END AS target
  FROM l, f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS base FROM t
), g AS (SELECT *, target - base * source_size AS budget FROM b),
r AS (
  SELECT d.*, source_size, target, base, budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
         sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), e AS (SELECT *, min(CASE WHEN upto > budget THEN h END) OVER (PARTITION BY source) AS edge FROM r),
x AS (SELECT *, CASE WHEN budget <= 0 THEN 0 WHEN edge IS NULL OR h < edge THEN 1
              WHEN h = edge AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END AS more FROM e)
SELECT doc_id, size, source_size, target, size * (base + more) AS taken, base + more AS copies, source, h AS place FROM x
"""

OP10 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept,
       sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""

OP9 = r"""
WITH r AS (SELECT row_number() OVER () AS k, page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
p AS (
  SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM r
), q AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)='))) AS kept,
         len(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)='))) > 0 AS tracked
  FROM p
), c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical
  FROM q
), l AS (SELECT DISTINCT canonical FROM c WHERE tracked AND canonical <> ''),
v(verdict, rule, rh, rp) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
b AS (
  SELECT c.*, v.verdict, v.rule, row_number() OVER (PARTITION BY k ORDER BY length(v.rule) DESC) AS n
  FROM c LEFT JOIN v ON (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       b.canonical, l.canonical IS NOT NULL AS listed
FROM b LEFT JOIN l ON b.canonical = l.canonical WHERE n = 1
"""


def op4() -> str:
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    phrases = ", ".join(f"('{label}', {list(words)})" for label, words in PHRASES)
    return rf"""
WITH t(label, words) AS (SELECT a, list_distinct(string_split(b, ' ')) FROM (VALUES {templates}) v(a, b)),
p(label, words) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), w AS (SELECT k, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
h AS (
  SELECT k, label, unnest(range(len(w))) AS i, w, words FROM w JOIN p ON list_has_all(w, words)
), b AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base
  FROM h WHERE list_slice(w, i + 1, i + len(words)) = words GROUP BY k
), l AS (SELECT k, label, words, w FROM w JOIN t ON len(list_intersect(words, w)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
s AS (SELECT k, label, words, w, unnest(range(len(w))) AS i FROM l),
c AS (
  SELECT k, label, len(list_intersect(words, list_slice(w, i + 1, i + {SPREAD} * len(words)))) AS n, len(words) AS of
  FROM s WHERE list_contains(words, w[i + 1])
),
m AS (SELECT k, list(DISTINCT label) AS found, max(n / of) AS best FROM c WHERE n >= ceil({THRESHOLD} * of - 1e-9) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN m USING (k)
"""


OP11 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS id FROM t),
h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM c
), r AS (
  SELECT h.conv_id, 0 AS late, n, role, text FROM h JOIN t ON t.conv_id = h.base WHERE n <= h
  UNION ALL
  SELECT h.conv_id, 1, n, role, text FROM h JOIN t ON t.conv_id = h.conv_id WHERE n > h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS len,
         md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER w) AS k
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY late, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM h
), q AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
nodes AS (
  SELECT k, any_value(up) AS up, any_value(depth) AS depth, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
  FROM q GROUP BY k
), kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
pairs AS (SELECT DISTINCT a.k AS a, b.k AS b FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT a, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((nodes.n - 1) * len)::BIGINT AS saved
  FROM pairs JOIN nodes ON b = k LEFT JOIN kids ON kids.up = b GROUP BY a
)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       n_leaves, saved AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN sums ON a = nodes.k LEFT JOIN nodes above ON above.k = nodes.up LEFT JOIN kids ON kids.up = nodes.k
"""

def op13() -> str:
    """Matches of each rule with the texts between them, whose lengths give the places."""

    def quoted(text: str) -> str:
        return text.replace("'", "''")

    kinds = ", ".join(f"('{r.kind}', {i}, {r.least}, {str(i < len(BASE)).lower()})" for i, r in enumerate(RULES))
    found = " UNION ALL ".join(f"SELECT k, '{r.kind}' AS kind, regexp_extract_all(t, '{quoted(r.pattern)}') AS m, regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS g, string_split_regex(t, '{quoted(r.pattern)}') AS between FROM d" for r in RULES)
    return f"""
WITH kinds(kind, rank, least, base) AS (VALUES {kinds}),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (
  SELECT k, kind, rank, base, m[i] AS part,
         (list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM e JOIN kinds USING (kind) WHERE length(g[i]) >= least
), n AS (SELECT *, kind || ':' || start || ':' || (start + length(part)) AS span FROM s),
a AS (
  SELECT k, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE base) AS base_spans, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM n GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, upper(sha256(t)) AS blob
FROM d LEFT JOIN a USING (k)
"""


SQL = {"op4_license_scan": op4(), "op8_mixing": OP8, "op9_url_filter": OP9, "op10_exact_dedup": OP10, "op11_prefix_trie": OP11, "op13_secret_scan": op13()}
