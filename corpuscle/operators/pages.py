"""Web pages to typed columns, passages and findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import BAD_SLUG, GENERIC_ANCHOR, SOFT_404, host, matches, slug, text_of, word_count

# Tags that divide a page by meaning.
SEMANTIC_TAGS = ["article", "section", "main", "aside", "details", "summary", "figure", "figcaption", "header", "footer", "nav"]
# Limits of the page rules.
TITLE_MIN, TITLE_MAX, THIN_WORDS, JS_WORDS, JS_SHARE, DIV_SHARE, MIN_ELEMENTS, MIN_SEMANTIC, SOFT_404_WORDS = 30, 65, 300, 120, 0.4, 0.5, 30, 2, 120


def plain(html: Column) -> Column:
    """Text without tags, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def all_of(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value whatever its quotes; empty without one."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def meta(tags: Column, name: str, key: str = "name") -> Column:
    """``content`` of the first of these meta tags whose ``key`` is ``name``; empty without one."""
    return F.coalesce(attribute(F.get(F.filter(tags, lambda t: F.lower(attribute(t, key)) == name), F.lit(0)), "content"), F.lit(""))


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with its metadata, text and counts, in column expressions over the markup.

    Counts of elements are taken before scripts and styles are removed, text after.
    """
    html = text_of(html_col)
    clean = html
    for tag in ("script", "style", "noscript", "svg"):
        clean = F.regexp_replace(clean, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    rows = pages.select("*", html.alias("_html"), clean.alias("_clean"))
    h, c = F.col("_html"), F.col("_clean")
    body = F.regexp_replace(c, r"(?is)^.*?<body\b[^>]*>", "")
    kinds = sum(((F.regexp_count(h, F.lit(rf"(?i)<{t}\b")) > 0).cast("int") for t in SEMANTIC_TAGS), F.lit(0))
    out = rows.select(
        *[x for x in pages.columns if x != html_col],
        host(F.col(url_col)).alias("host"),
        slug(F.col(url_col)).alias("slug"),
        plain(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        attribute(F.regexp_extract(h, r"(?is)<html\b[^>]*>", 0), "lang").alias("lang"),
        meta(all_of(h, r"(?is)<meta\b[^>]*>", 0), "description").alias("description"),
        F.coalesce(attribute(F.get(F.filter(all_of(h, r"(?is)<link\b[^>]*>", 0), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical")), F.lit(0)), "href"), F.lit("")).alias("canonical"),
        (F.regexp_count(h, F.lit(r"(?i)<meta[^>]*charset=")) > 0).alias("has_charset"),
        F.exists(all_of(h, r"(?is)<meta\b[^>]*>", 0), lambda t: F.lower(attribute(t, "name")) == "viewport").alias("has_viewport"),
        F.transform(all_of(c, r"(?is)<h1\b[^>]*>(.*?)</h1>"), plain).alias("h1"),
        F.transform(F.slice(all_of(c, r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>"), 1, 2), plain).alias("first_headings"),
        F.size(all_of(c, r"(?is)<p\b[^>]*>(.*?)</p>")).alias("paragraphs"),
        F.transform(all_of(c, r"(?is)<a\b[^>]*>(.*?)</a>"), lambda x: F.lower(plain(x))).alias("anchors"),
        F.regexp_count(h, F.lit(r"(?i)<img\b")).alias("images"),
        F.aggregate(all_of(h, r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(0), lambda s, x: s + F.char_length(x)).alias("script_chars"),
        kinds.alias("semantic_kinds"),
        F.regexp_count(h, F.lit(r"(?i)<div\b")).alias("divs"),
        F.regexp_count(h, F.lit(r"<[a-zA-Z]")).alias("elements"),
        (F.regexp_count(h, F.lit(r"(?i)application/ld\+json")) > 0).alias("has_jsonld"),
        F.char_length(h).alias("html_chars"),
        plain(body).alias("text"),
    )
    return out.withColumn("words", word_count(F.col("text")))


def dedupe_pages(parsed: DataFrame, url_col: str = "url", id_col: str | None = None) -> DataFrame:
    """Of pages with equal text the one with the shortest, then smallest url, of equal urls the one with the smallest ``id_col``; pages without text all stay.

    A page without a url comes last. The window compares the digest's bytes; only a digest, the url and the id are sorted.
    """
    keys = [F.char_length(url_col), F.col(url_col), *([F.col(id_col)] if id_col else [])]
    order = Window.partitionBy(F.sha2(F.col("text"), 256)).orderBy(*[k.asc_nulls_last() for k in keys])
    texts, empty = parsed.filter("text <> ''"), parsed.filter("text = ''")
    return texts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").unionByName(empty)


def page_rules(limits: Mapping[str, float] | None = None) -> list[tuple[str, str, str, float, Column]]:
    """(key, area, severity, weight, whether a page breaks it); ``limits`` as :func:`corpuscle.operators.limits.checked` gives them."""
    low, high, thin = (limits or {}).get("title_min", TITLE_MIN), (limits or {}).get("title_max", TITLE_MAX), (limits or {}).get("thin_words", THIN_WORDS)
    bare = F.col("title") == ""
    size = F.char_length("title")
    netloc = F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1))
    named = (netloc != "") & F.replace(F.lower(F.col("title")), F.lit("www."), F.lit("")).contains(netloc) & (size < high)
    head = F.concat_ws(" ", "title", "first_headings")
    return [
        ("lex.title.missing", "lexical", "critical", 2.0, bare),
        ("lex.title.bad", "lexical", "critical", 2.0, ~bare & (named | (size < low) | (size > high))),
        ("lex.h1.missing", "lexical", "critical", 1.5, F.size("h1") == 0),
        ("lex.h1.multi", "lexical", "warning", 1.0, F.size("h1") > 1),
        ("lex.words.thin", "lexical", "critical", 2.0, F.col("words") < thin),
        ("lex.slug.bad", "lexical", "warning", 1.0, F.col("slug").rlike(BAD_SLUG)),
        ("lex.desc.missing", "lexical", "critical", 1.5, F.col("description") == ""),
        ("tech.lang.missing", "technical", "warning", 1.0, F.col("lang") == ""),
        ("tech.meta.charset", "technical", "warning", 1.0, ~F.col("has_charset")),
        ("tech.meta.viewport", "technical", "warning", 1.0, ~F.col("has_viewport")),
        ("tech.canonical.missing", "technical", "warning", 1.0, F.col("canonical") == ""),
        ("tech.https.missing", "technical", "critical", 2.0, ~F.col("url").startswith("https://")),
        ("tech.links.generic_anchors", "technical", "info", 1.0, F.exists("anchors", lambda a: matches(a, GENERIC_ANCHOR))),
        ("tech.pages.soft404", "technical", "warning", 2.0, matches(head, SOFT_404) | ((F.col("words") <= SOFT_404_WORDS) & matches(F.substring("text", 1, 1500), SOFT_404))),
        ("tech.js.heavy", "technical", "critical", 2.0, (F.col("html_chars") > 0) & (F.col("words") < JS_WORDS) & (F.col("script_chars") > JS_SHARE * F.col("html_chars"))),
        ("sd.semantic.poor", "structured", "warning", 1.0, (F.col("elements") >= MIN_ELEMENTS) & (F.col("semantic_kinds") < MIN_SEMANTIC)),
        ("sd.semantic.divitis", "structured", "warning", 1.0, (F.col("elements") >= MIN_ELEMENTS) & (F.col("divs") > DIV_SHARE * F.col("elements"))),
        ("sd.jsonld.none", "structured", "critical", 2.0, ~F.col("has_jsonld")),
    ]


def findings(parsed: DataFrame, owner: str = "host", limits: Mapping[str, float] | None = None) -> DataFrame:
    """``owner, key, area, severity, weight, pages, example``: for each owner and rule one row; ``ok`` where no page breaks it.

    One aggregate over the pages evaluates all rules; its row is turned into one row for each rule.
    """
    rules = page_rules(limits)
    counts = [F.count_if(broken).alias(f"n{i}") for i, (*_, broken) in enumerate(rules)]
    first = [F.min(F.when(broken, F.col("url"))).alias(f"e{i}") for i, (*_, broken) in enumerate(rules)]
    per = parsed.groupBy(F.col(owner).alias("owner")).agg(*counts, *first)
    rows = F.array(*[
        F.struct(F.lit(key).alias("key"), F.lit(area).alias("area"), F.when(F.col(f"n{i}") > 0, F.lit(severity)).otherwise(F.lit("ok")).alias("severity"), F.lit(weight).alias("weight"), F.col(f"n{i}").alias("pages"), F.col(f"e{i}").alias("example"))
        for i, (key, area, severity, weight, _) in enumerate(rules)
    ])
    return per.select("owner", F.inline(rows))


def passages(docs: DataFrame, keys: Sequence[str], text_col: str = "text", target: int = 220, least: int = 15) -> DataFrame:
    """``keys, index, text, words``: consecutive lines gathered until they hold ``target`` words.

    Lines are never cut. Passages of fewer than ``least`` words are left out after the
    numbering, so numbers may have gaps. A fold over the row's own lines; nothing moves.
    """
    lines = F.transform(F.filter(F.split(text_of(text_col), r"\n+"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.trim(x).alias("t"), word_count(x).alias("w")))
    kind = "struct<buf:string,words:int,done:array<struct<text:string,words:int>>>"
    zero = F.struct(F.lit("").alias("buf"), F.lit(0).alias("words"), F.array().cast("array<struct<text:string,words:int>>").alias("done")).cast(kind)

    def add(state: Column, line: Column) -> Column:
        text = F.when(state["buf"] == "", line["t"]).otherwise(F.concat_ws(" ", state["buf"], line["t"]))
        words = state["words"] + line["w"]
        full = F.struct(F.lit("").alias("buf"), F.lit(0).alias("words"), F.concat(state["done"], F.array(F.struct(text.alias("text"), words.alias("words")))).alias("done")).cast(kind)
        return F.when(words >= target, full).otherwise(F.struct(text.alias("buf"), words.alias("words"), state["done"].alias("done")).cast(kind))

    folded = docs.select(*keys, F.aggregate(lines, zero, add).alias("s"))
    rest = F.when(F.col("s.buf") != "", F.array(F.struct(F.col("s.buf").alias("text"), F.col("s.words").alias("words")))).otherwise(F.array().cast("array<struct<text:string,words:int>>"))
    out = folded.select(*keys, F.posexplode(F.concat("s.done", rest)).alias("index", "p"))
    return out.select(*keys, F.col("index").cast("long").alias("index"), F.col("p.text").alias("text"), F.col("p.words").cast("long").alias("words")).filter(F.col("words") >= least)


def anchor_variety(pages: DataFrame, owner: str = "host", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``owner, texts, pairs, variety, ambiguous``: distinct link texts over distinct (text, target) pairs, and texts with several targets.

    Texts of fewer than three characters don't count. A menu that every page repeats counts once.
    """
    links = all_of(text_of(html_col), r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>', 0)
    rows = pages.select(host(F.col(url_col)).alias("owner"), F.explode(F.array_distinct(links)).alias("a"))
    pairs = rows.select("owner", F.lower(plain(F.col("a"))).alias("text"), F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("target")).filter(F.char_length("text") >= 3).distinct()
    per = pairs.groupBy("owner", "text").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("owner").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("pairs"), F.count_if(F.col("n") > 1).alias("ambiguous"))
    return out.select("owner", "texts", "pairs", F.round(F.col("texts") / F.col("pairs"), 3).alias("variety"), "ambiguous")


def visit_findings(visits: DataFrame, slow: float = 2.0) -> DataFrame:
    """``owner, key, severity, weight, pages, example``: pages that didn't answer, slow ones, and copies of others; only what was found.

    ``visits``: owner, url, status, error, elapsed (seconds), text. A page answered if its
    status is 200 and there is no error. A copy has another answering page's text.
    """
    good = F.coalesce((F.col("status") == 200) & (F.coalesce("error", F.lit("")) == ""), F.lit(False))
    rows = visits.select("owner", "url", good.alias("_ok"), "elapsed", F.when(good & (F.coalesce("text", F.lit("")) != ""), F.sha2("text", 256)).alias("_d"))
    # One row stays of each text; the rows of a text are counted, not gathered.
    copies = rows.filter("_d IS NOT NULL").groupBy("owner", "_d").agg((F.count(F.lit(1)) - 1).alias("_c"), F.max_by("url", F.struct(F.char_length("url"), F.col("url"))).alias("_u")).filter("_c > 0")
    copies = copies.groupBy("owner").agg(F.sum("_c").alias("n"), F.min("_u").alias("e")).select("owner", F.lit("tech.pages.duplicates").alias("key"), F.lit("warning").alias("severity"), F.lit(1.0).alias("weight"), F.col("n").alias("pages"), F.col("e").alias("example"))
    late = F.col("_ok") & (F.col("elapsed") > slow)
    per = rows.groupBy("owner").agg(F.count_if(~F.col("_ok")).alias("n0"), F.min(F.when(~F.col("_ok"), F.col("url"))).alias("e0"), F.count_if(late).alias("n1"), F.min(F.when(late, F.col("url"))).alias("e1"))
    kinds = [("tech.pages.broken", "critical"), ("tech.slow", "warning")]
    found = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("severity"), F.lit(1.0).alias("weight"), F.col(f"n{i}").alias("pages"), F.col(f"e{i}").alias("example")) for i, (k, s) in enumerate(kinds)])
    return per.select("owner", F.inline(found)).filter("pages > 0").unionByName(copies)
