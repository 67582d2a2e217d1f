"""A site's pages together: head fields, the link graph, sections cut for retrieval, structured data, and findings over them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import defines, host, is_question, matches, norm_url, once, refers_back, slug, text_of, word_count
from corpuscle.operators.blocks import page_blocks
from corpuscle.operators.pages import all_of, attribute, meta, parse_pages, plain
from corpuscle.session import spread

# Limits of the rules.
DESC_MIN, DESC_MAX, ALT_SHARE, MANY_PAGES, CHUNKS_GOOD, ANAPHORA_SHARE, QUESTION_SHARE, DEFINITION_SHARE, EXAMPLE_SHARE, WIDE_VOCABULARY = 110, 165, 0.8, 5, 20, 0.2, 0.1, 0.1, 0.05, 300
EXTRACT_MIN, EXTRACT_MAX, EXTRACT_SHARE, FILLER_HITS, FILLER_DENSITY, CITATIONS_GOOD = 20, 120, 0.20, 3, 0.01, 3
# Slugs and phrases of pages that a system left as samples.
PLACEHOLDER_SLUGS = ["sample-page", "pagina-di-esempio", "hello-world", "lorem-ipsum", "test-page", "pagina-test", "coming-soon", "elementor"]
PLACEHOLDER = r"this is an example page|questa (?:e'|è) una pagina di esempio|welcome to wordpress|lorem ipsum dolor"
# Promises in titles and headings.
CLICKBAIT = (
    r"non\s+crederai|incredibile|scioccante|sconvolgente|devi\s+assolutamente|da\s+non\s+perdere|imperdibile|il\s+segreto\s+(?:di|del|della|dello|dei|degli|delle|per)"
    r"|i\s+segreti\s+(?:di|del|della|dello|dei|degli|delle|per)|la\s+verit[aà]\s+su|quello\s+che\s+non\s+ti\s+dicono|\d+\s+motivi\s+per"
    r"|you\s+won'?t\s+believe|shocking|unbelievable|mind[- ]blowing|the\s+secret\s+(?:of|to)|the\s+truth\s+about|\d+\s+reasons\s+why|what\s+they\s+don'?t\s+tell\s+you"
    r"|vous\s+ne\s+croirez\s+(?:pas|jamais)|incroyable|choquant|le\s+secret\s+(?:de|du|des|pour)|la\s+v[ée]rit[ée]\s+sur|[aà]\s+ne\s+pas\s+manquer|\d+\s+raisons"
    r"|du\s+wirst\s+nicht\s+glauben|unglaublich|schockierend|das\s+geheimnis|die\s+wahrheit\s+[üu]ber|\d+\s+gr[üu]nde,?\s+warum"
    r"|no\s+creer[aá]s|incre[ií]ble|impactante|el\s+secreto\s+(?:de|del|para)|la\s+verdad\s+sobre|\d+\s+razones\s+por|lo\s+que\s+no\s+te\s+cuentan|!{2,}"
)
# Openings that answer at once, examples, hints at questions and answers, source sections, citations.
DIRECT_ANSWER = r"^(?:s[iì]|no|yes|oui|non|ja|nein),\s|^(?:in\s+sintesi|in\s+breve|la\s+risposta\s+(?:e'|è)|in\s+short|in\s+summary|the\s+answer\s+is|en\s+r[ée]sum[ée]|en\s+bref|kurz\s+gesagt|zusammenfassend|en\s+resumen|en\s+pocas\s+palabras)\b|^\d+[.)]\s"
EXAMPLE = r"\b(?:ad\s+esempio|per\s+esempio|esempio|es\.|caso\s+studio|case\s+study|for\s+example|e\.g\.|par\s+exemple|p\.\s?ex\.|exemple|zum\s+beispiel|z\.\s?b\.|beispielsweise|por\s+ejemplo|p\.\s?ej\.|ejemplo)\b"
FAQ_HINT = r"\b(?:faq|domande\s+frequenti|domande\s+e\s+risposte|frequently\s+asked|foire\s+aux\s+questions|questions\s+fr[ée]quentes|h[äa]ufig\s+gestellte\s+fragen|h[äa]ufige\s+fragen|preguntas\s+frecuentes|preguntas\s+y\s+respuestas)\b"
REFERENCES = r"riferiment|bibliograf|sitograf|\bfonti\b|references|bibliography|\bsources\b|r[ée]f[ée]rences|quellen|literaturverzeichnis|\bliteratur\b|referencias|fuentes"
CITATION = r"\[\d{1,3}\]|\([A-ZÀ-Ý][a-zà-ÿ]+(?:\s+et\s+al\.?)?,?\s+(?:19|20)\d{2}\)"
# Least properties of structured types.
REQUIRED = {
    "Organization": ["name", "url"], "LocalBusiness": ["name", "address", "telephone"], "ProfessionalService": ["name", "address", "telephone"],
    "MedicalBusiness": ["name", "address", "telephone"], "MedicalClinic": ["name", "address", "telephone"], "FAQPage": ["mainEntity"], "BreadcrumbList": ["itemListElement"],
    "WebSite": ["name", "url"], "Article": ["headline", "datePublished", "author"], "BlogPosting": ["headline", "datePublished", "author"], "NewsArticle": ["headline", "datePublished", "author"],
    "Service": ["name", "provider"], "Person": ["name"], "Product": ["name"], "Review": ["author", "reviewRating"], "AggregateRating": ["ratingValue"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"], "Event": ["name", "startDate", "location"], "Recipe": ["name", "image"], "HowTo": ["name", "step"],
    "JobPosting": ["title", "datePosted", "hiringOrganization", "jobLocation"], "Course": ["name", "description", "provider"],
}
DATE_KEYS = ["datePublished", "dateModified", "uploadDate", "startDate", "endDate", "datePosted", "validThrough", "priceValidUntil"]
URL_KEYS = ["thumbnailUrl", "contentUrl", "embedUrl", "image", "logo"]
ENTITIES = ["Organization", "LocalBusiness", "ProfessionalService", "MedicalBusiness", "MedicalClinic"]


def page_heads(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """One row per page: what its head declares, its headings and images; attributes in any order and quotes. Null markup has none. ``keep`` names further columns."""
    h = text_of(html_col)
    rows = pages.select(*keep, F.col(url_col).alias("url"), h.alias("_h"), all_of(h, r"(?is)<meta\b[^>]*>", 0).alias("_m"), all_of(h, r"(?is)<link\b[^>]*>", 0).alias("_l"), all_of(h, r"(?is)<img\b[^>]*>", 0).alias("_i"))
    link = lambda rel: F.filter("_l", lambda t: F.lower(attribute(t, "rel")) == rel)
    head = all_of(F.col("_h"), r"(?is)(<h[1-6]\b[^>]*>.*?)</h[1-6]>", 1)
    return rows.select(
        *keep,
        "url",
        host(F.col("url")).alias("host"),
        plain(F.regexp_extract("_h", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        attribute(F.regexp_extract("_h", r"(?is)<html\b[^>]*>", 0), "lang").alias("lang"),
        meta(F.col("_m"), "description").alias("description"),
        F.lower(meta(F.col("_m"), "robots")).alias("robots"),
        F.lower(meta(F.col("_m"), "bingbot")).alias("bingbot"),
        meta(F.col("_m"), "og:title", "property").alias("og_title"),
        meta(F.col("_m"), "og:description", "property").alias("og_description"),
        meta(F.col("_m"), "og:image", "property").alias("og_image"),
        F.coalesce(attribute(F.get(link("canonical"), F.lit(0)), "href"), F.lit("")).alias("canonical"),
        F.size(F.filter("_l", lambda t: attribute(t, "hreflang") != "")).alias("hreflangs"),
        F.size("_i").alias("images"),
        F.size(F.filter("_i", lambda t: F.trim(attribute(t, "alt")) != "")).alias("images_with_alt"),
        F.transform(head, lambda x: F.struct(F.regexp_extract(x, r"(?i)^<h([1-6])", 1).cast("int").alias("level"), plain(x).alias("text"))).alias("headings"),
    )


def page_rows(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """:func:`page_heads` with ``slug`` and ``text`` of the page parser beside, in one projection of one scan."""
    parsed = parse_pages(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.col(html_col).alias("_markup")))
    return page_heads(parsed, "url", "_markup", ["slug", "text"])


#: Named character references that are decoded; numeric ones are by their number.
ENTITIES_BY_NAME = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014",
    "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "middot": "\u00b7", "bull": "\u2022", "euro": "\u20ac", "pound": "\u00a3", "deg": "\u00b0", "times": "\u00d7",
}


def decoded(text: Column) -> Column:
    """Character references as the characters they stand for; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES_BY_NAME.items() for x in pair])

    def one(part: Column) -> Column:
        whole = F.regexp_extract(part, r"^&#([0-9]{1,7});$", 1)
        code = F.when(whole != "", whole.cast("int")).otherwise(F.conv(F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1), 16, 10).cast("int"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.regexp_extract(part, r"^&([a-z]+);$", 1))
        return F.when(~part.startswith("&"), part).when(part.startswith("&#") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char).otherwise(F.coalesce(named, part))

    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)&#?\w{1,8};|[^&]+|&"), F.lit(0)), one)
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def without_dots(url: Column) -> Column:
    """An absolute url's path without ``.`` and ``..`` segments, folded from the left; ``..`` at the top stays there."""
    head, path, rest = (F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    parts = F.split(path, "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    above = lambda done: F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", above(done)).otherwise(F.concat(done, F.array(x))))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, F.array_join(folded, "/"), rest)).otherwise(url)


def resolved(base: Column, href: Column) -> Column:
    """An absolute url for a link on the page ``base``; null for fragments, mail, scripts and the like.

    Relative links lose their ``.`` and ``..`` segments, absolute ones stay as they are.
    """
    clean = F.regexp_replace(F.trim(href), r"#.*$", "")
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(://[^/]*/(?:.*/)?)[^/]*$", "$1")
    return (
        F.when(clean == "", None)
        .when(clean.rlike(r"(?i)^https?://"), clean)
        .when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), clean))
        .when(clean.startswith("/"), without_dots(F.concat(site, clean)))
        .when(clean.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), clean))
        .otherwise(without_dots(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(site, F.lit("/"))), clean)))
    )


def page_nodes(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``node, host``: the pages' normalised urls, each once."""
    return pages.filter(F.col(url_col).isNotNull()).select(norm_url(F.col(url_col)).alias("node"), host(F.col(url_col)).alias("host")).distinct()


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", alias_col: str | None = None) -> DataFrame:
    """``src, dst``: the links between pages of one host, a row for each occurrence, by normalised url.

    Links of a page to itself and to other hosts are left out. ``alias_col`` names a second
    url under which a page is known (where it was redirected to); a link to it counts for
    the page, unless a page has that url itself.
    """
    links = all_of(text_of(html_col), r"(?is)<a\b[^>]*>", 0)
    hrefs = F.filter(F.transform(links, lambda t: attribute(t, "href")), lambda h: h != "")
    # With explode Spark would work out all links once more, in a filter for rows that have any.
    out = pages.select(F.col(url_col).alias("_b"), F.explode_outer(hrefs).alias("_href")).filter("_href IS NOT NULL")
    out = out.select("_b", once(decoded(F.col("_href"))).alias("_href")).select("_b", once(resolved(F.col("_b"), F.col("_href"))).alias("_t"))
    netloc = lambda c: F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1)
    out = out.filter(netloc(F.col("_b")) == netloc(F.col("_t"))).select("_b", once(norm_url(F.col("_t"))).alias("_to")).select("_to", once(norm_url(F.col("_b"))).alias("src"))
    known = page_nodes(pages, url_col).select("node", F.col("node").alias("_as"), F.lit(0).alias("_k"))
    if alias_col:
        known = known.unionByName(pages.filter(F.col(alias_col).isNotNull()).select(norm_url(F.col(url_col)).alias("node"), norm_url(F.col(alias_col)).alias("_as"), F.lit(1).alias("_k")))
    known = known.groupBy("_as").agg(F.min_by("node", F.struct("_k", "node")).alias("node"))
    return out.join(known, out["_to"] == known["_as"]).select("src", F.col("node").alias("dst")).filter("src != dst")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", alias_col: str | None = None) -> DataFrame:
    """``src, dst``: :func:`page_links`, each pair once."""
    return page_links(pages, url_col, html_col, alias_col).distinct()


def homes(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host, node``: of each host's pages the one with the shortest, then smallest url."""
    return page_nodes(pages, url_col).groupBy("host").agg(F.min_by("node", F.struct(F.char_length("node"), "node")).alias("node"))


def sections(pages: DataFrame, url_col: str = "url", html_col: str = "html", target: int = 220, least: int = 15) -> DataFrame:
    """``url, heading, text, index, words``: a page's paragraphs and list items (as :func:`page_blocks` gives them) gathered under their heading.

    A heading opens a section; within it paragraphs are gathered until they hold ``target``
    words. Before the first heading the title stands for it, or the slug. Pieces of fewer
    than ``least`` words are left out after the numbering. A fold over the page's own blocks.
    """
    title = F.regexp_extract(text_of(html_col), r"(?is)<title[^>]*>(.*?)</title>", 1)
    named = pages.select(F.col(url_col).alias("url"), text_of(html_col).alias("_html"), F.coalesce(F.nullif(F.trim(F.regexp_replace(decoded(title), r"(?U)\s+", " ")), F.lit("")), slug(text_of(url_col))).alias("_title"))
    rows = page_blocks(named, "url", "_title", html_col="_html").withColumn("_b", F.transform("blocks", lambda b: F.struct((b["kind"] == "h").alias("head"), b["text"].alias("t"))))
    piece = "array<struct<heading:string,text:string,words:int>>"
    kind = f"struct<head:string,buf:string,words:int,done:{piece}>"
    def closed(s: Column) -> Column:
        return F.when(s["words"] > 0, F.concat(s["done"], F.array(F.struct(s["head"].alias("heading"), s["buf"].alias("text"), s["words"].alias("words"))))).otherwise(s["done"])

    def add(s: Column, b: Column) -> Column:
        n = s["words"] + F.size(F.split(b["t"], r"\s+"))
        text = F.when(s["buf"] == "", b["t"]).otherwise(F.concat_ws(" ", s["buf"], b["t"]))
        empty = lambda head, done: F.struct(head.alias("head"), F.lit("").alias("buf"), F.lit(0).alias("words"), done.alias("done")).cast(kind)
        grown = F.struct(s["head"].alias("head"), text.alias("buf"), n.alias("words"), s["done"].alias("done")).cast(kind)
        return F.when(b["head"], empty(b["t"], closed(s))).when(n >= target, empty(s["head"], F.concat(s["done"], F.array(F.struct(s["head"].alias("heading"), text.alias("text"), n.alias("words")))))).otherwise(grown)

    zero = F.struct(F.col("_title").alias("head"), F.lit("").alias("buf"), F.lit(0).alias("words"), F.array().cast(piece).alias("done")).cast(kind)
    out = rows.select("url", F.posexplode_outer(F.aggregate("_b", zero, add, closed)).alias("index", "p")).filter("p IS NOT NULL")
    return out.select("url", "p.heading", "p.text", F.col("index").cast("long").alias("index"), F.col("p.words").cast("long").alias("words")).filter(F.col("words") >= least)


def one_row_each(per: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """``owner, key, area, severity, weight`` from one row per owner: rules are (key, area, severity or null, weight)."""
    rows = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(area).alias("area"), severity.alias("severity"), weight.cast("double").alias("weight")) for key, area, severity, weight in rules])
    return per.select("owner", F.inline(rows)).filter("severity IS NOT NULL")


def graded(broken: Column, severity: str) -> Column:
    """``severity`` where ``broken``, else ok; null where ``broken`` is null: nothing to judge."""
    return F.when(broken, F.lit(severity)).when(~broken, F.lit("ok"))


def site_findings(rows: DataFrame) -> DataFrame:
    """``owner, key, area, severity, weight``: rules over all pages of a host.

    ``rows`` as by :func:`page_rows`; no text leaves its row. One aggregate by host
    evaluates all; titles are counted in one before it.
    """
    robots = F.when(F.col("bingbot") != "", F.col("bingbot")).otherwise(F.col("robots"))
    og = F.array("og_title", "og_description", "og_image")
    some_og = F.exists(og, lambda x: x != "")
    top = F.exists(F.filter("headings", lambda x: x["level"] <= 3), lambda x: matches(x["text"], CLICKBAIT))
    n = lambda c: F.count_if(c)
    per = rows.groupBy(F.col("host").alias("owner")).agg(
        n(F.lit(True)).alias("pages"), n(F.col("slug").isin(PLACEHOLDER_SLUGS) | matches(F.substring("text", 1, 2000), PLACEHOLDER)).alias("placeholder"),
        n(F.col("robots").contains("noindex")).alias("noindex"), n(robots.contains("noarchive")).alias("noarchive"), n(robots.contains("nocache") & ~robots.contains("noarchive")).alias("nocache"),
        n(~some_og).alias("no_og"), n(some_og & F.exists(og, lambda x: x == "")).alias("part_og"),
        n((F.col("description") != "") & (F.char_length("description") < DESC_MIN)).alias("short"), n(F.char_length("description") > DESC_MAX).alias("long"),
        n(matches(F.col("title"), CLICKBAIT) | top).alias("bait"), F.sum("images").alias("images"), F.sum("images_with_alt").alias("alt"),
        F.countDistinct(F.nullif(F.lower(F.regexp_extract("lang", r"^[A-Za-z]+", 0)), F.lit(""))).alias("langs"), F.sum("hreflangs").alias("hreflangs"),
    )
    titles = rows.filter("title != ''").groupBy(F.col("host").alias("owner"), "title").agg(F.count(F.lit(1)).alias("n")).groupBy("owner").agg(F.count_if(F.col("n") > 1).alias("dup"))
    per = per.join(titles, "owner", "left").withColumn("dup", F.coalesce("dup", F.lit(0)))
    one, two = F.lit(1.0), F.lit(2.0)
    size = F.when(F.col("pages") == 1, "critical").when(F.col("pages") < MANY_PAGES, "warning").otherwise("ok")
    return one_row_each(per, [
        ("tech.pages.count", "technical", size, F.when(F.col("pages") == 1, 3.0).when(F.col("pages") < MANY_PAGES, 2.0).otherwise(1.0)),
        ("tech.pages.placeholder", "technical", F.when(F.col("placeholder") > 0, "critical"), two),
        ("tech.pages.noindex", "technical", F.when(F.col("noindex") > 0, "warning"), one),
        ("tech.msft.noarchive", "technical", F.when(F.col("noarchive") > 0, "warning"), two),
        ("tech.msft.nocache", "technical", F.when(F.col("nocache") > 0, "info"), one),
        ("tech.msft.no_optout", "technical", F.when((F.col("noarchive") == 0) & (F.col("nocache") == 0), "ok"), one),
        ("tech.meta.og_missing", "technical", F.when(F.col("no_og") > 0, "warning"), one),
        ("tech.meta.og_partial", "technical", F.when(F.col("part_og") > 0, "warning"), one),
        ("tech.hreflang.missing", "technical", F.when((F.col("langs") > 1) & (F.col("hreflangs") == 0), "warning"), one),
        ("tech.hreflang.na", "technical", F.when(F.col("langs") <= 1, "info"), one),
        ("lex.desc.short", "lexical", F.when(F.col("short") > 0, "warning"), one),
        ("lex.desc.long", "lexical", F.when(F.col("long") > 0, "info"), one),
        ("lex.clickbait.found", "lexical", graded(F.col("bait") > 0, "warning"), F.when(F.col("bait") > 0, 1.5).otherwise(1.0)),
        ("lex.title.dup", "lexical", F.when(F.col("dup") > 0, "warning"), one),
        ("lex.alt.partial", "lexical", F.when(F.col("images") > 0, graded(F.col("alt") < ALT_SHARE * F.col("images"), "warning")), one),
    ])


def link_findings(edges: DataFrame, nodes: DataFrame, home: DataFrame, depth: DataFrame) -> DataFrame:
    """``owner, key, area, severity, weight``: orphans (never the home page) and pages over three clicks deep, of hosts with two pages and more."""
    into = edges.select(F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(True))
    start = home.select("node").withColumn("_home", F.lit(True))
    rows = nodes.join(into, "node", "left").join(start, "node", "left").join(depth.select("node", "depth"), "node", "left")
    per = rows.groupBy(F.col("host").alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_in").isNull() & F.col("_home").isNull()).alias("orphans"), F.count_if(F.col("depth") > 3).alias("deep"))
    return one_row_each(per.filter("n >= 2"), [
        ("tech.links.orphans", "technical", graded(F.col("orphans") > 0, "warning"), F.lit(1.0)),
        ("tech.links.deep", "technical", F.when(F.col("deep") > 0, "warning"), F.lit(1.0)),
    ])


def section_findings(pieces: DataFrame, rows: DataFrame, vocabulary: Column) -> DataFrame:
    """``owner, key, area, severity, weight``: rules over a host's sections, and headings and texts of its pages (``rows`` as by :func:`page_rows`); ``vocabulary`` is an array of a piece's tokens.

    A host without any section gets ``sem.chunks.none`` alone.
    """
    p = pieces.withColumn("owner", host(F.col("url")))
    per = p.groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(refers_back(F.trim("text"))).alias("anaphora"), F.count_if(defines(F.col("text"))).alias("defs"),
        F.count_if(matches(F.col("text"), EXAMPLE)).alias("examples"),
    )
    words = p.select("owner", F.explode(vocabulary).alias("w")).groupBy("owner").agg(F.countDistinct("w").alias("vocabulary"))
    h = rows.groupBy(F.col("host").alias("owner")).agg(
        F.sum(F.size("headings")).alias("heads"), F.sum(F.size(F.filter("headings", lambda x: is_question(x["text"])))).alias("questions"),
        F.max(F.exists("headings", lambda x: matches(x["text"], FAQ_HINT))).alias("faq"), F.max(F.exists("headings", lambda x: x["level"].between(2, 4) & matches(x["text"], REFERENCES))).alias("sources"),
        F.max(matches(F.substring("text", 1, 4000), FAQ_HINT)).alias("faq_text"), F.sum(F.regexp_count("text", F.lit(CITATION))).alias("citations"),
    )
    per = h.join(per, "owner", "left").join(words, "owner", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = lambda s: F.when(F.col("n") > 0, s)
    share = lambda c: F.col(c) / F.nullif(F.col("n"), F.lit(0))
    questions = F.coalesce(F.col("questions") / F.nullif(F.col("heads"), F.lit(0)), F.lit(0.0))
    one = F.lit(1.0)
    return one_row_each(per, [
        ("sem.chunks.none", "semantic", F.when(F.col("n") == 0, "critical"), F.lit(3.0)),
        ("sem.chunks.few", "semantic", some(graded(F.col("n") < CHUNKS_GOOD, "warning")), F.lit(2.0)),
        ("sem.anaphora.high", "semantic", some(graded(share("anaphora") > ANAPHORA_SHARE, "warning")), one),
        ("sem.questions.few", "semantic", some(graded(questions < QUESTION_SHARE, "critical")), F.when(questions < QUESTION_SHARE, 2.0).otherwise(1.0)),
        ("sem.faq.missing", "semantic", some(graded(~(F.col("faq") | F.coalesce("faq_text", F.lit(False))), "critical")), F.when(F.col("faq") | F.coalesce("faq_text", F.lit(False)), 1.0).otherwise(1.5)),
        ("sem.defs.low", "semantic", some(graded(share("defs") < DEFINITION_SHARE, "warning")), one),
        ("sem.examples.few", "semantic", some(graded(share("examples") < EXAMPLE_SHARE, "warning")), one),
        ("sem.vocab.narrow", "semantic", some(graded(F.coalesce("vocabulary", F.lit(0)) < WIDE_VOCABULARY, "warning")), one),
        ("sem.refs.missing", "semantic", some(graded(~(F.col("sources") | (F.coalesce("citations", F.lit(0)) >= CITATIONS_GOOD)), "warning")), one),
    ])


def extractable(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``owner, paragraphs, direct, share``: paragraphs of ten words and more, and those of 20 to 120 words that open with an answer or a definition."""
    par = F.filter(F.transform(all_of(text_of(html_col), r"(?is)<p\b[^>]*>(.*?)</p>"), plain), lambda x: F.size(F.split(x, r"\s+")) >= 10)
    rows = pages.select(host(F.col(url_col)).alias("owner"), F.explode(par).alias("t")).withColumn("w", F.size(F.split("t", r"\s+")))
    direct = F.col("w").between(EXTRACT_MIN, EXTRACT_MAX) & (matches(F.col("t"), DIRECT_ANSWER) | defines(F.substring("t", 1, 90)))
    out = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(direct).alias("direct"))
    return out.select("*", F.round(F.col("direct") / F.col("paragraphs"), 4).alias("share"))


def shallow(value: object) -> str:
    """A property as JSON text; one that is nested too deep to be written keeps only its kind."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return "[{}]" if isinstance(value, list) else '{"":{}}'


def jsonld_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url, block, types, props``: every object of the pages' JSON-LD, nested ones too, in document order; properties but null ones as JSON text. Blocks that don't parse, or nest deeper than a parser goes, give nothing."""
    scripts = F.filter(all_of(text_of(html_col), r"(?is)(<script\b[^>]*>.*?)</script>", 1), lambda s: F.lower(attribute(F.regexp_extract(s, r"(?is)^<script\b[^>]*>", 0), "type")) == "application/ld+json")
    rows = pages.select(F.col(url_col).alias("url"), F.posexplode_outer(scripts).alias("block", "_s")).filter("_s IS NOT NULL").select("url", "block", F.regexp_replace("_s", r"(?is)^<script\b[^>]*>", "").alias("_s"))

    def walk(top: object) -> Iterator[dict]:
        rest = [top]
        while rest:
            node = rest.pop()
            if isinstance(node, dict):
                yield node
                rest += reversed(node.values())
            elif isinstance(node, list):
                rest += reversed(node)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, block, text in zip(batch["url"], batch["block"], batch["_s"]):
                try:
                    data = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                for node in walk(data):
                    node = {str(k): v for k, v in node.items()}
                    kind = node.get("@type")
                    types = [kind] if isinstance(kind, str) else [str(x) for x in kind] if isinstance(kind, list) else []
                    out.append((url, block, types, {k: shallow(v) for k, v in node.items() if v is not None}))
            yield pd.DataFrame(out, columns=["url", "block", "types", "props"])

    return rows.mapInPandas(run, "url string, block int, types array<string>, props map<string,string>")


def jsonld_findings(nodes: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``owner, key, area, severity, weight``: inventory and quality of a host's structured data."""
    p = lambda k: F.try_element_at("props", F.lit(k))
    empty = lambda k: p(k).isNull() | p(k).isin('""', "0", "0.0", "-0.0", "false", "[]", "{}")
    bare = lambda k: F.regexp_replace(p(k), r'^"|"$', "")
    number = lambda k: F.expr(f"try_cast(regexp_replace(try_element_at(props, '{k}'), '^\"|\"$', '') AS double)")
    typed = lambda *t: F.arrays_overlap("types", F.array(*map(F.lit, t)))
    missing = F.lit(False)
    for t, keys in REQUIRED.items():
        missing = missing | (typed(t) & F.array_contains(F.array(*[empty(k) for k in keys]), True))
    missing = missing | (typed("ImageObject") & empty("contentUrl") & empty("url"))
    asked = F.from_json(F.when(p("mainEntity").startswith("["), p("mainEntity")).otherwise(F.concat(F.lit("["), p("mainEntity"), F.lit("]"))), "array<struct<name:string,acceptedAnswer:struct<text:string>>>")
    unanswered = typed("FAQPage") & F.coalesce(F.exists(asked, lambda x: F.coalesce(x["name"], F.lit("")).eqNullSafe("") | F.coalesce(x["acceptedAnswer"]["text"], F.lit("")).eqNullSafe("")), p("mainEntity").isNotNull())
    price = F.coalesce(bare("price"), bare("lowPrice"))
    offer = typed("Offer", "AggregateOffer") & F.when(price.isNull(), empty("priceSpecification")).otherwise(~price.rlike(r"^\d+(\.\d+)?$") | ~F.coalesce(bare("priceCurrency"), F.lit("")).rlike(r"^[A-Za-z]{3}$"))
    product = typed("Product") & empty("offers") & empty("review") & empty("aggregateRating")
    value, best, worst = number("ratingValue"), F.coalesce(number("bestRating"), F.lit(5.0)), F.coalesce(number("worstRating"), F.lit(1.0))
    rating = typed("AggregateRating", "Rating") & (F.coalesce((value < worst) | (value > best), F.lit(False)) | (typed("AggregateRating") & empty("reviewCount") & empty("ratingCount")))
    dates = F.array_contains(F.array(*[F.coalesce(p(k).startswith('"') & ~bare(k).rlike(r"^\d{4}-\d{2}-\d{2}([T ].+)?$"), F.lit(False)) for k in DATE_KEYS]), True)
    listed = lambda k: F.when(p(k).startswith('"'), F.array(bare(k))).when(p(k).startswith("["), F.from_json(p(k), "array<string>"))
    urls = F.array_contains(F.array(*[F.coalesce(F.exists(listed(k), lambda x: x.isNotNull() & (x != "") & ~x.rlike(r"^(https?://|[{\[])")), F.lit(False)) for k in URL_KEYS]), True)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    checked = typed(*REQUIRED, "Offer", "AggregateOffer", "ImageObject")
    per = nodes.withColumn("owner", host(F.col("url"))).groupBy("owner").agg(
        n(missing).alias("incomplete"), n(unanswered).alias("faq"), n(offer).alias("offers"), n(product).alias("product"), n(rating).alias("rating"), n(dates).alias("dates"), n(urls).alias("urls"), n(checked).alias("checked"),
        n(F.size("types") > 0).alias("typed"), n(typed(*ENTITIES)).alias("entities"), n(typed("FAQPage")).alias("t_faq"), n(typed("BreadcrumbList")).alias("t_crumbs"), n(typed("WebSite")).alias("t_site"),
        F.countDistinct(F.when(F.size("types") > 0, F.col("url"))).alias("with"),
    )
    sites = pages.groupBy(host(F.col(url_col)).alias("owner")).agg(F.countDistinct(url_col).alias("pages"))
    per = sites.join(per, "owner", "left").na.fill(0)
    some = lambda s: F.when(F.col("typed") > 0, s)
    one = F.lit(1.0)
    kinds = [("incomplete", "incomplete"), ("faq", "faq"), ("offers", "offers"), ("product", "product"), ("rating", "rating"), ("dates", "dates"), ("urls", "urls")]
    wrong = F.lit(False)
    for _, c in kinds:
        wrong = wrong | (F.col(c) > 0)
    return one_row_each(per, [
        ("sd.jsonld.none", "structured", F.when(F.col("typed") == 0, "critical"), F.lit(2.0)),
        ("sd.jsonld.ok", "structured", some(F.lit("ok")), one),
        ("sd.entity.missing", "structured", some(graded(F.col("entities") == 0, "critical")), F.when(F.col("entities") == 0, 1.5).otherwise(1.0)),
        ("sd.type.faqpage", "structured", some(F.when(F.col("t_faq") == 0, "warning")), one),
        ("sd.type.breadcrumblist", "structured", some(F.when(F.col("t_crumbs") == 0, "info")), one),
        ("sd.type.website", "structured", some(F.when(F.col("t_site") == 0, "info")), one),
        ("sd.jsonld.partial", "structured", some(F.when(F.col("with") < F.col("pages"), "warning")), one),
        *[(f"sd.check.{key}", "structured", some(F.when(F.col(c) > 0, "warning")), one) for key, c in kinds],
        ("sd.check.ok", "structured", some(F.when((F.col("checked") > 0) & ~wrong, "ok")), one),
    ])


def jsonld_types(nodes: DataFrame, most: int = 12, rows: int = 0) -> DataFrame:
    """``owner, type, pages``: each host's ``most`` types on the most pages, a page counted once; of equal ones the first by name.

    ``rows`` is about how many objects there are: so many that a task's share of their pages doesn't grow with them.
    """
    named = spread(nodes.select("url", F.explode(F.array_distinct("types")).alias("type")), rows, "url").distinct()
    per = named.groupBy(host(F.col("url")).alias("owner"), "type").agg(F.count("url").alias("pages"))
    order = Window.partitionBy("owner").orderBy(F.col("pages").desc(), "type")
    return per.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")


def jsonld_missing(nodes: DataFrame, rows: int = 0) -> DataFrame:
    """``owner, type, checked, missing, pages``: objects of the types with required properties, which of these any of them lacks (absent or empty), sorted, and on how many pages.

    ``rows`` is about how many objects there are, as in :func:`jsonld_types`.
    """
    required = F.create_map(*[x for t, keys in (REQUIRED | {"ImageObject": ["contentUrl"]}).items() for x in (F.lit(t), F.array(*map(F.lit, keys)))])
    asked = nodes.select("url", "props", F.explode("types").alias("type")).withColumn("_r", F.try_element_at(required, F.col("type"))).filter("_r IS NOT NULL")
    value = lambda k: F.coalesce(F.try_element_at(F.col("props"), k), F.lit('""'))
    instead = (F.col("type") == "ImageObject") & ~value(F.lit("url")).isin('""', "[]", "{}")
    lacks = F.when(instead, F.array().cast("array<string>")).otherwise(F.filter("_r", lambda k: value(k).isin('""', "0", "0.0", "-0.0", "false", "[]", "{}")))
    page = spread(asked.select("url", "type", lacks.alias("_l")), rows, "url").groupBy("url", "type", "_l").agg(F.count(F.lit(1)).alias("_n"))
    page = page.groupBy("url", "type").agg(F.sum("_n").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_l")))).alias("_l"))
    lacking = F.count_if((F.size("_l") > 0) & F.col("url").isNotNull())
    per = page.groupBy(host(F.col("url")).alias("owner"), "type").agg(F.sum("_n").alias("checked"), F.collect_set("_l").alias("_s"), lacking.alias("pages"))
    return per.select("owner", "type", "checked", F.array_sort(F.array_distinct(F.flatten("_s"))).alias("missing"), "pages")


def redirects(pages: DataFrame, url_col: str = "url", final_col: str = "final_url") -> DataFrame:
    """``pages`` with ``redirect``: http_left (only the scheme differs), www_mixed (only ``www.`` does), moved, or null where a page leads nowhere else.

    Urls are compared as normalised ones, schemes and hosts as they are written.
    """
    part = lambda c, i: F.regexp_extract(norm_url(F.col(c)), r"^([^:/?#]+)://([^/?#]*)(.*)$", i)
    (was, at, rest), (now, to, left) = ([part(c, i) for i in (1, 2, 3)] for c in (url_col, final_col))
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    www = (rest == left) & (at != to) & (bare(at) == bare(to))
    kind = F.when((was == now) & (at == to) & (rest == left), None).when((rest == left) & (at == to) & (was == "http") & (now == "https"), "http_left").when(www, "www_mixed").otherwise("moved")
    return pages.withColumn("redirect", F.when(F.coalesce(F.col(final_col), F.lit("")) != "", kind))


def redirect_findings(pages: DataFrame, owner: str = "owner", times_col: str = "redirects") -> DataFrame:
    """``owner, key, area, severity, weight``: redirects of each kind, chains of more than one, or that there are none (chains may stand beside)."""
    per = redirects(pages).groupBy(owner).agg(*[F.count_if(F.col("redirect") == k).alias(k) for k in ("http_left", "www_mixed", "moved")], F.count_if(F.coalesce(F.col(times_col), F.lit(0)) > 1).alias("chains"))
    per = per.withColumnRenamed(owner, "owner")
    one = F.lit(1.0)
    some = (F.col("http_left") > 0) | (F.col("www_mixed") > 0) | (F.col("moved") > 0)
    return one_row_each(per, [
        *[(f"tech.redirect.{k}", "technical", F.when(F.col(k) > 0, "warning"), one) for k in ("http_left", "www_mixed", "moved")],
        ("tech.redirect.chains", "technical", F.when(F.col("chains") > 0, "warning"), F.lit(2.0)),
        ("tech.redirect.none", "technical", F.when(~some, "ok"), one),
    ])


#: Pairs from which anchors are judged, and the share of distinct texts that is varied enough.
ANCHOR_PAIRS, ANCHOR_VARIETY = 10, 0.8


def anchor_pairs(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``owner, text, target``: distinct texts (lower case, three characters and more) and targets of links within a host."""
    whole = all_of(text_of(html_col), r"(?is)(<a\b[^>]*>.*?)</a>", 1)
    rows = pages.select(host(F.col(url_col)).alias("owner"), F.col(url_col).alias("_b"), F.explode_outer(whole).alias("_a")).filter("_a IS NOT NULL")
    tag = F.regexp_extract("_a", r"(?is)^<a\b[^>]*>", 0)
    rows = rows.select("owner", "_b", "_a", once(decoded(attribute(tag, "href"))).alias("_href"))
    rows = rows.select("owner", "_b", "_a", once(resolved(F.col("_b"), F.col("_href"))).alias("_t"))
    words = F.lower(F.trim(F.regexp_replace(decoded(F.regexp_replace(F.regexp_replace("_a", r"(?is)^<a\b[^>]*>", ""), r"(?s)<[^>]*>", " ")), r"(?U)\s+", " ")))
    netloc = lambda c: F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1)
    rows = rows.select("owner", "_b", "_t", once(words).alias("text")).filter((F.char_length("text") >= 3) & (netloc(F.col("_b")) == netloc(F.col("_t"))))
    return rows.select("owner", "text", norm_url(F.col("_t")).alias("target")).distinct()


def anchor_findings(pairs: DataFrame, varied: float = ANCHOR_VARIETY) -> DataFrame:
    """``owner, key, area, severity, weight, texts, pairs, ambiguous``: whether texts tell where links lead; below ten pairs nothing is judged."""
    per = pairs.groupBy("owner", "text").agg(F.count(F.lit(1)).alias("_n")).groupBy("owner").agg(F.count(F.lit(1)).alias("texts"), F.sum("_n").alias("pairs"), F.count_if(F.col("_n") > 1).alias("ambiguous")).filter(F.col("pairs") >= ANCHOR_PAIRS)
    good = F.col("texts") / F.col("pairs") >= varied
    return per.select("owner", F.when(good, "tech.anchors.varied").otherwise("tech.anchors.repetitive").alias("key"), F.lit("technical").alias("area"), F.when(good, "ok").otherwise("warning").alias("severity"), F.lit(1.0).alias("weight"), "texts", "pairs", "ambiguous")
