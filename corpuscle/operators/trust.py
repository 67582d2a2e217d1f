"""Signals of trust and coverage over a site's pages: dates, authors, contacts, lifecycle of a topic, filler, acronyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import host, matches, slug, text_of, word_count
from corpuscle.operators.pages import all_of
from corpuscle.operators.site import FILLER_DENSITY, FILLER_HITS, attribute, graded, jsonld_nodes, meta, one_row_each, resolved

# Limits of the rules.
FRESH_DAYS, STALE_DAYS, SECTIONS_GOOD, FILLER_WORDS, ACRONYMS, OLDEST = 365, 730, 5, 50, 40, 5
# Pages of trust by the last part of their address, and addresses of mail.
ABOUT_SLUGS = ["chi-siamo", "chisiamo", "about", "about-us", "azienda", "la-nostra-storia", "il-team", "team", "storia"]
CONTACT_SLUGS = ["contatti", "contatto", "contact", "contacts", "contact-us", "dove-siamo"]
EMAIL = r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b"
# Acronyms that need no long form.
KNOWN_ACRONYMS = ["IVA", "SRL", "SPA", "PEC", "CAP", "IT", "EU"]
# The six sections of a full treatment, found in titles and headings.
LIFECYCLE = {
    "definizione": r"cos'?\s?[eè]|che\s+cos|definizion|cosa\s+significa|introduzion|what\s+is|definition|introduction|qu'?est[- ]ce|d[ée]finition|was\s+ist|qu[ée]\s+es|definici[oó]n",
    "storia": r"storia|origin|evoluzion|history|evolution|histoire|geschichte|ursprung|historia|evoluci[oó]n",
    "casi d'uso": r"casi\s+d'?uso|applicazion|a\s+cosa\s+serve|quando\s+serve|come\s+si\s+usa|use\s+case|application|how\s+to\s+use|cas\s+d'usage|utilisation|anwendung|einsatz|casos\s+de\s+uso|aplicacion|\busos\b",
    "limiti": r"limit|controindicazion|svantagg|criticit|rischi|drawback|\brisk|side\s+effect|contre[- ]indication|inconv[ée]nient|grenzen|nachteil|risiken|kontraindikation|l[ií]mite|limitacion|contraindicacion|riesgo|desventaj",
    "faq": r"\bfaq\b|domande\s+frequenti|domande\s+e\s+risposte|frequently\s+asked|foire\s+aux\s+questions|questions\s+fr[ée]quentes|h[äa]ufig\s+gestellte|h[äa]ufige\s+fragen|preguntas\s+frecuentes",
    "prospettive": r"prospettiv|futuro|tendenz|future|outlook|\btrend|avenir|perspective|tendance|zukunft|ausblick|perspectiva|tendencia",
}
# Formulas of marketing that say nothing.
FILLER = (
    r"leader\s+(?:di\s+mercato|del\s+settore)|soluzioni\s+innovative|a\s+360\s+gradi|scopri\s+di\s+pi[uù]|clicca\s+qui|leggi\s+tutto|contattaci\s+per"
    r"|richiedi\s+un\s+preventivo|iscriviti\s+alla\s+newsletter|seguici\s+su|senza\s+impegno|su\s+misura\s+per\s+te|qualit[aà]\s+e\s+professionalit[aà]"
    r"|al\s+(?:tuo|vostro)\s+servizio|punto\s+di\s+riferimento|vasta\s+gamma|market\s+leader|industry[- ]leading|cutting[- ]edge|best\s+in\s+class"
    r"|state\s+of\s+the\s+art|learn\s+more|click\s+here|read\s+more|contact\s+us\s+for|request\s+a\s+quote|sign\s+up\s+for|follow\s+us|one[- ]stop[- ]shop"
    r"|leader\s+du\s+march[ée]|[aà]\s+la\s+pointe|en\s+savoir\s+plus|cliquez\s+ici|contactez[- ]nous|demandez\s+un\s+devis|suivez[- ]nous|large\s+gamme"
    r"|marktf[üu]hrer|ma[ßs]geschneidert|erfahren\s+sie\s+mehr|klicken\s+sie\s+hier|kontaktieren\s+sie\s+uns|jetzt\s+anfragen|folgen\s+sie\s+uns|breites\s+sortiment"
    r"|l[ií]der\s+del\s+mercado|descubre\s+m[aá]s|haz\s+clic\s+aqu[ií]|cont[aá]ctanos|solicita\s+un\s+presupuesto|s[ií]guenos|amplia\s+gama"
)


def as_date(text: Column) -> Column:
    """The date a text begins with, as ``2026-01-31`` or wholly as ``20260131``; null where there is none."""
    t = F.substring(F.trim(text), 1, 10)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")).when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date"))


def declared(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url, author, dated, updated``, one row per url: is an author named, any date given, and the latest date that can be read.

    Both from meta tags and from all objects of the page's JSON-LD. Null urls are left out.
    """
    tags = all_of(text_of(html_col), r"(?is)<meta\b[^>]*>", 0)
    given = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), tags.alias("_m"))
    given = given.select("url", (meta(F.col("_m"), "author") != "").alias("author"), F.array(meta(F.col("_m"), "article:modified_time", "property"), meta(F.col("_m"), "article:published_time", "property")).alias("_d"))
    nodes = jsonld_nodes(pages, url_col, html_col).filter(F.col("url").isNotNull())
    prop = lambda k: F.coalesce(F.try_element_at("props", F.lit(k)), F.lit(""))
    nodes = nodes.select("url", (prop("author") != "").alias("author"), F.array(prop("dateModified"), prop("datePublished")).alias("_d"))
    # Properties are JSON text: of them only strings, in quotes, can be dates.
    said = given.withColumn("_s", F.col("_d"))
    nodes = nodes.withColumn("_s", F.transform("_d", lambda x: F.when(x.startswith('"'), F.regexp_replace(x, r'^"|"$', ""))))
    both = said.unionByName(nodes.filter(F.col("author") | F.exists("_d", lambda x: x != "")))
    return both.groupBy("url").agg(
        F.max("author").alias("author"),
        F.max(F.exists("_d", lambda x: x != "")).alias("dated"),
        F.max(F.array_max(F.transform("_s", as_date))).alias("updated"),
    )


def freshness(facts: DataFrame, today: Column) -> DataFrame:
    """``owner, key, area, severity, weight, updated, url, days, oldest``: age of a host's latest declared update; hosts without a date have no row.

    Of equal dates the greatest url counts; ``oldest`` are the five oldest pages as ``url (date)``.
    """
    rows = facts.filter("updated IS NOT NULL").select(host(F.col("url")).alias("owner"), "url", "updated")
    newest = rows.groupBy("owner").agg(F.max(F.struct("updated", "url")).alias("_n"))
    old = rows.withColumn("_k", F.row_number().over(Window.partitionBy("owner").orderBy("updated", "url"))).filter(F.col("_k") <= OLDEST)
    old = old.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("_k", "url", "updated"))).alias("_o"))
    days = F.datediff(today, F.col("_n.updated"))
    out = newest.join(old, "owner").withColumn("_d", days)
    d = F.col("_d")
    return out.select(
        "owner",
        F.when(d <= FRESH_DAYS, "sem.fresh.ok").when(d <= STALE_DAYS, "sem.fresh.stale").otherwise("sem.fresh.very_stale").alias("key"),
        F.lit("semantic").alias("area"),
        F.when(d <= FRESH_DAYS, "ok").otherwise("warning").alias("severity"),
        F.when(d > STALE_DAYS, 2.0).otherwise(1.0).alias("weight"),
        F.col("_n.updated").alias("updated"),
        F.col("_n.url").alias("url"),
        F.greatest(d, F.lit(0)).alias("days"),
        F.transform("_o", lambda x: F.concat(x["url"], F.lit(" ("), x["updated"].cast("string"), F.lit(")"))).alias("oldest"),
    )


def trust_findings(pages: DataFrame, facts: DataFrame, texts: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``owner, key, area, severity, weight``: author, dates, a page about the owner and a way to contact them, by host.

    Pages of trust count where they were read or are linked to on the same host; a contact
    is a link to a telephone or mailbox, a page, or an address of mail in a text.
    """
    links = F.transform(all_of(text_of(html_col), r"(?is)<a\b[^>]*>", 0), lambda t: F.trim(attribute(t, "href")))
    rows = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), host(F.col(url_col)).alias("owner"), links.alias("_l"))
    inside = F.filter(F.transform("_l", lambda t: resolved(F.col("url"), t)), lambda t: host(t) == F.col("owner"))
    parts = F.array_append(F.transform(inside, lambda t: F.lower(slug(t))), F.lower(slug(F.col("url"))))
    leads = lambda names: F.arrays_overlap("_p", F.array(*map(F.lit, names)))
    per = rows.withColumn("_p", parts).groupBy("owner").agg(
        F.max(leads(ABOUT_SLUGS)).alias("about"), F.max(leads(CONTACT_SLUGS) | F.exists("_l", lambda t: t.rlike(r"(?i)^(tel|mailto):"))).alias("contact"),
    )
    known = facts.groupBy(host(F.col("url")).alias("owner")).agg(F.max("author").alias("author"), F.max("dated").alias("dated"))
    mail = texts.groupBy(host(F.col("url")).alias("owner")).agg(F.max(F.col("text").rlike(EMAIL)).alias("mail"))
    per = per.join(known, "owner", "left").join(mail, "owner", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    one = F.lit(1.0)
    return one_row_each(per, [
        ("sem.eeat.author.missing", "semantic", graded(no(F.col("author")), "warning"), one),
        ("sem.eeat.dates.missing", "semantic", graded(no(F.col("dated")), "warning"), one),
        ("sem.eeat.about.missing", "semantic", graded(no(F.col("about")), "warning"), one),
        ("sem.eeat.contact.missing", "semantic", graded(no(F.col("contact")) & no(F.col("mail")), "warning"), one),
    ])


def any_matches(texts: str, pattern: str) -> Column:
    return F.exists(texts, lambda x: matches(x, pattern))


def topic_coverage(heads: DataFrame) -> DataFrame:
    """``owner, covered, missing, severity, weight``: which of the six sections the titles and headings (levels 1 to 4) of a host hold.

    Five are enough; a host without any title or heading has no row. ``missing`` is in the sections' order.
    """
    said = F.array_append(F.transform(F.filter("headings", lambda x: (x["level"] <= 4) & (x["text"] != "")), lambda x: x["text"]), F.col("title"))
    rows = heads.select(F.col("host").alias("owner"), F.filter(said, lambda x: x != "").alias("_t")).filter(F.size("_t") > 0)
    # One flag each: a group holds six booleans whatever its size.
    has = [F.max(any_matches("_t", p)).alias(f"_s{i}") for i, p in enumerate(LIFECYCLE.values())]
    per = rows.groupBy("owner").agg(*has)
    missing = F.filter(F.array(*[F.when(~F.col(f"_s{i}"), F.lit(name)) for i, name in enumerate(LIFECYCLE)]), lambda x: x.isNotNull())
    per = per.select("owner", (len(LIFECYCLE) - F.size(missing)).alias("covered"), F.concat_ws(", ", missing).alias("missing"))
    bad = F.col("covered") < SECTIONS_GOOD
    return per.select("*", F.when(bad, "warning").otherwise("ok").alias("severity"), F.when(F.col("covered") <= 2, 2.0).otherwise(1.0).alias("weight"))


def filler(texts: DataFrame) -> DataFrame:
    """``owner, pages, hits, saturated, severity, weight``: formulas of marketing in a host's texts of 50 words and more.

    A page is saturated with three hits and one in a hundred words. Hosts without such texts have no row.
    """
    rows = texts.select(host(F.col("url")).alias("owner"), word_count(F.col("text")).alias("_w"), F.regexp_count("text", F.lit("(?iu)" + FILLER)).alias("_h")).filter(F.col("_w") >= FILLER_WORDS)
    full = (F.col("_h") >= FILLER_HITS) & (F.col("_h") / F.col("_w") >= FILLER_DENSITY)
    per = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("pages"), F.sum("_h").cast("long").alias("hits"), F.count_if(full).alias("saturated"))
    return per.select("*", F.when(F.col("saturated") > 0, "warning").otherwise("ok").alias("severity"), F.when(F.col("saturated") > 0, 1.5).otherwise(1.0).alias("weight"))


def acronyms(texts: DataFrame, most: int = ACRONYMS) -> DataFrame:
    """``owner, acronym, expanded``: a host's first ``most`` words of two to six capitals, by url and place in the text.

    ``expanded`` is true where the acronym stands, anywhere on the host and be it as an end
    or start of a longer run of capitals, beside an opening bracket, a dash or a colon:
    every such run names its ends of two to six letters, which one join finds.
    """
    rows = texts.select(host(F.col("url")).alias("owner"), "url", "text")
    words = F.filter(all_of(F.col("text"), r"[\p{L}\p{N}_]+", 0), lambda x: x.rlike(r"^[A-Z]{2,6}$") & ~x.isin(KNOWN_ACRONYMS))
    found = rows.select("owner", "url", F.posexplode(words).alias("_at", "acronym")).groupBy("owner", "acronym").agg(F.min(F.struct("url", "_at")).alias("_first"))
    order = Window.partitionBy("owner").orderBy("_first", "acronym")
    found = found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    size = F.sequence(F.lit(2), F.lit(6))
    before = F.flatten(F.transform(all_of(F.col("text"), r"([A-Z]{2,})\s*[(—–:-]", 1), lambda x: F.transform(F.filter(size, lambda n: n <= F.char_length(x)), lambda n: F.substring(x, -n, n))))
    after = F.flatten(F.transform(all_of(F.col("text"), r"[(—–:-]\s*([A-Z]{2,})", 1), lambda x: F.transform(F.filter(size, lambda n: n <= F.char_length(x)), lambda n: F.substring(x, F.lit(1), n))))
    long = rows.select("owner", F.explode(F.array_union(before, after)).alias("acronym")).distinct().withColumn("_l", F.lit(True))
    return found.join(long, ["owner", "acronym"], "left").select("owner", "acronym", F.coalesce("_l", F.lit(False)).alias("expanded"))


def acronym_findings(found: DataFrame) -> DataFrame:
    """``owner, key, area, severity, weight``: are fewer than half of a host's acronyms given with their long form?"""
    per = found.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count_if("expanded").alias("long"))
    return one_row_each(per, [("lex.acronyms.bare", "lexical", graded(F.col("long") < F.col("n") / 2, "warning"), F.lit(1.0))])
