"""Text and URL functions as column expressions; nothing here runs Python for a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a token starts with a letter or digit and goes on with these, apostrophes and hyphens.
TOKEN = r"[a-zA-Zà-ÿÀ-Ÿ0-9][a-zA-Zà-ÿÀ-Ÿ0-9'’\-]*"

# Openings of a question.
QUESTION_STARTERS = [
    "cosa", "che cos", "come", "quando", "perche", "perche'", "quanto", "quanti", "quante", "quale", "quali", "chi", "dove", "conviene",
    "what", "how", "when", "why", "which", "who", "where", "is", "are", "can", "does", "do",
    "comment", "pourquoi", "combien", "quel", "quelle", "quels", "quelles", "qu'est", "est-ce", "où",
    "wie", "was", "warum", "wann", "welche", "welcher", "welches", "wer", "wo", "ist", "sind", "kann",
    "cómo", "cuándo", "cuánto", "cuánta", "cuántos", "cuál", "cuáles", "quién", "dónde", "qué", "que es", "por que", "por qué", "puede",
]

# Patterns, all without regard to case.
DEFINITION = (
    r"\b(?:e'|è)\s+(?:un|una|uno|il|la|lo|l')\b|\bsi\s+tratta\s+di\b|\bconsiste\s+(?:in|nel|nella)\b|\bsi\s+definisce\b|\bsignifica\b"
    r"|\bis\s+a\b|\brefers\s+to\b|\bmeans\b|\best\s+(?:un|une|le|la|l')\b|\bil\s+s'agit\s+de\b|\bconsiste\s+(?:à|en)\b|\bsignifie\b|\bdésigne\b"
    r"|\bist\s+(?:ein|eine|der|die|das)\b|\bbezeichnet\b|\bbedeutet\b|\bversteht\s+man\b|\bhandelt\s+es\s+sich\s+um\b"
    r"|\bes\s+(?:un|una|el|la)\b|\bse\s+trata\s+de\b|\bconsiste\s+en\b|\bse\s+define\s+como\b"
)
ANAPHORA = (
    r"^(?:questo|questa|questi|queste|cio'|ciò|esso|essa|essi|esse|tale|tali|lo\s+stesso|la\s+stessa|quest'|it|this|that|these|those|they|he|she|such"
    r"|cela|celui|celle|celles|ceux|ce\s+dernier|cette\s+derni[èe]re|dies|diese|dieser|dieses|diesem|diesen|derselbe|dieselbe|solche|solcher|solches"
    r"|esto|esta|este|estos|estas|eso|esa|ese|esos|esas|ello|dicho|dicha|dichos|dichas|el\s+mismo|la\s+misma)\b"
)
SOFT_404 = r"pagina non (?:e'|è|e|é)?\s*(?:stata\s+)?trovata|contenuto non trovato|nessun risultato|page (?:was\s+)?not found|nothing (?:was\s+)?found|error(?:e)?\s*404|\b404\b"
GENERIC_ANCHOR = r"^(?:clicca qui|click here|qui|link|vai|continua|leggi tutto|leggi di pi[uù]['’]?|read more|scopri di pi[uù]['’]?|maggiori informazioni|per saperne di pi[uù]['’]?)\.?$"
BAD_SLUG = r"[_%]|\d{4,}"
DAYS_OF_WORK = r"testo scarso|superficie|poche pagine|nessuna pagina|chunk|consenso|share of voice|query senza|vinte interamente|contenut|faq|orfan|profondit|vocabolario|autoconsist|molto javascript|heading in forma|definizion|esemp|ciclo di vita"
MINUTES_OF_WORK = r"robots\.txt|sitemap|llms\.txt|noindex|canonical|title|descript|segnaposto|senza attributo lang|hreflang|\balt\b|contenuto identico|crawler ia bloccat|slug|noarchive|nocache|copilot|clickbait|charset|viewport|open graph"


def text_of(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))


def tokenize(text: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Lower-cased tokens in order; with ``stopwords`` these and tokens of up to two characters are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    if stopwords is None:
        return found
    dropped = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(found, lambda t: (F.char_length(t) > 2) & ~F.array_contains(dropped, t))


def once(value: Column) -> Column:
    """``value`` as a column that is computed once for a row: Spark copies a plain expression into every filter that it draws from it, this it doesn't. One of them in a select."""
    return F.explode_outer(F.array(value))


def word_count(text: Column) -> Column:
    """Number of tokens: all but their first characters is taken out, so that none becomes a value of its own."""
    first = TOKEN[: TOKEN.index("]") + 1]
    rest = TOKEN[len(first) : -1]
    return F.coalesce(F.char_length(F.regexp_replace(text, f"[^{first[1:-1]}]*+(?:({first}){rest}*+)?", "$1")), F.lit(0)).cast("int")


def squeezed(text: Column) -> Column:
    """Lower-cased, white space as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " ")


def char_ngrams(rows: DataFrame, keys: list[str], text_col: str = "text", size: int = 4) -> DataFrame:
    """``keys, gram``: overlapping runs of ``size`` characters of the squeezed text; of a shorter text the whole; of an empty one none.

    One pass of a pattern that looks ahead names all runs; it never starts in the middle of
    a character beyond the basic plane.
    """
    texts = rows.select(*keys, squeezed(text_of(text_col)).alias("_s")).filter("_s <> ''")
    runs = F.regexp_extract_all("_s", F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{size - 1}}}))"), F.lit(1))
    return texts.select(*keys, F.explode(F.when(F.char_length("_s") < size, F.array("_s")).otherwise(runs)).alias("gram"))


def is_question(text: Column) -> Column:
    """Ends in a question mark, or starts as questions do (no word boundary is asked for)."""
    most = max(map(len, QUESTION_STARTERS))
    # Only the opening is lower-cased; an expression that always matches at the start never looks at the rest.
    opening = F.lower(F.regexp_extract(F.trim(text), rf"(?s)^[¿¡ ]*+(.{{0,{most}}})", 1))
    return F.rtrim(text).endswith("?") | F.exists(F.array(*map(F.lit, QUESTION_STARTERS)), lambda s: opening.startswith(s))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?iu)" + pattern)


def defines(text: Column) -> Column:
    """:data:`DEFINITION`, whose alternatives are tried only where one of their first letters, or a character beyond Latin-1 that may fold to one, opens a word."""
    return text.rlike(r"(?=[b-eB-EhHiImMrRsSvVèÈ\x{100}-\x{10FFFF}])\b(?iu:" + DEFINITION.removeprefix(r"\b").replace(r"|\b", "|") + ")")


def refers_back(text: Column) -> Column:
    """:data:`ANAPHORA`, which stands at the start: with an empty alternative the rest is not looked at."""
    return F.regexp_extract(text, "(?iu)^(?:(" + ANAPHORA.removeprefix("^") + ")|)", 1) != ""


def norm_url(url: Column) -> Column:
    """Without fragment and without one closing slash of a path longer than ``/``; an empty path is ``/``; the query stays."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([^:/?#]+://[^/?]*)", 1)
    path = F.regexp_extract(bare, r"^[^:/?#]+://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    path = F.when(path == "", F.lit("/")).when(F.char_length(path) > 1, F.regexp_replace(path, r"/$", "")).otherwise(path)
    return F.concat(head, path, F.when(query == "?", F.lit("")).otherwise(query))


def host(url: Column) -> Column:
    """Lower-cased, without scheme, port, path and leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[^:/?#]+://)?([^/?#:]*)", 1)), r"^www\.", "")


def slug(url: Column) -> Column:
    """Last part of the path without closing slashes, or ``/``."""
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:/?#]+://[^/]*(.*)$", 1), r"^/+|/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(last == "", F.lit("/")).otherwise(last)


def effort(title: Column, fix: Column) -> Column:
    """Days, minutes or hours of work, in this order of precedence."""
    text = F.concat_ws(" ", title, fix)
    return F.when(matches(text, DAYS_OF_WORK), F.lit("days")).when(matches(text, MINUTES_OF_WORK), F.lit("minutes")).otherwise(F.lit("hours"))


def finding_key(area: Column, title: Column) -> Column:
    """A finding's name across runs: numbers in its title don't count."""
    return F.concat_ws("|", area, F.regexp_replace(title, r"\d+", "N"))


def finding_anchor(area: Column, title: Column) -> Column:
    """A finding's name in a document: lower case, numbers as n, at most 70 letters; repeats are told apart by :func:`numbered_anchors`."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", area, F.regexp_replace(title, r"[0-9]+", "n"))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(slug, 1, 70), r"-+$", "")
    return F.concat(F.lit("r-"), F.when(cut == "", "rilievo").otherwise(cut))


def numbered_anchors(findings: DataFrame, by: str, order: str) -> DataFrame:
    """``findings`` (area, title) with ``anchor``; within ``by`` the second of one name, by ``order``, gets -2 and so on."""
    named = findings.withColumn("anchor", finding_anchor(F.col("area"), F.col("title")))
    k = F.row_number().over(Window.partitionBy(by, "anchor").orderBy(order))
    return named.withColumn("_k", k).withColumn("anchor", F.when(F.col("_k") > 1, F.concat_ws("-", "anchor", F.col("_k").cast("string"))).otherwise(F.col("anchor"))).drop("_k")


def score_verdict(score: Column) -> Column:
    """Good from 70, to be improved from 40, else critical; null without a score. Fixed values."""
    return F.when(score >= 70, "Buono").when(score >= 40, "Da migliorare").when(score.isNotNull(), "Critico")


def passage_label(url: Column, heading: Column) -> Column:
    """A passage's name: its path and the first 60 characters of its heading. The sign between them and the words for no heading."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    head = F.coalesce(F.nullif(heading, F.lit("")), F.lit("(senza heading)"))
    return F.concat(F.when(path == "", "/").otherwise(path), F.lit("  \u00b7  "), F.substring(head, 1, 60))
