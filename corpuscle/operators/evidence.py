"""Findings of a second tool as evidence for one's own, labels from its audit details, and findings by page."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Audits of the other tool and the start of the keys of one's own findings that say the same.
SAME = {
    "document-title": "lex.title.",
    "meta-description": "lex.desc.",
    "image-alt": "lex.alt.",
    "html-has-lang": "tech.lang.",
    "html-lang-valid": "tech.lang.",
    "viewport": "tech.meta.viewport",
    "charset": "tech.meta.charset",
    "is-on-https": "tech.https.",
    "hreflang": "tech.hreflang.",
    "canonical": "tech.canonical.",
    "robots-txt": "tech.robots.",
    "is-crawlable": "tech.pages.noindex",
    "http-status-code": "tech.pages.broken",
    "link-text": "tech.links.generic_anchors",
    "llms-txt": "tech.llms.",
}
# The sentence that is added, and what is taken off a title before.
NOTE, TITLE_START = "Conferma Lighthouse: {title} (punteggio {score}/100).", "Lighthouse: "
# Items of an audit's details that are looked at, an item's fields in order of preference, a label's length.
ITEMS, FIELDS, LABEL = 3, ("url", "source", "label", "text", "origin"), 120


def merge_findings(own: DataFrame, other: DataFrame, same: Mapping[str, str] = SAME, owner: str = "owner") -> DataFrame:
    """``owner, place, key, severity, title, detail, confirmed``: own findings with the other tool's as evidence, then its unmatched ones.

    ``own``: owner, n, key, severity, title, detail; ``other`` the same with ``audit`` and
    ``score`` (0 to 1). An audit of ``same`` confirms the first own finding (by ``n``) whose
    key starts with its prefix, is not ok and not the other tool's; a sentence is added to
    its detail, in the other's order, and ``confirmed`` names the last audit. All others
    stay as they are, behind. A prefix join as an equi-join: each own key names the prefixes
    it starts with.
    """
    prefixes = F.array(*[F.lit(p) for p in sorted(set(same.values()))])
    named = own.filter((F.col("severity") != "ok") & ~F.col("key").startswith("lh.")).select(owner, "n", F.explode(F.filter(prefixes, lambda p: F.col("key").startswith(p))).alias("_p"))
    first = named.groupBy(owner, "_p").agg(F.min("n").alias("_n"))
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for pair in same.items() for x in pair]), F.col("audit"))
    matched = other.withColumn("_p", prefix).join(first, [owner, "_p"], "left")
    title = F.when(F.col("title").startswith(TITLE_START), F.expr(f"substring(title, {len(TITLE_START) + 1})")).otherwise(F.col("title"))
    note = F.lit(NOTE)
    for name, value in (("{title}", title), ("{score}", F.rint(F.coalesce("score", F.lit(0.0)) * 100).cast("long").cast("string"))):
        note = F.replace(note, F.lit(name), value)
    # An own finding gets one sentence for each audit of the table at most.
    notes = matched.filter("_n IS NOT NULL").groupBy(owner, F.col("_n").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("_o"), note.alias("_t"), F.col("audit").alias("_a")))).alias("_notes"))
    mine = own.join(notes, [owner, "n"], "left")
    added = F.array_join(F.transform("_notes", lambda x: x["_t"]), " ")
    detail = F.coalesce("detail", F.lit(""))
    text = F.when(F.col("_notes").isNull(), detail).when(detail == "", added).otherwise(F.trim(F.concat_ws(" ", detail, added)))
    columns = [owner, "_k", "n", "key", "severity", "title", "detail", "confirmed"]
    mine = mine.select(owner, F.lit(0).alias("_k"), "n", "key", "severity", "title", text.alias("detail"), F.element_at("_notes", -1)["_a"].alias("confirmed"))
    rest = matched.filter("_n IS NULL").select(owner, F.lit(1).alias("_k"), "n", "key", "severity", "title", detail.alias("detail"), F.lit(None).cast("string").alias("confirmed"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy("_k", "n", "key")).cast("long")
    return mine.select(columns).unionByName(rest.select(columns)).select(owner, place.alias("place"), "key", "severity", "title", "detail", "confirmed")


def item_labels(details: Column) -> Column:
    """The most telling label of each of the first three items of an audit's details (JSON text): its node's selector or snippet, else the first text field."""
    items = F.slice(F.coalesce(F.from_json(F.get_json_object(details, "$.items"), "array<string>"), F.array().cast("array<string>")), 1, ITEMS)

    def label(item: Column) -> Column:
        # Only text counts among the fields: a number or an object is passed over.
        texts = F.from_json(item, "map<string,variant>")
        field = lambda k: F.when(F.schema_of_variant(F.try_element_at(texts, F.lit(k))) == "STRING", F.try_variant_get(F.try_element_at(texts, F.lit(k)), "$", "string"))
        node = [F.nullif(F.get_json_object(item, f"$.node.{k}"), F.lit("")) for k in ("selector", "snippet")]
        return F.substring(F.coalesce(*node, *[F.nullif(field(k), F.lit("")) for k in FIELDS]), 1, LABEL)

    return F.filter(F.transform(F.filter(items, lambda x: x.startswith("{")), label), lambda x: x.isNotNull() & (x != ""))


def message_paths(reports: DataFrame, report_col: str = "report") -> DataFrame:
    """``url, path, message``: which message each text of a report came from, the report's map of messages inverted; of one path the last message wins."""
    paths = F.from_json(F.get_json_object(report_col, "$.i18n.icuMessagePaths"), "map<string,array<string>>")
    rows = reports.select("url", F.posexplode(F.map_entries(paths)).alias("_i", "_e")).select("url", "_i", F.col("_e.key").alias("message"), F.explode("_e.value").alias("_t"))
    rows = rows.select("url", "_i", "message", F.when(F.col("_t").startswith("{"), F.get_json_object("_t", "$.path")).otherwise(F.col("_t")).alias("path")).filter("path IS NOT NULL")
    return rows.groupBy("url", "path").agg(F.max_by("message", "_i").alias("message"))


def message_texts(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """``paths`` with ``text`` from ``messages`` (message, text); those with an open place (``{``) are not used."""
    usable = messages.filter((F.col("text") != "") & ~F.col("text").contains("{"))
    return paths.join(usable, "message", "left").select("url", "path", "message", "text")


def page_severities(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """``url, severity`` of every page that answered: critical, warning or ok, by the gravest finding that names its url or the url it led to.

    ``pages``: url, final_url, ok. An or-join as an equi-join: a page is looked up under both
    of its names; findings are reduced to one row for each url before.
    """
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1)
    grave = findings.filter((F.col("url") != "") & rank.isNotNull()).groupBy(F.col("url").alias("_as")).agg(F.max(rank).alias("_r"))
    names = F.array_distinct(F.filter(F.array("url", "final_url"), lambda x: x.isNotNull() & (x != "")))
    found = pages.filter("ok").select("url", F.explode_outer(names).alias("_as")).join(grave, "_as", "left").groupBy("url").agg(F.max("_r").alias("_r"))
    return found.select("url", F.when(F.col("_r") == 2, "critical").when(F.col("_r") == 1, "warning").otherwise("ok").alias("severity"))


def status_counts(pages: DataFrame, severities: DataFrame, by: Column) -> DataFrame:
    """``owner, clean, flagged, broken``: pages without and with a finding, and those that didn't answer."""
    good = severities.groupBy(by.alias("owner")).agg(F.count_if(F.col("severity") == "ok").alias("clean"), F.count_if(F.col("severity") != "ok").alias("flagged"))
    bad = pages.groupBy(by.alias("owner")).agg(F.count_if(~F.col("ok")).alias("broken"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return bad.join(good, "owner", "left").select("owner", zero("clean"), zero("flagged"), "broken")
