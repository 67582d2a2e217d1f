"""Questions that a site should answer: its topics, the language it declares, templates of that language filled with its topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import tokenize

# Questions by language, the language of sites that declare none of these, and the questions' words, which are no topics.
TEMPLATES = {
    "it": ["cos'e' {}", "come funziona {}", "quanto costa {}"],
    "en": ["what is {}", "how does {} work", "how much does {} cost"],
    "fr": ["qu'est-ce que {}", "comment fonctionne {}", "combien coûte {}"],
    "de": ["was ist {}", "wie funktioniert {}", "was kostet {}"],
    "es": ["qué es {}", "cómo funciona {}", "cuánto cuesta {}"],
}
OTHERWISE = "it"
BANNED = [
    "cosa", "costa", "costo", "funziona", "funzionamento", "come", "quanto", "quali", "perche", "perché",
    "what", "does", "work", "much", "cost",
    "est", "que", "comment", "fonctionne", "combien", "coute", "coûte",
    "was", "ist", "wie", "funktioniert", "kostet",
    "qué", "cómo", "cuánto", "cuanto", "cuesta",
]


def site_topics(rows: DataFrame, banned: Sequence[str] = BANNED, most: int = 12) -> DataFrame:
    """``owner, topic, weight, rank``: each host's ``most`` heaviest topics from ``host, title, headings, text`` of its pages, ties by topic.

    In titles (up to a bar) and headings neighbouring terms of four characters and more
    count 3, a text's only term 1. A host whose titles and headings give nothing gets the
    terms of five characters and more of its texts, each time counted 1. Only pages that
    give no topic themselves can belong to such a host, so only their texts are taken
    apart; what leaves a page is summed by host and topic before it moves.
    """
    dropped = F.array(*map(F.lit, banned)) if banned else F.array().cast("array<string>")
    kind = "array<struct<topic:string,w:int>>"
    none = F.array().cast(kind)

    def terms(text: Column, least: int) -> Column:
        return F.filter(tokenize(text), lambda t: (F.char_length(t) > least) & ~F.array_contains(dropped, t))

    def named(t: Column) -> Column:
        last = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(t, F.lit(1), last), F.slice(t, F.lit(2), last), lambda a, b: F.struct(F.concat_ws(" ", a, b).alias("topic"), F.lit(3).alias("w")))
        return F.when(F.size(t) == 1, F.transform(t, lambda x: F.struct(x.alias("topic"), F.lit(1).alias("w")))).otherwise(pairs).cast(kind)

    title = F.get(F.split(F.coalesce("title", F.lit("")), r"\|"), F.lit(0))
    sources = F.concat(F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")), lambda h: F.coalesce(h["text"], F.lit(""))), F.array(title))
    own = rows.select(F.col("host").alias("owner"), F.flatten(F.transform(sources, lambda s: named(terms(s, 3)))).alias("_own"), F.coalesce("text", F.lit("")).alias("_text"))
    single = F.transform(terms(F.col("_text"), 4), lambda x: F.struct(x.alias("topic"), F.lit(1).alias("w"))).cast(kind)
    bare = F.size("_own") == 0
    found = own.select("owner", bare.alias("_bare"), F.explode(F.when(bare, single).otherwise(F.coalesce("_own", none))).alias("_x"))
    found = found.groupBy("owner", "_bare", "_x.topic").agg(F.sum("_x.w").alias("weight"))
    named_ = found.filter(~F.col("_bare"))
    rest = found.filter("_bare").alias("a").join(named_.select("owner").distinct().alias("b"), F.col("a.owner").eqNullSafe(F.col("b.owner")), "left_anti")
    order = Window.partitionBy("owner").orderBy(F.col("weight").desc(), "topic")
    every = named_.unionByName(rest).drop("_bare")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def site_languages(heads: DataFrame, supported: Sequence[str] = tuple(TEMPLATES), otherwise: str = OTHERWISE) -> DataFrame:
    """``owner, lang``: the primary subtag that most of a host's pages declare; of equals the one on the smallest url.

    A host that declares none, or mostly one that isn't ``supported``, gets ``otherwise``.
    """
    tag = F.lower(F.trim(F.get(F.split("lang", "-"), F.lit(0))))
    per = heads.select(F.col("host").alias("owner"), "url", F.when(F.coalesce("lang", F.lit("")) != "", tag).alias("_tag"))
    per = per.groupBy("owner", "_tag").agg(F.count(F.lit(1)).alias("_n"), F.min("url").alias("_first"))
    best = F.min_by("_tag", F.when(F.col("_tag").isNotNull(), F.struct(-F.col("_n"), F.col("_first"), F.col("_tag"))))
    per = per.groupBy("owner").agg(best.alias("_lang"))
    return per.select("owner", F.when(F.col("_lang").isin(*supported), F.col("_lang")).otherwise(F.lit(otherwise)).alias("lang"))


def site_questions(topics: DataFrame, languages: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, most: int = 12) -> DataFrame:
    """``owner, n, query``: every template of a host's language filled with every topic, by the topics' rank, then as the templates stand; the first ``most``."""
    known = F.create_map(*[x for lang, ts in templates.items() for x in (F.lit(lang), F.array(*map(F.lit, ts)))])
    rows = topics.alias("t").join(languages.alias("l"), F.col("t.owner").eqNullSafe(F.col("l.owner"))).select("t.owner", "topic", "rank", F.try_element_at(known, F.col("lang")).alias("_ts"))
    filled = rows.select("owner", "rank", F.size("_ts").alias("_k"), F.posexplode(F.transform("_ts", lambda t: F.replace(t, F.lit("{}"), F.col("topic")))).alias("_at", "query"))
    return filled.select("owner", ((F.col("rank") - 1) * F.col("_k") + F.col("_at") + 1).cast("long").alias("n"), "query").filter(F.col("n") <= most)
