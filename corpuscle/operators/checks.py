"""Checks of the retrieval's outcome from outside: a sample to judge, judges' answers, places in a search engine's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.scores import tenths

#: Passages that are judged.
MOST = 5


def judge_sample(fused: DataFrame, chunks: DataFrame, most: int = MOST) -> DataFrame:
    """``id, query, label, heading, text``: the first passage of each query's fused list, each once, up to ``most``, numbered from 1.

    ``fused``: query_n, query, rank, label; ``chunks``: n, label, heading, text. Of passages
    with one label the last counts; a label that several queries put first goes with the
    first of them; one that no passage has is passed over.
    """
    last = chunks.groupBy("label").agg(F.max_by(F.struct("heading", "text"), "n").alias("_c"))
    first = fused.filter("rank = 1").groupBy("label").agg(F.min(F.struct("query_n", "query")).alias("_q"))
    rows = first.join(last, "label").orderBy("_q.query_n").limit(most)
    # At most `most` rows are left to be numbered.
    numbered = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("_q.query_n").alias("n"), F.col("_q.query").alias("query"), "label", "_c.heading", "_c.text"))).alias("_l"))
    return numbered.select(F.posexplode("_l").alias("_i", "x")).select((F.col("_i") + 1).cast("long").alias("id"), "x.query", "x.label", "x.heading", "x.text")


def whole(text: Column) -> Column:
    """A JSON value as whole number, cut towards zero; null if it is none."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("long")).when(text.rlike(r"^[+-]?\d*\.?\d+([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("long"))


def judge_verdicts(answers: DataFrame, sample: DataFrame, by: str = "model") -> tuple[DataFrame, DataFrame]:
    """Of every judge its outcome (``by, status, sampled, average``) and its verdicts (``by, id, query, label, score, reason``).

    ``answers``: ``by``, text. The text may say anything around a JSON array of objects with
    ``id``, ``score`` and ``reason``: what lies between its first ``[`` and its last ``]`` is
    read. Ids outside the sample are dropped, scores are brought into 0 to 100 and rounded
    to one decimal. An answer without such an array, with an item that is no object, whose
    id is no number, or whose score in the sample is none, and one without any verdict are
    errors, of that judge alone.
    """
    array = F.regexp_extract("text", r"(?s)\[.*\]", 0)
    rows = answers.select(by, F.from_json(F.when(array != "", array), "array<string>").alias("_items"))
    size = sample.agg(F.count(F.lit(1)).alias("_size"))
    item = F.from_json(F.when(F.col("_t").startswith("{"), F.col("_t")), "id string, score string, reason string")
    rows = rows.crossJoin(F.broadcast(size)).select(by, "_size", F.posexplode_outer("_items").alias("_i", "_t")).withColumn("_x", item)
    rows = rows.select(by, "_i", whole(F.col("_x.id")).alias("id"), F.col("_x.score").try_cast("double").alias("_s"), F.trim(F.coalesce("_x.reason", F.lit(""))).alias("reason"), "_size")
    inside = F.coalesce(F.col("id").between(1, F.col("_size")), F.lit(False))
    score = tenths(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_s"))))
    wrong = F.col("id").isNull() | (inside & F.col("_s").isNull())
    per = rows.groupBy(by).agg(F.count_if(inside).alias("_n"), F.bool_or(wrong).alias("_wrong"), F.avg(F.when(inside, score)).alias("_avg"))
    good = ~F.col("_wrong") & (F.col("_n") > 0)
    outcome = per.select(by, F.when(good, "ok").otherwise("error").alias("status"), F.when(good, F.col("_n")).otherwise(0).alias("sampled"), F.when(good, tenths(F.col("_avg"))).alias("average"))
    kept = rows.filter(inside).join(per.filter(good).select(by), by, "left_semi")
    verdicts = kept.join(sample.select("id", "query", "label"), "id").select(by, "id", "query", "label", score.alias("score"), "reason")
    return outcome, verdicts


def bare_host(url: Column) -> Column:
    """A url's host with its port, lower-cased, without ``www.``; empty without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def site_positions(results: DataFrame, sites: DataFrame) -> DataFrame:
    """``site, query, position, url``: a site's first place, from 1, in each query's list of results; null where it is not in it.

    ``results``: query, urls (in order; null entries hold their place); ``sites``: site, a bare host.
    """
    places = results.select("query", F.posexplode("urls").alias("_i", "url")).select("query", F.col("_i") + 1, "url", bare_host(F.col("url")).alias("site")).toDF("query", "position", "url", "site")
    first = places.filter("site <> ''").groupBy("site", "query").agg(F.min(F.struct("position", "url")).alias("_p"))
    every = results.select("query").distinct().crossJoin(F.broadcast(sites.select("site").distinct()))
    return every.join(first, ["site", "query"], "left").select("site", "query", F.col("_p.position").cast("long").alias("position"), F.col("_p.url").alias("url"))
