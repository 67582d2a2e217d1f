"""The log of citation runs: rates of each provider and of all together, run after run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.operators.scores import tenths

PROVIDERS = "map<string,struct<answered:long,failed:long,site_cited:long,rate:double,competitors_cited:map<string,long>>>"
#: Runs of a site that are shown.
LAST = 50


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``n, generated_at, site, providers`` of a log of JSON lines; lines that are malformed or lack a site or providers are skipped.

    ``n`` orders the lines; it needs no exchange.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.from_json("value", f"generated_at string, site string, providers {PROVIDERS}").alias("r"))
    return lines.select("n", "r.*").filter("site <> '' AND providers IS NOT NULL")


def last_runs(runs: DataFrame, most: int = LAST) -> DataFrame:
    """Each site's last ``most`` runs; ``site_n`` orders sites by their first run, ``age`` counts back from 1."""
    of = Window.partitionBy("site")
    rows = runs.withColumn("site_n", F.min("n").over(of)).withColumn("age", F.row_number().over(of.orderBy(F.col("n").desc())).cast("long"))
    return rows.filter(F.col("age") <= most)


def provider_series(runs: DataFrame, most: int = LAST) -> DataFrame:
    """``site, site_n, n, provider, answered, cited, rate, before, change``: one row for each run and provider, and one pooled over all (provider null).

    A provider's rate is in percent to one decimal, 0 without an answer; the pooled rate is
    null without any. ``before`` is the rate of the site's run before that has the provider;
    ``change`` is null where either rate is.
    """
    rows = last_runs(runs, most).select("site", "site_n", "n", F.explode("providers").alias("provider", "p"))
    rows = rows.select("site", "site_n", "n", "provider", F.coalesce("p.answered", F.lit(0)).alias("answered"), F.coalesce("p.site_cited", F.lit(0)).alias("cited"))
    rate = tenths(100.0 * F.col("cited") / F.nullif(F.col("answered"), F.lit(0)))
    pooled = rows.groupBy("site", "site_n", "n").agg(F.sum("answered").alias("answered"), F.sum("cited").alias("cited")).select("site", "site_n", "n", F.lit(None).cast("string").alias("provider"), "answered", "cited", rate.alias("rate"))
    both = rows.withColumn("rate", F.coalesce(rate, F.lit(0.0))).unionByName(pooled)
    before = F.lag("rate").over(Window.partitionBy("site", "provider").orderBy("n"))
    return both.withColumn("before", before).withColumn("change", tenths(F.col("rate") - F.col("before")))


def competitor_counts(answers: DataFrame, competitors: DataFrame) -> DataFrame:
    """``provider, host, answers``: answers that cite a competitor, below it too, each answer once; 0 where none does.

    ``answers``: provider, n, ok, hosts; ``competitors``: host. Each cited host's suffixes meet the competitors in an equi-join.
    """
    suffixes = lambda h: F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\."))), lambda i: F.array_join(F.slice(F.split(h, r"\."), i, F.size(F.split(h, r"\."))), "."))
    cited = answers.filter("ok").select("provider", F.explode(F.array_distinct(F.flatten(F.transform("hosts", suffixes)))).alias("host"))
    counts = cited.join(competitors, "host").groupBy("provider", "host").agg(F.count(F.lit(1)).alias("answers"))
    every = answers.select("provider").distinct().crossJoin(F.broadcast(competitors.select("host").distinct()))
    return every.join(counts, ["provider", "host"], "left").select("provider", "host", F.coalesce("answers", F.lit(0)).alias("answers"))
