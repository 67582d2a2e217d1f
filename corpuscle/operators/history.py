"""Stored runs: pages of a long log, comparisons of two runs, and one nested report for each site."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import finding_key
from corpuscle.operators.scores import tenths
from corpuscle.session import written

#: Queries that are taken from a report, and pages and findings that a report lists.
QUERIES, PAGES, FINDINGS = 15, 500, 1000


def numbered(rows: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """``rows`` with their place from 1 in ``order``, without a window in one task.

    Rows are dealt into ranges of the order and sorted there; only the ranges' counts meet
    on the driver, one number for each partition. ``order`` should end with a unique column,
    else rows that tie are numbered in any order and can't be dealt apart.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "history-ranges")
    counts = sorted(tuple(r) for r in ranged.groupBy("_p").count().collect())
    before, offsets = 0, []
    for part, count in counts:
        offsets.append((part, before))
        before += count
    starts = F.broadcast(spark.createDataFrame(offsets, "_p int, _before long"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", inside).join(starts, "_p").withColumn(name, F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def history_page(runs: DataFrame, limit: int, offset: int = 0, at: str = "created_at", tie: str = "run") -> DataFrame:
    """Runs ``offset`` + 1 to ``offset`` + ``limit``, newest first, with their place ``n``; of equal times the larger ``tie`` first."""
    return numbered(runs, F.col(at).desc(), F.col(tie).desc()).filter(F.col("n").between(offset + 1, offset + limit))


def comparable(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``site, older, newer`` for pairs of runs (``a, b``) that may be compared: both are there, differ, and are of one site.

    ``runs``: run, site, created_at. The earlier one is the older; of equal times ``a`` is.
    """
    one, two = (runs.select(F.col("run").alias(c), F.col("site").alias(f"_s{c}"), F.col("created_at").alias(f"_t{c}")) for c in "ab")
    both = pairs.filter("a <> b").join(one, "a").join(two, "b").filter("_sa = _sb")
    swapped = F.col("_tb") < F.col("_ta")
    return both.select(F.col("_sa").alias("site"), F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("older"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("newer"))


def score_changes(pairs: DataFrame, areas: DataFrame) -> DataFrame:
    """``older, newer, area, change``: by how much each area's score rose; areas that both runs have a score of. ``areas``: run, area, score."""
    known = areas.filter("score IS NOT NULL")
    was = pairs.join(known.select(F.col("run").alias("older"), "area", F.col("score").alias("_was")), "older")
    now = known.select(F.col("run").alias("newer"), "area", F.col("score").alias("_now"))
    return was.join(now, ["newer", "area"]).select("older", "newer", "area", tenths(F.col("_now") - F.col("_was")).alias("change"))


def finding_changes(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``older, newer, change, area, title``: criticals and warnings that are new or resolved, numbers in titles aside.

    ``found``: run, n, area, severity, title; of findings with one key the first title (by
    ``n``) is shown. One aggregate over both runs' findings; no list is gathered.
    """
    todo = found.filter(F.col("severity").isin("critical", "warning")).withColumn("_key", finding_key(F.col("area"), F.col("title")))
    side = lambda c, new: pairs.join(todo.withColumnRenamed("run", c), c).select("older", "newer", F.lit(new).alias("_new"), "_key", "n", "area", "title")
    both = side("older", False).unionByName(side("newer", True)).groupBy("older", "newer", "_key")
    out = both.agg(F.bool_and("_new").alias("_new"), F.bool_or("_new").alias("_any"), F.min(F.struct("n", "area", "title")).alias("_f"))
    out = out.filter(F.col("_new") == F.col("_any"))
    return out.select("older", "newer", F.when(F.col("_new"), "new").otherwise("resolved").alias("change"), "_f.area", "_f.title")


def capped(rows: DataFrame, by: str, most: int, order: list[Column], *fields: str) -> DataFrame:
    """``by`` and ``items``: structs of ``fields``, the first ``most`` of each ``by`` in ``order``; rows beyond never leave their task's window."""
    kept = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= most)
    items = F.array_sort(F.collect_list(F.struct("_k", F.struct(*fields).alias("x"))))
    return kept.groupBy(by).agg(F.transform(items, lambda i: i["x"]).alias("items"))


def site_reports(overall: DataFrame, areas: DataFrame, findings: DataFrame, pages: DataFrame, simulation: DataFrame, by: str = "owner") -> DataFrame:
    """``owner, report``: one nested JSON document for each site of ``overall``, its lists ordered and capped.

    ``overall``: owner, overall; ``areas``: owner, area, score; ``findings``: owner, n, key,
    area, severity, weight, title; ``pages``: owner, url, title, words (by url);
    ``simulation``: owner, n, query, consensus.
    """
    scored = areas.filter("score IS NOT NULL").groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("area", "score")))).alias("scores"))
    lists = {
        "findings": capped(findings, by, FINDINGS, [F.col("n"), F.col("key")], "key", "area", "severity", "weight", "title"),
        "pages": capped(pages, by, PAGES, [F.col("url")], "url", "title", "words"),
        "rrf_simulation": capped(simulation, by, PAGES, [F.col("n")], "query", "consensus"),
    }
    out = overall.select(by, "overall").join(scored, by, "left")
    for name, table in lists.items():
        out = out.join(table.withColumnRenamed("items", name), by, "left")
    fields = ["overall", "scores", *lists]
    return out.select(by, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col(by).alias("site"), *fields)).alias("report"))


def write_reports(reports: DataFrame, folder: str) -> str:
    """Reports as files of one JSON document for each line below ``folder``; returns the new folder."""
    path = os.path.join(folder, f"reports-{uuid.uuid4().hex}")
    reports.select(F.col("report").alias("value")).write.text(path)
    return path


def report_queries(spark: SparkSession, path: str, most: int = QUERIES) -> DataFrame:
    """``site, n, query``: the first queries of the reports at ``path``, those that aren't empty, by their place.

    A report may stand on one line or on many; what is no report gives no row.
    """
    texts = spark.read.text(path, wholetext=True)
    lines = texts.select(F.explode(F.when(F.from_json(F.trim("value"), "site string", {"mode": "PERMISSIVE"})["site"].isNotNull() & ~F.trim("value").contains("}\n{"), F.array("value")).otherwise(F.split("value", "\n"))).alias("value"))
    rows = lines.select(F.from_json("value", "site string, rrf_simulation array<struct<query:string>>").alias("r")).select("r.site", F.posexplode("r.rrf_simulation").alias("_i", "q"))
    kept = rows.filter("q.query <> ''").withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("_i")).cast("long"))
    return kept.filter(F.col("n") <= most).select("site", "n", F.col("q.query").alias("query"))
