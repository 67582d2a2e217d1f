"""Query lists, query statistics and append-only run logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = "generated_at string, created_at double, site string, overall double, scores map<string,double>, findings array<struct<area:string,severity:string,title:string>>"
EVENTS = "date string, label string, site string"


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """``query``: one for each line that isn't blank, without spaces around it."""
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> ''")


def delimiter(spark: SparkSession, path: str) -> str:
    """Semicolon where a file's first 4,096 characters hold more of them than commas."""
    lines = [r["value"] for r in spark.read.text(path).limit(200).collect()]
    head = "\n".join(lines)[:4096]
    return ";" if head.count(";") > head.count(",") else ","


def search_console(spark: SparkSession, path: str, most: int = 15, sep: str | None = None) -> DataFrame:
    """``query, clicks, impressions`` of a search statistics export: most clicks first, then impressions; each query once without regard to case.

    Columns are told by the start of their names in English, Italian or Spanish; all that
    isn't a digit is taken out of numbers. Without ``sep`` the delimiter is told from the file's start.
    """
    sep = sep or delimiter(spark, path)
    raw = spark.read.option("header", True).option("sep", sep).csv(path)

    def named(*starts: str) -> str | None:
        return next((c for c in raw.columns if c.strip("﻿ ").lower().startswith(starts)), None)

    query, clicks, shown = named("query", "top quer", "consultas"), named("clic", "click"), named("impression")
    number = lambda c: F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(F.col(c), r"\D", ""), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0)) if c else F.lit(0)
    rows = raw.select(F.trim(F.col(query)).alias("query"), number(clicks).alias("clicks"), number(shown).alias("impressions")).filter("query <> ''")
    order = (F.col("clicks").desc(), F.col("impressions").desc(), F.col("query"))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("query")).orderBy(*order))).filter("_n = 1").drop("_n")
    return once.orderBy(*order).limit(most)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Run log of JSON lines; malformed lines are skipped."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).filter("site IS NOT NULL")


def latest_by_site(runs: DataFrame) -> DataFrame:
    """Each site's newest run."""
    newest = Window.partitionBy("site").orderBy(F.col("created_at").desc(), F.col("generated_at").desc())
    return runs.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def append_history(runs: DataFrame, path: str) -> None:
    """Append runs as JSON lines."""
    runs.write.mode("append").json(path)


def findings_csv(findings: DataFrame, path: str) -> None:
    """Findings as CSV with semicolons and a header."""
    findings.write.option("header", True).option("sep", ";").csv(path)


def event_pins(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Dated labels by date (its first ten characters); without date or label a line is skipped, without site it holds for all."""
    rows = spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(path).withColumn("date", F.substring("date", 1, 10))
    rows = rows.filter("date <> '' AND label <> ''")
    return (rows if site is None else rows.filter(F.col("site").isNull() | (F.col("site") == site))).orderBy("date", "label")
