"""Roll-ups over a table of page audit reports (one JSON report of Lighthouse for each page): failed audits, categories, vitals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import host, text_of
from corpuscle.operators.scores import tenths

# A passing score, a critical one, a high weight, urls named with a failed audit.
PASS, CRITICAL, HIGH_WEIGHT, NAMED = 0.9, 0.5, 3, 3
# Vitals by audit with their label and their limits for good and for poor.
VITALS = [
    ("largest-contentful-paint", "LCP", 2500.0, 4000.0),
    ("cumulative-layout-shift", "CLS", 0.1, 0.25),
    ("total-blocking-time", "TBT (proxy INP)", 200.0, 600.0),
    ("first-contentful-paint", "FCP", 1800.0, 3000.0),
    ("speed-index", "Speed Index", 3400.0, 5800.0),
]
# What a vital is called within the limits, between them and beyond.
GOOD, BETWEEN, POOR = "buono", "da migliorare", "scarso"
REPORT = (
    "audits map<string,struct<score:double,title:string,description:string,displayValue:string,numericValue:double>>,"
    "categories map<string,struct<title:string,score:double,auditRefs:array<struct<id:string,weight:double>>>>"
)


def reports(rows: DataFrame, url_col: str = "url", report_col: str = "report", order_col: str = "n") -> DataFrame:
    """``owner, url, n, audits, categories``: the parsed reports that have categories; text that is no report gives no row.

    ``order_col`` orders the reports: firsts below are firsts by it.
    """
    out = rows.select(host(text_of(url_col)).alias("owner"), text_of(url_col).alias("url"), F.col(order_col).alias("n"), F.from_json(text_of(report_col), REPORT).alias("_r"))
    return out.select("owner", "url", "n", "_r.audits", "_r.categories").filter("categories IS NOT NULL")


def failed_audits(parsed: DataFrame) -> DataFrame:
    """``owner, audit, category, score, weight, title, description, display, urls, pages, severity, finding_weight, key``.

    An audit fails below 0.9. Of all pages the least score and the greatest weight count;
    texts and category are the first that cite it. ``urls`` are its first three pages,
    ``pages`` their number. Weight 0 is information; a score below 0.5 of weight 3 and more is critical.
    """
    cited = parsed.select("owner", "url", "n", "audits", F.posexplode(F.map_entries("categories")).alias("_c", "_cat"))
    cited = cited.select("owner", "url", "n", "audits", "_c", F.col("_cat.key").alias("category"), F.posexplode("_cat.value.auditRefs").alias("_i", "_ref"))
    cited = cited.select("owner", "url", F.struct("n", "_c", "_i", "url").alias("_at"), "category", F.col("_ref.id").alias("audit"), F.coalesce("_ref.weight", F.lit(0.0)).alias("weight"), F.try_element_at("audits", F.col("_ref.id")).alias("_a"))
    cited = cited.filter(F.col("_a.score") < PASS)
    of = ["owner", "audit"]
    first = lambda c: F.min_by(c, "_at")
    per = cited.groupBy(*of).agg(
        first("category").alias("category"), F.min("_a.score").alias("score"), F.max("weight").alias("weight"),
        first(F.coalesce(F.nullif("_a.title", F.lit("")), F.col("audit"))).alias("title"), first(F.coalesce("_a.description", F.lit(""))).alias("description"),
        first(F.coalesce("_a.displayValue", F.lit(""))).alias("display"),
    )
    pages = cited.filter("url <> ''").groupBy(*of, "url").agg(F.min("_at").alias("_at"))
    # The window sees one row for each page; three of them are kept before anything is collected.
    pages = pages.withColumn("_k", F.row_number().over(Window.partitionBy(*of).orderBy("_at"))).groupBy(*of).agg(
        F.array_sort(F.collect_list(F.when(F.col("_k") <= NAMED, F.struct("_k", "url")))).alias("_u"), F.count(F.lit(1)).alias("pages")
    )
    out = per.join(pages, of, "left")
    severity = F.when(F.col("weight") <= 0, "info").when((F.col("score") < CRITICAL) & (F.col("weight") >= HIGH_WEIGHT), "critical").otherwise("warning")
    return out.select(
        *of, "category", "score", "weight", "title", F.regexp_replace("description", r"\[([^\]]*)\]\([^)]*\)", "$1").alias("description"), "display",
        F.coalesce(F.transform("_u", lambda x: x["url"]), F.array().cast("array<string>")).alias("urls"), F.coalesce("pages", F.lit(0)).alias("pages"),
        severity.alias("severity"), F.when(F.col("weight") >= HIGH_WEIGHT, 2.0).otherwise(1.0).alias("finding_weight"), F.concat_ws(".", F.lit("lh"), "category", "audit").alias("key"),
    )


def category_scores(parsed: DataFrame) -> DataFrame:
    """``owner, category, title, score, pages, mean``: mean of a category's scores, as whole points of 100 (halves to even) and unrounded."""
    rows = parsed.select("owner", "n", F.posexplode(F.map_entries("categories")).alias("_c", "_cat"))
    rows = rows.select("owner", F.struct("n", "_c").alias("_at"), F.col("_cat.key").alias("category"), F.coalesce(F.nullif("_cat.value.title", F.lit("")), F.col("_cat.key")).alias("title"), F.col("_cat.value.score").alias("score"))
    per = rows.groupBy("owner", "category").agg(F.min_by("title", "_at").alias("title"), F.avg("score").alias("mean"), F.count("score").alias("pages")).filter("pages > 0")
    return per.select("owner", "category", "title", F.bround(F.col("mean").cast("decimal(30,12)") * 100, 0).cast("long").alias("score"), "pages", "mean")


def area_score(categories: DataFrame) -> DataFrame:
    """``owner, score``: mean of the categories' means of 100, to one decimal."""
    return categories.groupBy("owner").agg(tenths(100 * F.avg("mean")).alias("score"))


def clean_categories(categories: DataFrame, parsed: DataFrame) -> DataFrame:
    """``owner, category, key``: categories with a score and no failed audit among those they cite."""
    cited = parsed.select("owner", "audits", F.explode(F.map_entries("categories")).alias("_cat"))
    bad = F.exists("_cat.value.auditRefs", lambda r: F.try_element_at(F.col("audits"), r["id"])["score"] < PASS)
    bad = cited.filter(bad).select("owner", F.col("_cat.key").alias("category")).distinct()
    return categories.join(bad, ["owner", "category"], "left_anti").select("owner", "category", F.concat(F.lit("lh."), "category", F.lit(".ok")).alias("key"))


def worst_vitals(parsed: DataFrame) -> DataFrame:
    """``owner, id, label, value, display, verdict``: the worst value of each vital over a host's pages; of equal ones the first."""
    audit = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(good).alias("good"), F.lit(poor).alias("poor")) for i, label, good, poor in VITALS]))
    rows = parsed.select("owner", "url", "n", "audits", audit.alias("v")).select("owner", "url", "n", "v.*", F.try_element_at("audits", F.col("v.id")).alias("_a")).filter("_a.numericValue IS NOT NULL")
    worst = F.min_by(F.struct(F.col("_a.numericValue").alias("value"), F.coalesce("_a.displayValue", F.lit("")).alias("display")), F.struct(-F.col("_a.numericValue"), "n", "url"))
    per = rows.groupBy("owner", "id", "label", "good", "poor").agg(worst.alias("_w"))
    verdict = F.when(F.col("_w.value") <= F.col("good"), GOOD).when(F.col("_w.value") <= F.col("poor"), BETWEEN).otherwise(POOR)
    return per.select("owner", "id", "label", F.round("_w.value", 3).alias("value"), "_w.display", verdict.alias("verdict"))


def category_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``owner, category, title, delta``: categories that both runs have, by difference of their points."""
    old = before.select("owner", "category", F.col("score").alias("_was"))
    return now.join(old, ["owner", "category"]).select("owner", "category", "title", tenths(F.col("score") - F.col("_was")).alias("delta"))
