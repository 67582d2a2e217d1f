"""Scores from findings, plans of work, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import spread

# What a finding of each severity keeps of its weight; others aren't graded.
FACTORS = {"ok": 1.0, "warning": 0.5, "critical": 0.0}


def tenths(value):
    """Rounded to one decimal, halves to the even digit."""
    return F.bround(value.cast("decimal(30,12)"), 1).cast("double")


def factor(severity):
    col = None
    for name, value in FACTORS.items():
        col = F.when(severity == name, F.lit(value)) if col is None else col.when(severity == name, F.lit(value))
    return col


def area_scores(findings: DataFrame, by: str = "owner") -> DataFrame:
    """``by, area, score``: weight kept of all graded weight, in percent to one decimal; null without graded findings."""
    kept = findings.withColumn("_f", factor(F.col("severity")))
    graded = F.when(F.col("_f").isNotNull(), F.col("weight"))
    return kept.groupBy(by, "area").agg(tenths(100 * F.sum(graded * F.col("_f")) / F.nullif(F.sum(graded), F.lit(0.0))).alias("score"))


def overall_scores(areas: DataFrame, weights: Mapping[str, float], by: str = "owner") -> DataFrame:
    """``by, overall``: weighted mean over the areas that have a score; 0 if none has."""
    w = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("area")), F.lit(1.0))
    w = F.when(F.col("score").isNotNull(), w)
    return areas.groupBy(by).agg(F.coalesce(tenths(F.sum(w * F.col("score")) / F.sum(w)), F.lit(0.0)).alias("overall"))


def plan(findings: DataFrame, by: str = "owner") -> DataFrame:
    """Actionable findings of each owner with ``priority``: critical before warning, heavier first, then by key."""
    todo = findings.filter(F.col("severity").isin("critical", "warning"))
    order = Window.partitionBy(by).orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), F.col("weight").desc(), "key")
    return todo.withColumn("priority", F.row_number().over(order).cast("long"))


def gains(findings: DataFrame, by: str = "owner") -> DataFrame:
    """What each actionable finding costs its area's score: 100 * weight * (1 - factor) / all graded weight."""
    graded = findings.withColumn("_f", factor(F.col("severity"))).filter("_f IS NOT NULL")
    total = F.sum("weight").over(Window.partitionBy(by, "area"))
    out = graded.withColumn("gain", tenths(100 * F.col("weight") * (1 - F.col("_f")) / total))
    return out.filter("_f < 1").drop("_f")


def previous_run(runs: DataFrame, site: str = "site", at: str = "created_at", tie: str = "run", score: str = "overall") -> DataFrame:
    """Runs with the score of the site's run before, and the change of the scores as whole numbers."""
    order = Window.partitionBy(site).orderBy(at, tie)
    out = runs.withColumn("previous", F.lag(score).over(order))
    return out.withColumn("change", (F.bround(score) - F.bround("previous")))


def last_runs(runs: DataFrame, most: int, site: str = "site", at: str = "created_at", tie: str = "run") -> DataFrame:
    """Each site's last ``most`` runs, numbered from the newest."""
    order = Window.partitionBy(site).orderBy(F.col(at).desc(), F.col(tie).desc())
    return runs.withColumn("age", F.row_number().over(order).cast("long")).filter(F.col("age") <= most)


def findings_delta(runs: DataFrame, found: DataFrame, site: str = "site", at: str = "created_at", tie: str = "run") -> DataFrame:
    """``run, new, resolved``: findings (by ``key``) that a run has and the site's run before had not, and the other way round.

    A run's keys and its predecessor's meet in one aggregate; no list of findings is gathered.
    Both tables are counted first: a task's share of them doesn't grow with them.
    """
    n_runs, n_found = runs.count(), found.count()
    order = Window.partitionBy(site).orderBy(at, tie)
    steps = spread(runs.select(site, at, tie), n_runs, site).select(F.col(tie).alias("run"), F.lag(tie).over(order).alias("before"), F.lead(F.struct(F.col(tie).alias("run"))).over(order).alias("after"))
    keys = spread(found.select("run", "key"), max(n_found, n_runs), "run")
    # A finding counts for its run and for the site's run after it.
    side = lambda given, run, now: F.when(given, F.struct(run.alias("run"), F.lit(now).alias("_now"), F.lit(not now).alias("_past")))
    sides = F.array_compact(F.array(side(F.col("before").isNotNull(), F.col("run"), True), side(F.col("after").isNotNull(), F.col("after.run"), False)))
    rows = keys.join(steps, "run").select("key", F.inline(sides))
    none = steps.filter("before IS NOT NULL").select(F.lit(None).cast(found.schema["key"].dataType).alias("key"), "run", F.lit(False).alias("_now"), F.lit(False).alias("_past"))
    per = spread(rows.unionByName(none), 2 * n_found + n_runs, "run").groupBy("run", "key").agg(F.bool_or("_now").alias("_now"), F.bool_or("_past").alias("_past"))
    return per.groupBy("run").agg(F.count_if(F.col("_now") & ~F.col("_past")).alias("new"), F.count_if(~F.col("_now") & F.col("_past")).alias("resolved"))


def severity_pivot(findings: DataFrame, by: str = "area") -> DataFrame:
    """Number of findings of each severity by area."""
    out = findings.groupBy(by)
    return out.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "ok", "info")])


def citation_rates(answers: DataFrame) -> DataFrame:
    """``provider, answered, failed, cited, rate`` from ``provider, ok, cited``; rate in percent to one decimal, 0 without an answer."""
    done = F.count_if(F.col("ok"))
    cited = F.count_if(F.col("ok") & F.col("cited"))
    return answers.groupBy("provider").agg(done.alias("answered"), F.count_if(~F.col("ok")).alias("failed"), cited.alias("cited"), F.coalesce(tenths(100.0 * cited / F.nullif(done, F.lit(0))), F.lit(0.0)).alias("rate"))


def cited_hosts(urls: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, urls``: urls whose host is a target or lies below one; every host's suffixes meet the targets in an equi-join."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(suffixes).alias("target"))
    return hosts.join(targets, "target").groupBy("target").agg(F.sum("n").alias("urls"))


def profile_scores(areas: DataFrame, profiles: Mapping[str, Mapping[str, float]], by: str = "owner") -> DataFrame:
    """``by, profile, score``: each profile's weighted mean of the area scores there are, its weights scaled up to them; one decimal."""
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(a).alias("area"), F.lit(float(w)).alias("w")) for p, weights in profiles.items() for a, w in weights.items()])
    known = areas.filter("score IS NOT NULL").select(by, F.col("area").alias("_a"), "score", F.explode(rows).alias("x")).filter(F.col("x.area") == F.col("_a"))
    return known.groupBy(by, F.col("x.profile").alias("profile")).agg(tenths(F.sum(F.col("x.w") * F.col("score")) / F.sum("x.w")).alias("score"))


def composite_index(profiles: DataFrame, weights: Mapping[str, float], by: str = "owner") -> DataFrame:
    """``by, index``: weighted mean of the profile scores there are; one decimal."""
    w = F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("profile"))
    return profiles.groupBy(by).agg(tenths(F.sum(w * F.col("score")) / F.sum(w)).alias("index"))


#: Words of a page that is deep enough; a gain that counts for a profile.
DEEP_WORDS, CROSS_GAIN = 900, 1.0


def depth_scores(words: DataFrame, by: str = "owner", area: str = "depth") -> DataFrame:
    """``by, area, score``: mean words of a page (cut to a whole number) of 900, in percent, 100 at most. ``words``: by, words of each page."""
    mean = F.floor(F.sum("words") / F.count(F.lit(1)))
    return words.groupBy(by).agg(F.least(F.lit(100.0), tenths(100.0 * mean / DEEP_WORDS)).alias("score")).select(by, F.lit(area).alias("area"), "score")


def gain_plan(findings: DataFrame, areas: DataFrame, profiles: Mapping[str, Mapping[str, float]], market: Mapping[str, float], by: str = "owner") -> DataFrame:
    """Actionable findings by what mending them is worth: ``gains`` of each profile, the best of them, and the gain of the market's index.

    Mending a finding raises its area by 100 * weight * (1 - factor) / all graded weight of
    the area; a profile gains that times the area's share of its weights, taken over the
    components that have a score (``areas``: by, area, score; depth among them). Criticals
    come first, then the larger index gain, then the larger weight, then the order ``n``.
    ``profiles_hit`` are those that gain a point or more; with two the finding is ``cross``.
    The best profile is the first, in the order given, of those that gain most; empty if none gains.
    """
    known = areas.filter("score IS NOT NULL").groupBy(by).agg(F.collect_set("area").alias("_known"))
    graded = findings.withColumn("_f", factor(F.col("severity"))).filter("_f IS NOT NULL")
    total = F.sum("weight").over(Window.partitionBy(by, "area"))
    todo = graded.withColumn("_d", F.coalesce(100 * F.col("weight") * (1 - F.col("_f")) / F.nullif(total, F.lit(0.0)), F.lit(0.0))).filter(F.col("severity").isin("critical", "warning"))
    rows = todo.join(known, by, "left")
    entries = []
    for name, weights in profiles.items():
        usable = sum((F.when(F.array_contains("_known", a), F.lit(float(w))).otherwise(0.0) for a, w in weights.items()), F.lit(0.0))
        share = F.coalesce(F.try_element_at(F.create_map(*[x for a, w in weights.items() for x in (F.lit(a), F.lit(float(w)))]), F.col("area")), F.lit(0.0))
        entries.append(F.when(usable > 0, F.struct(F.lit(name).alias("profile"), tenths(F.col("_d") * share / usable).alias("gain"), F.lit(float(market.get(name, 0.0))).alias("w"))))
    rows = rows.withColumn("_g", F.filter(F.array(*entries), lambda g: g.isNotNull()))
    best = F.coalesce(F.array_max(F.transform("_g", lambda g: g["gain"])), F.lit(0.0))
    hit = F.transform(F.filter("_g", lambda g: g["gain"] >= CROSS_GAIN), lambda g: g["profile"])
    out = rows.select(
        *findings.columns,
        F.map_from_entries(F.transform("_g", lambda g: F.struct(g["profile"], g["gain"]))).alias("gains"),
        F.when(best > 0, F.get(F.filter("_g", lambda g: g["gain"] == best), F.lit(0))["profile"]).otherwise("").alias("best_profile"),
        F.greatest(best, F.lit(0.0)).alias("best_gain"),
        tenths(F.aggregate("_g", F.lit(0.0), lambda s, g: s + g["w"] * g["gain"])).alias("index_gain"),
        hit.alias("profiles_hit"),
        (F.size(hit) >= 2).alias("cross"),
    )
    order = Window.partitionBy(by).orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), F.col("index_gain").desc(), F.col("weight").desc(), "n")
    return out.withColumn("priority", F.row_number().over(order).cast("long"))
