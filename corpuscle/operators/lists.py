"""Short ordered lists of a site: its graph's nodes, representative pages, its largest pages, the first things to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import written

# Nodes of a drawn graph, pages of a drawn map, actions named first, depth of a page that links don't reach, length of a label.
NODES, TILES, ACTIONS, FAR, LABEL = 60, 40, 3, 99, 30


def path_of(url: Column) -> Column:
    """A url's path, ``/`` if it has none."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def first_of(rows: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each ``by``, with their ``place``; a window that keeps no more than these."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("place") <= most)


def ranked_nodes(nodes: DataFrame, degree: DataFrame, depths: DataFrame | None, homes: DataFrame) -> DataFrame:
    """``host, node, incoming, depth, home`` of every node; depth is null where links don't reach it, or without ``depths``.

    ``nodes``: host, node; ``degree``: node, links; ``depths``: node, depth; ``homes``: host, node.
    """
    out = nodes.join(degree.select("node", F.col("links").alias("incoming")), "node", "left")
    out = out.withColumn("depth", F.lit(None).cast("int")) if depths is None else out.join(depths.select("node", "depth"), "node", "left")
    out = out.join(homes.select("node", F.lit(True).alias("home")), "node", "left")
    return out.select("host", "node", F.coalesce("incoming", F.lit(0)).alias("incoming"), "depth", F.coalesce("home", F.lit(False)).alias("home"))


def graph_nodes(ranked: DataFrame, most: int = NODES) -> DataFrame:
    """``host, place, node, label, incoming, depth, home``: home first, then by links that lead there, then by url."""
    rows = first_of(ranked, "host", most, F.col("home").desc(), F.col("incoming").desc(), F.col("node"))
    return rows.select("host", "place", "node", path_of(F.col("node")).alias("label"), "incoming", "depth", "home")


def graph_links(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """``host, source, target``: places of the shown nodes that an edge joins."""
    at = shown.select("host", "node", "place")
    out = edges.join(at.select("host", F.col("node").alias("src"), F.col("place").alias("source")), "src")
    return out.join(at.select(F.col("node").alias("dst"), F.col("place").alias("target")), "dst").select("host", "source", "target").distinct()


def unsettled(ranked: DataFrame, most: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For :func:`corpuscle.operators.graph.depths`: the search goes on only in hosts whose first ``most`` pages hang on depths not known yet.

    Pages of a host with equal links are told apart by depth. Such a group is settled once as
    many of it are nearer than ``FAR`` as it has places: whatever is reached later, or never,
    comes after them. Links don't leave a host. ``ranked``: host, node, incoming, home; read in every round.
    """
    rest = ranked.filter(~F.col("home"))
    sizes = rest.groupBy("host", "incoming").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("host").orderBy(F.col("incoming").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = written(sizes.withColumn("_b", before).filter((F.col("_b") < most) & (F.col("_size") > 1)).select("host", "incoming", F.least("_size", most - F.col("_b")).alias("_need")), "tied-groups")
    tied = written(rest.join(groups.select("host", "incoming"), ["host", "incoming"], "left_semi").select("host", "incoming", "node"), "tied-pages")

    def onward(reached: DataFrame, last: DataFrame) -> DataFrame:
        found = tied.join(reached.filter(F.col("depth") < FAR).select("node"), "node").groupBy("host", "incoming").agg(F.count(F.lit(1)).alias("_n"))
        wanting = groups.join(found, ["host", "incoming"], "left").filter(F.coalesce("_n", F.lit(0)) < F.col("_need")).select("host").distinct()
        return last.join(ranked.select("host", "node"), "node").join(wanting, "host", "left_semi").select("node", "depth")

    return onward


def representative_pages(ranked: DataFrame, most: int) -> DataFrame:
    """``host, place, node``: home, then the ``most`` pages with the most links there, of equal ones the nearest to home, then by url."""
    rows = first_of(ranked, "host", most + 1, F.col("home").desc(), F.col("incoming").desc(), F.coalesce("depth", F.lit(FAR)), F.col("node"))
    # Without a home among the pages the list is one shorter.
    has = rows.groupBy("host").agg(F.bool_or("home").alias("_h"))
    return rows.join(has, "host").filter(F.col("_h") | (F.col("place") <= most)).select("host", "place", "node")


def largest_pages(pages: DataFrame, severities: DataFrame, most: int = TILES) -> DataFrame:
    """``owner, place, url, label, words, severity``: pages with text by their words; owners with fewer than two have none.

    ``pages``: owner, url, words; ``severities``: url, severity. Labels are cut to 30 characters.
    """
    rows = pages.filter("words > 0").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("owner"))).filter("_n > 1").drop("_n")
    rows = first_of(rows, "owner", most, F.col("words").desc(), F.col("url"))
    path = path_of(F.col("url"))
    label = F.when(F.char_length(path) > LABEL, F.concat(F.substring(path, 1, LABEL - 3), F.lit("..."))).otherwise(path)
    found = rows.join(severities.select("url", "severity"), "url", "left")
    return found.select("owner", "place", "url", label.alias("label"), "words", F.coalesce("severity", F.lit("ok")).alias("severity"))


def top_actions(plan: DataFrame, most: int = ACTIONS) -> DataFrame:
    """The first ``most`` rows of each owner's plan."""
    return plan.filter(F.col("priority") <= most)
