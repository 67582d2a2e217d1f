"""Link graph: edges, in-degree, orphans and click depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import written


def in_degree(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, links, sources``: link occurrences and distinct sources of every node; links to itself and to strangers don't count."""
    inner = links.filter("src <> dst").groupBy("dst").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("src").alias("sources"))
    out = nodes.join(inner, nodes["node"] == inner["dst"], "left")
    return out.select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("sources", F.lit(0)).alias("sources"))


def orphans(links: DataFrame, nodes: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """Nodes that no other node links to; those of ``home`` (``node``) are never orphans. Links to one node are one row before they move."""
    linked = links.filter("src <> dst").select(F.col("dst").alias("node")).distinct()
    out = nodes.join(linked, "node", "left_anti")
    return out if home is None else out.join(home.select("node"), "node", "left_anti")


def depths(links: DataFrame, start: DataFrame, most: int | None = None, onward: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, depth``: the least number of links from the ``start`` nodes, up to ``most`` if that is given.

    ``onward`` is given what was reached and the last round's nodes, and gives the nodes among
    these from which the search goes on; without it, all of them.

    Breadth first: each round joins the last round's nodes with the distinct edges and
    leaves out what was reached before, until a round finds no new node. Rounds are
    written, so lineage stays short; every eighth time what was reached is written as one
    table, so the plan stays short too.
    """
    edges = written(links.select("src", "dst").filter("src <> dst").distinct(), "graph-edges")
    reached = written(start.select("node").distinct().withColumn("depth", F.lit(0)), "graph-depth")
    ahead = (lambda reached, new: new) if onward is None else (lambda reached, new: written(onward(reached, new).select("node", "depth"), "graph-onward"))
    last, depth = ahead(reached, reached), 0
    while most is None or depth < most:
        depth += 1
        new = edges.join(last, edges["src"] == last["node"]).select(F.col("dst").alias("node")).distinct()
        new = written(new.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "graph-depth")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        if depth % 8 == 0:
            reached = written(reached, "graph-depth")
        last = ahead(reached, new)
    return reached


def depth_histogram(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bucket, nodes``: depths 0 to 3, ``4+`` and ``unreachable``."""
    bucket = F.when(F.col("depth").isNull(), F.lit("unreachable")).when(F.col("depth") >= 4, F.lit("4+")).otherwise(F.col("depth").cast("string"))
    return nodes.join(found, "node", "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("nodes"))
