"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import free_name, written


def digested(docs: DataFrame, id_col: str, text_col: str, salts: int, *more: Column) -> DataFrame:
    """``_id, _sha, _xx, _salt``: every row's id, two digests of its text and a salt from its id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.sha2(text.cast("binary"), 256).alias("_sha"),
        F.xxhash64(text).alias("_xx"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("_salt"),
        *more,
    )


def repeated_digests(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """``_sha, _xx, _salt`` of texts that more than one row has, for each salt under which one lies, written: no text moves for it.

    Counted inside each map task first, then by salted digest; a window adds up the at most
    ``salts`` counts of a digest.
    """
    salted = digested(docs, id_col, text_col, salts).groupBy("_sha", "_xx", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counted = salted.withColumn("_all", F.sum("_n").over(Window.partitionBy("_sha", "_xx")))
    return written(counted.filter("_all > 1").select("_sha", "_xx", "_salt"), "dedup-repeated")


def salt_groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per (text, salt) of the texts that repeat: the largest id, and the whole group's figures.

    A text whose digests occur once has nothing to be compared with and leaves before the
    content stages. The aggregate on (digest, salt, text) first combines inside each task
    (local deduplication), then merges each salted group. The window combines the at most
    ``salts`` winners of a text. The text itself is part of the key in both steps, so a
    digest never decides alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = digested(docs, id_col, text_col, salts, text.alias("_text"))
    # Only digests stand in the hash tables; texts stream past them unsorted, a hot text under all its salts.
    rows = rows.join(repeated_digests(docs, id_col, text_col, salts).hint("shuffle_hash"), ["_sha", "_xx", "_salt"], "left_semi")
    salted = rows.groupBy("_sha", "_xx", "_salt", "_text").agg(F.max("_id").alias("_max"), F.count(F.lit(1)).alias("_n"))
    same = Window.partitionBy("_sha", "_xx", "_text")
    return salted.select("_sha", "_xx", "_salt", F.max("_max").over(same).alias("keep_id"), F.sum("_n").over(same).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """Label every row with the row that stays of its group of equal texts.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` (the first named as
    ``id_col``), one row per input row. Equal means identical text; null counts as empty.
    The row with the largest id stays. Rows that repeat an id and its text are all
    returned and counted in ``group_size``; exactly one of them is ``kept``. A null id is
    smaller than any other; in a group of null ids alone ``keep_id`` is null and one row
    is kept. Other columns are ignored. An empty table gives an empty result.

    A hot group is spread over ``salts`` keys in every exchange that carries its rows.
    """
    groups = salt_groups(docs, id_col, text_col, salts)
    # Repeats of one id and text become one row with a count, so that one of them can be kept.
    rows = digested(docs, id_col, text_col, salts).groupBy("_sha", "_xx", "_salt", "_id").agg(F.count(F.lit(1)).alias("_m"))
    labelled = rows.join(groups, ["_sha", "_xx", "_salt"], "left")
    alone = F.col("group_size").isNull()
    return labelled.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("_top"),
        F.col("_sha").alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_i"),
    ).select(id_col, "keep_id", "group_size", (F.col("_top") & (F.col("_i") == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Of rows that repeat the kept id and text, one stays, taken by the order of all columns
    as JSON. Columns of any name and type are allowed, maps as well.
    """
    labelled = exact_dedup(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", "t", salts)
    repeated = labelled.filter(F.col("i").eqNullSafe(F.col("keep_id"))).groupBy("i", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    sha, kid, ksha, times = (free_name(stem, docs.columns) for stem in ("_sha", "_kid", "_ksha", "_times"))
    keep = repeated.select(F.col("i").alias(kid), F.col("text_sha256").alias(ksha), F.col("n").alias(times))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.withColumn(sha, F.sha2(text.cast("binary"), 256)).join(keep, F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(sha) == F.col(ksha)))
    once = found.filter(F.col(times) == 1).select(*docs.columns)
    # Repeats are combined in the map tasks first, so that a row repeated very often meets nowhere.
    best = found.filter(F.col(times) > 1).groupBy(id_col, sha).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("best"))
    return once.unionByName(best.select(*[F.col("best").getField(c).alias(c) for c in docs.columns]))
