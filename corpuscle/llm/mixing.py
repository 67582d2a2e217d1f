"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import free_name, written

BITS, LEVELS = 12, 5
WORDS = r"[^\x20\x09-\x0D]+"


def doc_hash(id_, text) -> F.Column:
    """60 bits of the MD5 of an id and its text's MD5: each document's fixed place in its source."""
    inner = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(" "), inner).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``_source, source_size, target``: the water level at which weighted targets, stopped at ``most`` times a source's size, add up to ``share`` of all.

    Sorted by (stop / weight), each source either stops or the level is reached; the level
    is what resharing the excess by weight, again and again, ends at. The windows run over
    one row per source.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("_all"),
        F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_rest"),
        F.row_number().over(order).alias("_rank"),
    )
    per = per.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    open_ = F.col("_level") * F.col("_w") <= F.col("_cap")
    per = per.withColumn("_at", F.min(F.when(open_, F.struct("_rank", "_level"))).over(everything))
    stops = F.col("_at").isNull() | (F.col("_rank") < F.col("_at._rank"))
    return per.select("_source", "source_size", F.when(stops, F.col("_cap")).otherwise(F.col("_at._level") * F.col("_w")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document a mix takes, so that each source comes near its target.

    Returns ``doc_id, size, source_size, target, taken, copies, source, place``, one row per input row.
    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    words; a target stops at ``most`` times its source, the excess goes to the others by
    weight. Every document is taken floor(target / source size) times, and once more where
    its hash lies below its source's threshold: nested, so a larger budget only adds.

    The threshold is found by histograms: words by source and bucket of the hash's leading
    12 bits, then only inside the bucket in which the budget ends, 12 bits further, down to
    one hash value, which is taken if that comes nearer to the budget. Documents are never
    sorted. The hash is that of id and text, so the rest to the target is at most half of one
    document, or of all rows that repeat one id and text, which go together. Null or empty texts have size 0 and are taken 0 words; null sources are
    one source; all rows may repeat; an empty table gives an empty result; reruns agree.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), doc_hash(F.col(id_col), F.col(text_col)).alias("_h")), "mix-sizes")
    state = source_targets(sizes, weights, share, most)
    state = state.withColumn("_base", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0)))
    state = state.withColumn("_budget", F.col("target") - F.col("_base") * F.col("source_size"))
    state = written(state.withColumn("_base", F.col("_base").cast("long")), "mix-targets")
    bounds = state.select(F.col("_source").alias("_s"), "_budget", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_used")).filter("_budget > 0")
    for level in range(LEVELS):
        bounds = refine(sizes, bounds, BITS * (LEVELS - 1 - level), last=level == LEVELS - 1)
    bounds = bounds.select("_s", "_limit")
    mixed = sizes.join(state, sizes["_source"].eqNullSafe(state["_source"])).drop(state["_source"])
    mixed = mixed.join(bounds, mixed["_source"].eqNullSafe(bounds["_s"]), "left")
    # Without a boundary bucket the whole budget fits: every document once more.
    more = F.when(F.col("_budget") <= 0, F.lit(0)).when(F.col("_limit").isNull() | (F.col("_h") < F.col("_limit")), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col("_base") + more).cast("long")
    return mixed.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("_source").alias(source_col), F.col("_h").alias("place"))


def refine(sizes: DataFrame, bounds: DataFrame, shift: int, last: bool) -> DataFrame:
    """One step: words by bucket inside each source's boundary bucket, and where the budget ends in them."""
    wide = BITS * LEVELS - shift - BITS  # bits fixed so far
    inside = sizes.join(bounds, sizes["_source"].eqNullSafe(bounds["_s"]))
    if wide:
        inside = inside.filter(F.shiftright("_h", shift + BITS) == F.col("_at"))
    buckets = inside.groupBy("_s", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.first("_budget").alias("_budget"), F.first("_used").alias("_used"))
    order = Window.partitionBy("_s").orderBy("_bucket")
    buckets = buckets.withColumn("_upto", F.col("_used") + F.sum("_sum").over(order))
    over = buckets.filter(F.col("_upto") > F.col("_budget"))
    first = over.groupBy("_s").agg(F.min_by(F.struct("_bucket", "_budget", "_upto", "_sum"), "_bucket").alias("_x"))
    first = first.select("_s", F.col("_x._budget").alias("_budget"), F.col("_x._bucket").alias("_at"), (F.col("_x._upto") - F.col("_x._sum")).alias("_used"), F.col("_x._upto").alias("_upto"))
    if not last:
        return first.drop("_upto")
    nearer = F.col("_upto") - F.col("_budget") < F.col("_budget") - F.col("_used")
    return first.select("_s", (F.col("_at") + nearer.cast("long")).alias("_limit"))


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: dropped, once, or repeated. Columns of any name are allowed."""
    taken = mix_sources(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s")), id_col="i", text_col="t", source_col="s", **more)
    cid, cx, cs, times, turn, x = (free_name(stem, docs.columns) for stem in ("_cid", "_cx", "_cs", "_copies", "_turn", "_x"))
    copies = taken.groupBy(F.col("i").alias(cid), F.col("place").alias(cx), F.col("s").alias(cs)).agg(F.max("copies").alias(times))
    same = F.col(id_col).eqNullSafe(F.col(cid)) & F.col(source_col).cast("string").eqNullSafe(F.col(cs)) & (F.col(x) == F.col(cx))
    joined = docs.withColumn(x, doc_hash(F.col(id_col), F.col(text_col))).join(copies, same).filter(F.col(times) > 0)
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
