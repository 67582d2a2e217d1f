"""Order MinHash fingerprints, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a k-mer, sketches in a fingerprint, k-mers in a sketch.
K, SKETCHES, PER_SKETCH = 4, 24, 2
SPACE = r"[\x20\x09-\x0D]+"
#: Characters of scripts that put no spaces between words (from the CJK radicals on): each is a word of its own.
ALONE = r"[\x{2E80}-\x{D7FF}\x{F900}-\x{10FFFF}]"


def words_of(text):
    """The text's runs of characters that are no spaces, cut before and after every character of ``ALONE``."""
    cut = F.when(F.rlike(text, F.lit(ALONE)), F.split(text, f"{SPACE}|(?<={ALONE})|(?={ALONE})")).otherwise(F.split(text, SPACE))
    return F.array_remove(cut, "")


def kmer_hashes(text, k: int = K):
    """Hashes of the text's k-word runs in text order; a text of fewer words is one run; without words none."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(0), F.size("_h") - F.lit(k)), lambda i: F.xxhash64(*[F.get("_h", i + F.lit(j)) for j in range(k)]))
    return hashes, F.when(F.size("_h") == 0, F.array().cast("array<bigint>")).when(F.size("_h") < k, F.array(F.xxhash64("_h"))).otherwise(runs)


def sketches(rows: DataFrame, keys: list[str], text_col: str = "text", carry: str | None = None, k: int = K, m: int = SKETCHES, per: int = PER_SKETCH) -> DataFrame:
    """``keys, fingerprint array<long>``: the Order MinHash of each row's text; a text without words has a fingerprint of nulls.

    ``keys`` name a row. Every k-mer with its occurrence number (the how-manieth equal
    k-mer of the text it is) is hashed once; the hash deals it to one of ``m`` sketches
    and one of ``per`` strata in it. Each stratum selects its minimal k-mer; a sketch's
    selected k-mers are put in text order and hashed as a tuple. A sketch to which no
    k-mer falls is null.

    ``rows`` should lie partitioned by a column of ``keys``, then nothing here moves them:
    numbering, selection and tuples use that partitioning. ``carry`` names an
    ``array<long>`` column of facts that come out again (column ``carried``): they travel
    as k-mers at negative places, so that no join has to bring the texts together twice.
    """
    hashes, runs = kmer_hashes(F.col(text_col), k)
    extra = F.coalesce(F.col(carry), F.array().cast("array<bigint>")) if carry else F.array().cast("array<bigint>")
    each = rows.select(*keys, extra.alias("_c"), hashes.alias("_h"))
    each = each.select(*keys, F.size("_c").alias("_nc"), F.posexplode(F.concat("_c", runs)).alias("_at", "_kmer"))
    each = each.select(*keys, (F.col("_at") - F.col("_nc")).alias("_pos"), "_kmer")
    # The hash leads the sort, so that almost every comparison ends at its prefix.
    number = F.row_number().over(Window.partitionBy("_kmer", *keys).orderBy("_pos"))
    fact = F.col("_pos") < 0
    each = each.select(*keys, "_pos", F.when(fact, F.col("_kmer")).otherwise(F.xxhash64("_kmer", number)).alias("_v"))
    sketch = F.when(fact, F.col("_pos")).otherwise(F.pmod(F.col("_v"), F.lit(m)).cast("int"))
    stratum = F.when(fact, F.lit(0)).otherwise(F.pmod(F.shiftrightunsigned("_v", 40), F.lit(per)).cast("int"))
    picks = []
    for j in range(per):
        own = F.when(F.col("_stratum") == j, F.col("_v"))
        picks += [F.min(own).alias(f"_v{j}"), F.min_by("_pos", own).alias(f"_p{j}")]
    each = each.select(*keys, "_pos", "_v", sketch.alias("_sketch"), stratum.alias("_stratum"))
    least = each.groupBy(*keys, "_sketch").agg(*picks)
    # At most m rows and the facts for each text from here on. In text order, strata without a k-mer left out.
    chosen = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"_p{j}").alias("p"), F.col(f"_v{j}").alias("v")) for j in range(per)]), lambda x: x["v"].isNotNull()))
    tuple_ = F.when(F.col("_sketch") < 0, F.col("_v0")).otherwise(F.xxhash64(F.transform(chosen, lambda x: x["v"])))
    least = least.select(*keys, "_sketch", tuple_.alias("_tuple"))
    least = least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_sketch", "_tuple"))).alias("_all"))
    prints = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.try_element_at("_all", i))
    facts = F.array_sort(F.filter(F.map_keys("_all"), lambda i: i < 0))
    return least.select(*keys, prints.alias("fingerprint"), F.transform(facts, lambda i: F.try_element_at("_all", i)).alias("carried"))


def likeness(a, b):
    """Share of sketches on which two fingerprints agree, of those that either has; 1 for two without any, 0 for one."""
    pairs = F.arrays_zip(F.coalesce(a, F.array().cast("array<bigint>")).alias("a"), F.coalesce(b, F.array().cast("array<bigint>")).alias("b"))
    either = F.size(F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    both = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_text(fingerprint):
    """Sketches as 16 hexadecimal digits each (``-`` for an empty one); a text without words is the empty string."""
    some = F.exists(fingerprint, lambda x: x.isNotNull())
    return F.when(some, F.concat_ws("", F.transform(fingerprint, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-"))))).otherwise(F.lit(""))


def id_ranges(keys: DataFrame, ranges: int, most_sample: int = 65536) -> F.Column:
    """Number of each row's range of ``_id, _x``: ranges of about as many rows each, at most ``ranges``.

    The bounds are quantiles of a random sample of at most ``most_sample`` rows (64 for each
    range, as long as that many are allowed), so they follow the ids however these cluster.
    They only deal out work; no result depends on them. A row finds its range by halving.
    """
    step = max(1, min(64, most_sample // ranges))
    sample = keys.orderBy(F.rand(7)).limit(step * ranges).agg(F.array_sort(F.collect_list(F.struct("_id", "_x"))).alias("_all"))
    bounds = F.array_distinct(F.filter("_all", lambda _, i: (i > 0) & (F.pmod(i, F.lit(step)) == 0)))
    kind = f"array<struct<_id:{keys.schema['_id'].dataType.simpleString()},_x:bigint>>"
    n, found = sample.select(F.size(bounds), F.to_json(bounds, {"ignoreNullFields": "false"})).first()
    bounds = F.from_json(F.lit(found), kind)
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)]) if n else F.array().cast("array<int>")
    # The key travels along, so that the text's hash in it is taken once.
    further = lambda now, by: (now["at"] + by <= n) & (F.get(bounds, now["at"] + by - 1) <= now["key"])
    start = F.struct(F.lit(0).alias("at"), F.struct("_id", "_x").alias("key"))
    return F.aggregate(steps, start, lambda now, by: F.struct(F.when(further(now, by), now["at"] + by).otherwise(now["at"]).alias("at"), now["key"].alias("key")), lambda now: now["at"])


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1000, most_ranges: int = 65536, chars_per_part: int = 4_000_000) -> DataFrame:
    """Rows with the text of the next row in descending id order (after the last: the first).

    Returns ``_range, _rn, _guest, _id, _text, _next``. Rows are cut into ranges of ids and
    texts' hashes (:func:`id_ranges`); one exchange brings a range together, and a window
    there looks one row ahead. The row that a range's last row needs, the first of the next
    lower range, comes along as a guest (``_guest`` true, to be left out in the end); there
    is one for each range, and ranges are at most ``most_ranges``. Equal ids, null ones too,
    are ordered by text and may lie in several ranges; null ids come last. Whole numbers
    are compared as such, ids of other types in Spark's order of that type.
    """
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select((F.col(id_col).cast("long") if whole else F.col(id_col)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_x"))
    n, chars = rows.select(F.count(F.lit(1)), F.sum(F.char_length("_text"))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(chars or 0) // chars_per_part))
    rows = rows.withColumn("_range", id_ranges(rows.select("_id", "_x"), max(1, min(most_ranges, n // rows_per_range))))
    firsts = rows.groupBy("_range").agg(F.max(F.struct("_id", "_x")).alias("_first"))
    # One row for each range, at most most_ranges of them.
    up = Window.orderBy(F.col("_range"))
    firsts = firsts.select("_first", F.coalesce(F.lead("_range").over(up), F.min("_range").over(Window.partitionBy(F.lit(1)))).alias("_to"))
    firsts = firsts.select(F.col("_first._id").alias("_fid"), F.col("_first._x").alias("_fx"), "_to")
    guests = rows.join(F.broadcast(firsts), F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_x") == F.col("_fx")))
    guests = guests.groupBy("_to", "_id").agg(F.max("_text").alias("_text"))
    both = rows.select("_range", F.lit(False).alias("_guest"), "_id", "_text").unionByName(guests.select(F.col("_to").alias("_range"), F.lit(True).alias("_guest"), "_id", "_text"))
    ahead = Window.partitionBy("_range").orderBy("_guest", F.col("_id").desc_nulls_last(), F.xxhash64("_text").desc(), "_text")
    return both.repartition(parts, "_range").select("_range", "_guest", "_id", "_text", F.lead("_text").over(ahead).alias("_next"), F.row_number().over(ahead).alias("_rn"))


#: Hexadecimal digits of an id in one long.
DIGITS = 14


def id_facts(kind: T.DataType) -> F.Column:
    """Column ``_id`` as longs: itself, or the number of its text's hexadecimal digits (null for a null id) and these."""
    if isinstance(kind, T.LongType):
        return F.array("_id")
    hexed = F.hex(F.col("_id").cast("string").cast("binary"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(hexed) + DIGITS - 1) / DIGITS).cast("int")), lambda i: F.conv(F.substring(hexed, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))
    return F.concat(F.array(F.length(hexed).cast("long")), F.coalesce(pieces, F.array().cast("array<bigint>")))


def id_of(facts, at: int, kind: T.DataType) -> F.Column:
    """The id that :func:`id_facts` wrote from place ``at`` on."""
    first = F.get(facts, F.lit(at))
    if isinstance(kind, T.LongType):
        return first
    size = first.cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((size + DIGITS - 1) / DIGITS).cast("int")), lambda i: F.lpad(F.hex(F.get(facts, i + at + 1)), F.least(F.lit(DIGITS), size - i * DIGITS), "0"))
    return F.when(size.isNotNull(), F.unhex(F.concat_ws("", F.filter(pieces, lambda x: x != "")))).cast("string").cast(kind)


def edited_text(text, after):
    """The last third of the text's code points replaced by the first as many of the next text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(after, F.lit(1), third))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row per input row. Null texts count as empty; a text
    without words has the empty fingerprint, which is like another empty one (1.0) and
    like nothing else (0.0). Equal texts have equal fingerprints. A single row is its own
    next row. Rows may repeat; ids may be of any type that can be ordered and written as
    text, and come back as they are (whole numbers as long). A very long text is one row of
    the exchange and is read whole. An empty table gives an empty result.
    """
    keys = ["_range", "_rn"]
    rows = beside_next(docs, id_col, text_col).withColumn("_edited", edited_text(F.col("_text"), F.coalesce("_next", F.lit(""))))
    sha = F.sha2(F.col("_edited").cast("binary"), 256)
    digits = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    kind = rows.schema["_id"].dataType
    facts = F.concat(F.array(F.col("_guest").cast("long"), F.char_length("_text").cast("long"), *digits), id_facts(kind))
    texts = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("_text").alias("t"), facts.alias("f")), F.struct(F.lit(1).alias("s"), F.col("_edited").alias("t"), F.lit(None).cast("array<bigint>").alias("f")))).alias("_x"))
    texts = texts.select(*keys, F.col("_x.s").alias("_side"), F.col("_x.t").alias("_t"), F.col("_x.f").alias("_f"))
    prints = sketches(texts, [*keys, "_side"], "_t", "_f")
    own = F.col("_side") == 0
    prints = prints.groupBy(*keys).agg(F.max(F.when(own, F.col("fingerprint"))).alias("_own"), F.max(F.when(~own, F.col("fingerprint"))).alias("_ed"), F.max(F.when(own, F.col("carried"))).alias("_f"))
    ahead = Window.partitionBy("_range").orderBy("_rn")
    done = prints.withColumn("_after", F.lead("_own").over(ahead)).filter(F.get("_f", F.lit(0)) == 0)
    hexed = [F.lpad(F.lower(F.hex(F.get("_f", F.lit(2 + i)))), 8, "0") for i in range(8)]
    done = done.select("_own", "_ed", "_after", id_of(F.col("_f"), 10, kind).alias("_id"), F.get("_f", F.lit(1)).alias("n_chars"), F.concat(*hexed).alias("edited_sha256"))
    return done.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_ed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_ed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )
