"""URL filters: host and path rules, then a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host and path). A rule fits its host and all subdomains.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Parameters that only say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="
BITS_PER_KEY, WORDS = 16, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; all empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One spelling of a page: no scheme, ``www.`` or ``m.``, closing slash or ``.html``, fragment or tracking parameters; the rest sorted."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def tracked(query: Column) -> Column:
    return F.exists(F.split(query, "&"), lambda p: p.rlike(TRACKING))


def masks(key: Column) -> list[Column]:
    """One bit in each of the eight words of a key's block, from eight times five bits of a hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """``_block, _w0 .. _w7``: a blocked Bloom filter as a table, built by one bit-wise aggregate; blocks without a key have no row."""
    bits = keys.select(F.pmod(F.xxhash64(key_col), F.lit(blocks)).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(masks(F.col(key_col)))])
    return bits.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def listed_urls(rows: DataFrame, listed: DataFrame, key_col: str) -> DataFrame:
    """``rows`` with ``_listed``: whether ``key_col`` is in ``listed`` (one column ``_key`` of distinct keys).

    Each key's block and bits are looked up in the Bloom filter, 256 bits a block and 16 a
    key. Rows that it rules out are done; only the possible hits go on to the join on the
    whole key, which removes the false positives. Spark picks broadcast or shuffle for
    both joins by measured size. Rows without a key are in no list and move nowhere.
    """
    none = rows.filter(F.col(key_col) == "").select(*rows.columns, F.lit(False).alias("_listed"))
    rows = rows.filter(F.col(key_col) != "")
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // (32 * WORDS)))
    bloom = bloom_filter(listed, "_key", blocks)
    probed = rows.withColumn("_b", F.pmod(F.xxhash64(key_col), F.lit(blocks))).join(bloom, F.col("_b") == F.col("_block"), "left")
    maybe = F.coalesce(F.col("_w0").bitwiseAND(masks(F.col(key_col))[0]) != 0, F.lit(False))
    for i, m in enumerate(masks(F.col(key_col))[1:], 1):
        maybe = maybe & F.coalesce(F.col(f"_w{i}").bitwiseAND(m) != 0, F.lit(False))
    probed = probed.select(*rows.columns, maybe.alias("_maybe"))
    hits = probed.filter("_maybe").join(listed, F.col(key_col) == F.col("_key"), "left").select(*rows.columns, F.col("_key").isNotNull().alias("_listed"))
    return hits.unionByName(probed.filter("NOT _maybe").select(*rows.columns, F.lit(False).alias("_listed"))).unionByName(none)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits, else null."""
    verdict = rule = None
    for v, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
    return verdict, rule


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every url: the longest fitting rule's, else block if its canonical form is in ``listed``.

    ``listed`` has one column ``url`` of raw urls (null and malformed ones list nothing).
    Returns ``page_id, host, path, rule, verdict, canonical, listed``, one row per input
    row; rows may repeat. Null urls and those without ``://`` have empty parts, fit no rule
    and are allowed. Empty tables give an empty result or list nothing.
    """
    host, path, query = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"), canonical(host, path, query).alias("_canon"))
    keys = listed.select(canonical(*url_parts(F.col("url"))).alias("_key")).filter("_key != ''").distinct()
    judged = listed_urls(rows, keys, "_canon")
    verdict, rule = best_rule(F.col("_host"), F.col("_path"), rules)
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_canon").alias("canonical"),
        F.col("_listed").alias("listed"),
    )


def campaign_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Urls that were fetched with tracking parameters: the list of campaign landing pages."""
    return pages.select(F.col(url_col).alias("url")).filter(tracked(url_parts(F.col(url_col))[2]))
