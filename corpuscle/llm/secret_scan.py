"""Secret scans over every historical version of every path, by an incremental ledger of blobs.

A version's content is a blob, addressed by its SHA-256. The ledger says which blob was
scanned under which rule at which version and what was found there. A scan reads only the
texts of blobs for which some rule version is not in the ledger yet, one copy of each, and
joins the ledger's findings back to all paths and versions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import written


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped.

    ``version`` changes whenever what the rule finds may change. ``hints``: strings of
    which a text that the rule matches holds one (lower case where ``folded``); they only
    save time.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    folded: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    def spans(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in (lower if self.folded else text) for h in self.hints):
            return []
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


WORDS = ("password", "passwd", "secret", "token")
# The three kinds of the base, in this order.
BASE = (
    Rule("assign", 1, "(" + "|".join(map(either_case, WORDS)) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, (*WORDS, "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
RULES = (
    *BASE,
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ("eyJ",)),
    Rule("privatekey", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0, ("PRIVATE KEY",)),
    Rule("hosttoken", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0, ("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("chattoken", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 0, ("xox",)),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~!$&*+=-]{6,128}@[A-Za-z0-9]", 0, 0, ("://",)),
)
LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def scanner(rules: Sequence[Rule]):
    """For ``mapInPandas`` over ``blob, text, missing``: ledger rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_name = {r.name: r for r in rules}
        for batch in batches:
            spans = []
            for text, missing in zip(batch["text"], batch["missing"]):
                lower = text.lower()
                spans.append([{"rule": n, "start": a, "end": b} for n in missing for a, b in by_name[n].spans(text, lower)])
            yield pd.DataFrame({"blob": batch["blob"], "rules": batch["missing"], "spans": spans})

    return run


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], LEDGER)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blobs`` with ``missing``: the rule versions under which the ledger doesn't hold the blob; only where there are some."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    have = ledger.select("blob", F.explode("rules").alias("rule")).filter(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("have"))
    missing = F.when(F.col("have").isNull(), wanted).otherwise(F.array_except(wanted, "have"))
    return blobs.join(have, "blob", "left").withColumn("missing", missing).drop("have").filter(F.size("missing") > 0)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new rows, ``blob, rules, spans``: blobs of ``versions`` under the rule versions that it lacks.

    One row for each scanned blob, also where nothing was found. One copy of a blob is
    read: the row with the smallest id among those with its content.
    """
    ledger = empty_ledger(versions) if ledger is None else ledger
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(id_col).alias("path"), text.alias("text"))
    first = rows.select(blob_id(F.col("text")).alias("blob"), "path").groupBy("blob").agg(F.min("path").alias("from"))
    todo = unseen(first, ledger, rules).withColumnRenamed("blob", "of")
    # Only ids and digests stand in the hash tables; texts stream past them unsorted.
    copies = rows.withColumn("blob", blob_id(F.col("text"))).join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("from")))
    found = copies.select("blob", "text", "missing").mapInPandas(scanner(rules), LEDGER)
    # Rows that repeat an id and its text were scanned alike.
    return found.groupBy("blob").agg(F.any_value("rules").alias("rules"), F.any_value("spans").alias("spans"))


def path_findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, blob, spans`` for every row of ``versions``: the ledger's findings under these rule versions.

    ``spans``: structs of start, rank, end and kind, by start and then by the order of ``rules``.
    """
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    each = ledger.select("blob", F.explode("spans").alias("s")).filter(F.col("s.rule").isin([r.name for r in rules]))
    spans = each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("s.start", ranks[F.col("s.rule")].alias("rank"), "s.end", kinds[F.col("s.rule")].alias("kind")))).alias("spans"))
    # Written, so that the join below has plain tables on both sides and Spark can split a blob that very many paths hold.
    spans = written(spans, "secret-spans")
    rows = versions.select(F.col(id_col).alias("path"), blob_id(F.col(text_col)).alias("blob"))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")
    return rows.join(spans, "blob", "left").select(F.col("path").alias(id_col), "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; findings of every path, and the ledger's new rows (a written table, to append).

    Findings, one row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, blob`` with starts and ends in code points, ends exclusive. Null texts count as
    empty; null ids and repeated rows are kept; texts of any length are scanned whole;
    other columns are ignored; an empty table gives an empty result.
    """
    new = written(scan_unseen(versions, ledger, rules, id_col, text_col), "secret-ledger")
    whole = new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)
    found = path_findings(versions, whole, rules, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in (r.kind for r in BASE)]
    out = found.select(id_col, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.hex("blob").alias("blob"))
    return out, new
