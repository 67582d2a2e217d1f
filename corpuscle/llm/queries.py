"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import exact_dedup, jaccard_join, katz, license_scan, mixing, order_minhash, packing, prefix_trie, secret_scan, token_alignment, token_count, toxicity, url_filter
from corpuscle.session import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens with their lexical neighbours."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def held_out(id_col: str, parts: int):
    """The fold that is not learned from: CRC-32 of the id as text modulo ``parts`` is 2; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 2, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("_id", 4))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a machine that learned from the other three folds' labels."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return order_minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template blocks of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of documents linked by 5-word shingles at a Jaccard similarity of 0.75."""
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under a Katz model of six sevenths of the documents."""
    return katz.katz_scores(table(spark, sf_dir, "documents"), ~held_out("_id", 7))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32,000 pieces of the public vocabulary."""
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source weights 5, 2, 1, repeating, at 150 % of all words."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, else by the list of campaign landing pages."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.campaign_urls(pages))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its group of equal texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of every document aligned, with corpus-wide counts of linked ids."""
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned into an empty ledger."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))[0]


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_order_minhash": op3_order_minhash,
    "op4_license_scan": op4_license_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_katz": op6_katz,
    "op7_token_count": op7_token_count,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_secret_scan": op13_secret_scan,
}
