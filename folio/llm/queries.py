"""The registered queries of the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import (
    conversation_trie, decontamination, html_text, license_scan, minhash_forest, quality_ranking, secret_scan, sharding,
    simhash_dedup, source_divergence, source_mixing, syncmers, toxic_spans,
)
from folio.sources.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sids").cast("long").alias("n_sentences"), F.array_join("sids", ",").alias("sentence_ids"),
        F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
    )


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the offending spans as ``start:end``."""
    found = toxic_spans.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    listed = F.transform("spans", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string")))
    return found.withColumn("spans", F.array_join(listed, ","))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.print_text("fp").alias("fingerprint"), syncmers.print_text("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document's source stands for its repository and owner."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda c: c["kind"] != "token")

    def count(part: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda c: c[part] == value)).cast("long").alias(f"n_{value}")

    return found.select(
        "doc_id",
        *[count("kind", k) for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
        *[count("verdict", v) for v in ("live", "shared", "example")],
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Every document's place among 24 shards, under the law ``key``; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = docs.select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(slim, "doc_id", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 5:2:1 mix of all sources takes from every document."""
    found = source_mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items).drop("items")


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry quality of every document."""
    return quality_ranking.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document by the overlap of its five-word shingles."""
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each with the head of its block's first."""
    lists = conversation_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(lists))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of a language from the others and from the whole."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_toxic_spans": op4_toxic_spans,
    "op5_quality_ranking": op5_quality_ranking,
    "op6_source_mixing": op6_source_mixing,
    "op7_syncmer_fingerprints": op7_syncmer_fingerprints,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_secret_ownership": op9_secret_ownership,
    "op10_html_text": op10_html_text,
    "op11_minhash_forest": op11_minhash_forest,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_divergence": op13_source_divergence,
}
