"""The queries of the corpus operators and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard, license_scan, line_dedup, mixing, quality, quoting, substring_dedup, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quoting.linked(table(spark, sf_dir, "conversations"))
    return d.select("conv_id", "position", "turn", "role", "reply_to", "n_quotes", "n_linked", F.sha2("text", 256).alias("text_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    d = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("matches")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality_rules(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lost_words").cast("long"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.read_bundles(*warc.write_bundles(warc.roles(table(spark, sf_dir, "pages"))))
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_quote_links, op3_line_dedup, op4_byte_bpe, op5_substring_dedup, op6_license_scan, op7_quality_rules, op8_jaccard_join, op9_source_mix, op10_warc_bundles)}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_quote_links": quoting.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op5_substring_dedup": substring_dedup.ORACLE, "op10_warc_bundles": warc.ORACLE}
