"""Queries of this subpackage, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_text, langid, line_dedup, mixing, near_dedup, quality, secrets, token_output
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: fixed patterns and entropy spans."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_ads_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through rANS containers and back."""
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_cws_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_centroid_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that many sites share, as counts and a digest."""
    out = line_dedup.decided(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_qgram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ads_search": op2_ads_search,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_cws_neardup": op4_cws_neardup,
    "op5_centroid_lang": op5_centroid_lang,
    "op6_line_spread": op6_line_spread,
    "op7_fair_mix": op7_fair_mix,
    "op8_template_text": op8_template_text,
    "op9_qda_quality": op9_qda_quality,
    "op10_qgram_decontam": op10_qgram_decontam,
}
ORACLE_SQL: dict[str, str] = {
    "op6_line_spread": line_dedup.SQL,
    "op7_fair_mix": mixing.SQL,
}
