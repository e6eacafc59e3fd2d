"""The corpus pipeline: documents in, token ids in rANS containers out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the result is written as Parquet and read again, so a stage begins by deleting
what the operators of earlier ones left in the shared folder.  All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, mixing, near_dedup, quality, token_output
from quillstone.llm.common import materialise, release, table
from quillstone.llm.queries import tokenizer_path


def _begin(spark: SparkSession, docs: DataFrame) -> None:
    """Delete what the stages before left: their results have been written, and ``docs`` is read from there."""
    release(spark, *([docs] if hasattr(docs, "_written_to") else []))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (9) does not reject."""
    _begin(spark, docs)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (4): the smallest id."""
    _begin(spark, docs)
    return near_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (10)."""
    _begin(spark, docs)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix (7) takes, each document as often as it takes it."""
    _begin(spark, docs)
    return mixing.take(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (3) of the mix, written as containers and indexed from them."""
    _begin(spark, docs)
    return token_output.token_output(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: No SQL: sampling, alignment and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    release(spark, docs)
    return docs
