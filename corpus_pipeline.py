"""The training-data pipeline over ``documents``: five stages, each of which works on what its predecessor kept.

An empty table goes through all stages as one; columns beside doc_id, text and source pass through the first four, whatever
their names (n_chars follows a text that lost lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoflow.llm import decontaminate, mix_sources, near_dedup, quality_lines, queries, token_records
from chronoflow.llm.store import dropped, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequencies of their source keep, without the lines that are above the
    limit. A null or empty text fails; a null source is one of its own; equal rows stay or go alike."""
    return quality_lines.kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more. Documents with null
    ids are linked too; of equal rows one stays."""
    return near_dedup.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts and items hold nothing and stay; without items
    all stay; equal rows stay or go alike."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, which may be not at all. A null source is a source; texts
    without words are not taken; equal rows are documents of their own."""
    return mix_sources.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token records, read back: doc_id, start, n_tokens, ids_crc32. A null or empty text is its end
    alone; copies of a document keep a record each; a null doc_id comes first."""
    return token_records.token_records(docs, queries.tokenizer_path())


STAGES = [("quality rules", quality), ("near-duplicate removal", dedup), ("benchmark decontamination", decontamination), ("mixing", mixing), ("token records", tokens)]

# The tokenizer and the similarity search are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result but the last written before the next stage reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
            dropped(before)
    return docs
