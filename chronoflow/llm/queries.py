"""The queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoflow.llm import chat_format, decontaminate, katz, mix_sources, near_dedup, page_text, periodic_runs, pii_spans, point_in_time, quality_lines, substring_dedup, token_records, warc_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The word-BPE vocabulary of the machine; a parameter of the operator, never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.digests(pii_spans.pii_spans(table(spark, sf_dir, "documents")))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archived(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix(table(spark, sf_dir, "documents"))


def op5_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.line_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(table(spark, sf_dir, "pages"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_conversations(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.repeated_ends(table(spark, sf_dir, "documents"))))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_in_time.point_in_time(*[table(spark, sf_dir, name) for name in ("clicks", "sales", "sale_lines")])


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii_spans": op1_pii_spans,
    "op2_warc_archive": op2_warc_archive,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_lines": op5_quality_lines,
    "op6_page_text": op6_page_text,
    "op7_token_records": op7_token_records,
    "op8_near_dedup": op8_near_dedup,
    "op9_katz": op9_katz,
    "op10_chat_format": op10_chat_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_point_in_time": op12_point_in_time,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL = {
    "op2_warc_archive": warc_archive.QUERY_SQL,
    "op5_quality_lines": quality_lines.QUERY_SQL,
    "op10_chat_format": chat_format.QUERY_SQL,
    "op12_point_in_time": point_in_time.QUERY_SQL,
}
