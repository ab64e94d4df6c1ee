"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, line_dedup, ngram_join, packing, pii, quality_rules, token_output, url_filter, warc
from .common import read_table

#: The key of the pseudonyms in the registered query; a real run passes its own.
PSEUDONYM_KEY = "registered-query"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents: a row for each document and item that leaked into it."""
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that tries to forge turns, formatted and read back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame([(-1, 0, "user", chat_format.FORGED), (-1, 1, chat_format.ASSISTANT, chat_format.FORGED)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(forged)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts with personal values replaced by pseudonyms."""
    return pii.replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of the quality rules for all documents."""
    return quality_rules.assess(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts without the lines that repeat an earlier one."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_output.written_and_read(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as responses; their derived records, written as files and read back, with links and digests."""
    return warc.linked(warc.written_and_read(warc.derivatives(warc.responses_of(read_table(spark, sf_dir, "pages")))))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of each document."""
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's stages over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the subpackage by name."""
    found = (op1_decontamination, op2_chat_format, op3_pii, op4_quality_rules, op5_line_dedup, op6_url_filter, op7_token_output, op8_warc, op9_ngram_join, op10_packing, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express in reasonable time."""
    return {"op2_chat_format": chat_format.DIGEST_SQL, "op6_url_filter": url_filter.JUDGE_SQL}


__all__ = ["oracle_sql", "queries"]
