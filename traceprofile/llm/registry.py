"""Queries of the corpus operators, one per operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.llm import oracle

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _digested(kept: DataFrame, column: str) -> DataFrame:
    digest = F.sha2(F.col(column).cast("binary"), 256).alias("kept_sha256")
    return kept.select(*[c for c in kept.columns if c != column], digest)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.langid import language_report

    return language_report(_documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.decontaminate import find_leaks

    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.suffix_dedup import remove_earlier

    return _digested(remove_earlier(_documents(spark, sf_dir)), "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.licenses import license_report

    return license_report(_documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.jaccard_join import link_report

    return link_report(_documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.mixing import mix

    return mix(_documents(spark, sf_dir)).drop("source")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.html_text import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.fingerprints import fingerprint_report

    return fingerprint_report(_documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.substring_dedup import remove_repeats

    return _digested(remove_repeats(_documents(spark, sf_dir)), "text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.line_dedup import line_report

    return line_report(_documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.lexical_search import search

    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.conversation_repair import repair_report

    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceprofile.llm.toxicity import toxicity_report

    return toxicity_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_mix_sources": op6_mix_sources,
        "op7_html_text": op7_html_text,
        "op8_fingerprints": op8_fingerprints,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_repair_conversations": op12_repair_conversations,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
