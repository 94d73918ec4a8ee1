"""The queries of this subpackage: opN_<name>(spark, sf_dir), with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailframe.llm import alignment, collocations, decontaminate, html_text, jaccard, language, line_dedup, mixing, quality_net, quality_rules, tokens, toxicity, warc
from trailframe.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed line dedup of `documents`: doc_id, text, n_lines, lines_removed, words_removed."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of `pages`: page_id, url, text, n_chars, and the characters that templates and rules removed."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of `documents`, as labels.quality marks it: doc_id, held_out, score, predicted."""
    return quality_net.quality_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of `documents`: doc_id, held_out, lang_pred, score."""
    return language.language_documents(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among `documents`: doc_id, class_id, text_id, n_copies, n_links."""
    return jaccard.near_duplicate_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of `documents`: doc_id, size, source_size, target, taken, source, copies."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of `benchmark` in `documents`: doc_id, item_id, n_tokens, matched, near, coverage; a row for each leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on `documents`: doc_id, the base counts, base_failed, kept, line counts."""
    return quality_rules.quality_rule_documents(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of `documents` hold: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_files(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of `documents`, as labels.toxic marks it: doc_id, held_out, score, predicted."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of `documents`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return alignment.aligned_documents(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of `documents`, the best 2,000 of each language: lang, rank, phrase, a, l, r, n, score."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of `pages` hold, read by their index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_ids": op9_token_ids,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_warc": op13_warc,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_warc": warc.ORACLE_SQL}
