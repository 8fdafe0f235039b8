"""The pN_ queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import language, leakage, mixing, quality, scan, spelling, truncation
from lexforge.session import read_table


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


LABELLED = ("documents", "mdf_value_projections", "stage1_projections", "dictionaries", "language_samples", "common_words")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_found(tables(spark, sf_dir, *LABELLED))


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(tables(spark, sf_dir, *LABELLED)).dropDuplicates(["table_name", "row_id", "lang_found"])


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(tables(spark, sf_dir, *LABELLED))


CUT = ("dictionary_pages", "stage1_projections", "neighbor_pages", "dictionaries")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_found(tables(spark, sf_dir, *CUT))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_shares(tables(spark, sf_dir, *CUT))


SCANNED = ("neighbor_pages", "stage1_projections", "layout_blocks", "field_lines", "dictionaries", "language_samples")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.noise_found(tables(spark, sf_dir, *SCANNED))


def p3_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.returning_heads(tables(spark, sf_dir, *SCANNED))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.paragraphs(tables(spark, sf_dir, *SCANNED))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_found(tables(spark, sf_dir, "field_lines", "mdf_value_projections", "stage1_projections", "dictionaries"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [df.dropDuplicates(["row_id"]) for _, df in spelling.spelling_sources(tables(spark, sf_dir, "field_lines", "mdf_value_projections", "stage1_projections"))]
    return spelling.look_alike_groups(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "documents", "eval_items")
    return leakage.leaks_found(t["documents"], t["eval_items"])


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "documents", "eval_items")
    return leakage.removal_spans(t["documents"], t["eval_items"])


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "documents", "mix_targets")
    return mixing.mixed(t["documents"], t["mix_targets"])[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "documents", "mix_targets")
    return mixing.mixed(t["documents"], t["mix_targets"])[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "documents", "common_words")
    return quality.shapes_found(t["documents"], t["common_words"])


def p8_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "documents", "common_words")
    return quality.text_quality(t["documents"], t["common_words"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_languages": p1_languages, "p1_segments": p1_segments, "p2_found": p2_found, "p2_shares": p2_shares, "p3_found": p3_found, "p3_heads": p3_heads, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p6_spans": p6_spans, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_figures": p8_figures}
SQL: dict[str, str] = {}
