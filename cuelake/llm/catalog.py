"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, lexical_search, license_scan, media, mixing, ngram_join, personal_data, quality_classifier, quality_rules, spelling, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license": license_scan.op1_license,
        "op2_bpe": bpe.op2_bpe,
        "op3_media": media.op3_media,
        "op4_language": language.op4_language,
        "op5_rules": quality_rules.op5_rules,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality": quality_classifier.op10_quality,
        "op11_search": lexical_search.op11_search,
        "op12_spelling": spelling.op12_spelling,
        "op13_pii": personal_data.op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license": license_scan.OP1_SQL,
        "op5_rules": quality_rules.OP5_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op7_ngram_join": ngram_join.OP7_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op11_search": lexical_search.OP11_SQL,
        "op12_spelling": spelling.OP12_SQL,
        "op13_pii": personal_data.OP13_SQL,
    }
