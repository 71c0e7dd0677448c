"""The operators of this package as queries over the given tables, with SQL where it can say
the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from heatsheet.llm import (
    decontaminate,
    exact_dedup,
    language,
    language_model,
    licenses,
    near_dedup,
    packing,
    phrases,
    quality,
    spelling,
    substring_dedup,
    token_count,
    token_file,
)
from heatsheet.llm.common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: decontaminate.contaminated(
            read(s, d, "documents"), read(s, d, "benchmark")
        ),
        "op2_token_files": lambda s, d: token_file.token_files(read(s, d, "documents")),
        "op3_license_scan": lambda s, d: licenses.license_scan(read(s, d, "documents")),
        "op4_quality": lambda s, d: quality.quality(read(s, d, "documents"), read(s, d, "labels")),
        "op5_substring_dedup": lambda s, d: substring_dedup.repeated_bytes(read(s, d, "documents")),
        "op6_language": lambda s, d: language.language(read(s, d, "documents")),
        "op7_token_counts": lambda s, d: token_count.token_counts(read(s, d, "documents")),
        "op8_near_dedup": lambda s, d: near_dedup.near_duplicates(read(s, d, "documents")),
        "op9_packing": lambda s, d: packing.packed(read(s, d, "documents")),
        "op10_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(read(s, d, "documents")),
        "op11_collocations": lambda s, d: phrases.collocations(read(s, d, "documents")),
        "op12_spelling": lambda s, d: spelling.variants(read(s, d, "documents")),
        "op13_language_model": lambda s, d: language_model.log_probabilities(
            read(s, d, "documents")
        ),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
    }
