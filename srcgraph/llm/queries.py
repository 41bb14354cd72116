"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import (
    decontamination, extraction, hard_negatives, language, licenses, lm_scoring, merkle, mixing, ngram_join, packing, quality, spotsigs, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1,
    "op2_lm_scoring": lm_scoring.op2,
    "op3_packing": packing.op3,
    "op4_ngram_jaccard_join": ngram_join.op4,
    "op5_toxicity": toxicity.op5,
    "op6_spotsigs": spotsigs.op6,
    "op7_license_scan": licenses.op7,
    "op8_language_id": language.op8,
    "op9_html_extraction": extraction.op9,
    "op10_source_mixing": mixing.op10,
    "op11_decontamination": decontamination.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_merkle_manifest": merkle.op13,
}
ORACLES: dict[str, str] = {
    "op2_lm_scoring": lm_scoring.OP2_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op1_quality_rules": quality.OP1_SQL,
    "op11_decontamination": decontamination.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
