"""Evaluation suites: JSON documents with ``cases`` and ``stream_cases``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRINGS = "array<string>"
SUITE_SCHEMA = (
    "version int, minimum_pass_rate double, "
    "cases array<struct<id: string, category: string, query: string, "
    f"expected_agents: {_STRINGS}, expected_source_paths_any: {_STRINGS}, "
    f"expected_source_paths_all: {_STRINGS}, answer_term_groups: array<{_STRINGS}>, "
    "expect_partial: boolean>>, "
    "stream_cases array<struct<id: string, query: string, required_events: array<string>, "
    "minimum_token_events: int>>"
)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUITE_SCHEMA).json(path, multiLine=True)


def _chosen(rows: DataFrame, case_ids: list[str] | None) -> DataFrame:
    return rows.filter(F.col("id").isin(*case_ids)) if case_ids else rows


def cases(suite: DataFrame, case_ids: list[str] | None = None) -> DataFrame:
    """Golden cases with absent lists empty and absent expectations false."""
    rows = _chosen(suite.select(F.explode("cases").alias("case")).select("case.*"), case_ids)
    nothing = F.array().cast(_STRINGS)
    lists = ["expected_agents", "expected_source_paths_any", "expected_source_paths_all"]
    return rows.withColumns(
        {
            **{name: F.coalesce(name, nothing) for name in lists},
            "answer_term_groups": F.coalesce(
                "answer_term_groups", F.array().cast(f"array<{_STRINGS}>")
            ),
            "expect_partial": F.coalesce("expect_partial", F.lit(False)),
        }
    )


def stream_cases(suite: DataFrame, case_ids: list[str] | None = None) -> DataFrame:
    return _chosen(suite.select(F.explode("stream_cases").alias("case")).select("case.*"), case_ids)


def unknown_ids(suite: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids (column ``id``) that no case of the suite has."""
    known = suite.select(F.explode(F.array_union("cases.id", "stream_cases.id")).alias("id"))
    return wanted.join(known, "id", "left_anti")
