"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.personal_info import find, mask
from tessella.sources.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each place where personal data starts."""
    return find(table(spark, d, "documents"), "doc_id").select("doc_id", "kind", "start_char").distinct()


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return mask(table(spark, d, "documents"), "doc_id")


QUERIES = {"p8_found": p8_found, "p8_masked": p8_masked}
ORACLE: dict[str, str] = {}
