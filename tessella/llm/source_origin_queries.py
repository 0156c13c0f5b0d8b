"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.source_origin import origins
from tessella.sources.tables import table


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return origins(table(spark, d, "source_files"), table(spark, d, "commits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are generated, minified, copied from elsewhere or data in the form of code."""
    return _origins(spark, d).where("not_hand_written").select("file_id")


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each file with its reasons."""
    return _origins(spark, d)


QUERIES = {"p3_found": p3_found, "p3_evidence": p3_evidence}
ORACLE: dict[str, str] = {}
