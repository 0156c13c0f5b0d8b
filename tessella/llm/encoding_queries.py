"""Queries of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.encoding import encode, token_counts
from tessella.llm.mixing import mix
from tessella.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, d, "documents"), "doc_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    return mix(counted, table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return _mixed(spark, d)[1].where("short").select("mix_id", "source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in each mix."""
    return _mixed(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual tokens and share of each source in each mix."""
    return _mixed(spark, d)[1]


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_mix": p7_mix, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
