"""All queries of the llm subpackage, by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from tessella.llm import encoding_queries, near_duplicates_queries, personal_info_queries, proportions_queries, source_origin_queries, stable_sample_queries

_MODULES = (proportions_queries, near_duplicates_queries, source_origin_queries, stable_sample_queries, encoding_queries, personal_info_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLE.items()}
