"""All queries of the core, by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from tessella.plans import arms, assembly, audits, curves, governance, graph, hierarchy, provenance, selection, similarity

_MODULES = (curves, selection, hierarchy, graph, similarity, governance, assembly, provenance, audits, arms)
FLAGSHIP = curves.bin_table


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLE.items()}
