"""All queries of the library, but those of the corpus operators."""

from __future__ import annotations

from mnemion.plans import alignment, documents, graph, knowledge, mail, mining, operations, retrieval, temporal

MODULES = (temporal, graph, retrieval, documents, operations, knowledge, mining, mail, alignment)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
