"""All registered queries outside text preparation, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import composites, relational, retrieval, study, texts

MODULES = (retrieval, texts, study, relational, composites)
FLAGSHIP = "hybrid_search"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
