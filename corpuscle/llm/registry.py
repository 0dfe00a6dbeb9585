"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import alignment, chat, decontaminate, html_text, language, licences, mixing, neighbours, ngram_join, pieces, suffix_dedup, tokens, variants

MODULES = (licences, chat, neighbours, suffix_dedup, ngram_join, language, mixing, html_text, tokens, decontaminate, alignment, variants, pieces)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
