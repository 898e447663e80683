"""All queries of the subpackage with the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from . import p1_forest, p2_mainbody, p3_terms, p5_language, p6_lines, p8_tokens, p9_leaks, p10_garbled

_MODULES = (p1_forest, p2_mainbody, p3_terms, p5_language, p6_lines, p8_tokens, p9_leaks, p10_garbled)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
