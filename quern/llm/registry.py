"""All queries of this package and their SQL."""

from __future__ import annotations

from . import chat, codes, exact_dedup, leaks, lm, mixing, near_dedup, privacy, runs, secrets, suffix_dedup, toxicity, wrapper

_MODULES = (lm, exact_dedup, suffix_dedup, secrets, near_dedup, leaks, wrapper, chat, mixing, toxicity, privacy, runs, codes)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
