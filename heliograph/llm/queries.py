"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query, module, function, and the function that gives its SQL.
_QUERIES = (
    ("op1_secret_scan", "secret_scan", "op1", "op1_sql"),
    ("op2_source_mix", "mixing", "op2", None),
    ("op3_language_id", "language_id", "op3", None),
    ("op4_minhash_dedup", "minhash_dedup", "op4", "op4_sql"),
    ("op5_toxicity", "toxicity", "op5", None),
    ("op6_url_filter", "url_filter", "op6", None),
    ("op7_decontaminate", "decontaminate", "op7", None),
    ("op8_embedding_dedup", "embedding_dedup", "op8", "op8_sql"),
    ("op9_license_scan", "license_scan", "op9", None),
    ("op10_token_scan", "token_scan", "op10", None),
    ("op11_sessions", "sessions", "op11", "op11_sql"),
    ("op12_collocations", "collocations", "op12", "op12_sql"),
    ("op13_language_model", "language_model", "op13", None),
)


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"heliograph.llm.{module}"), f) for name, module, f, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"heliograph.llm.{module}"), sql)() for name, module, _, sql in _QUERIES if sql}
