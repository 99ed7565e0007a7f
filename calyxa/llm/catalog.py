"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "near_dedup",
    "chat_format",
    "mixing",
    "decontaminate",
    "pii",
    "class_lm",
    "quality",
    "warc",
    "language_id",
    "embedding_dedup",
)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"calyxa.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"calyxa.llm.{m}").ORACLE_SQL.items()}
