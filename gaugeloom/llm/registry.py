"""Queries of this subpackage, each over its whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from importlib import import_module

MODULES = ("fingerprint", "line_dedup", "token_files", "language", "licenses", "toxicity", "packing", "decontaminate", "jaccard_join", "secrets", "whitening", "nearest", "prefix_tree")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(import_module(f"{__package__}.{m}"), "ORACLES", {}).items()}
