"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["warc", "sharding", "ann", "packing", "licenses", "jaccard", "toxicity", "secretscan", "decontaminate", "suffixes", "runs", "divergence", "debruijn"]


def _all(what):
    for name in MODULES:
        yield what, importlib.import_module(f"chronofeat.llm.{name}")


def queries() -> dict:
    return {k: f for _, m in _all("q") for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: sql for _, m in _all("s") for k, sql in getattr(m, "SQL", {}).items()}
