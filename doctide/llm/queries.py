"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("divergence", "licenses", "lines", "lm", "manifest", "minhash", "mixing", "packing", "quality", "repeats", "simhash", "topk", "urls")


def load() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
