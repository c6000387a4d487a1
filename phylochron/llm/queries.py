"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query: module of this package that defines it, and its SQL as ORACLE_SQL where there is one.
MODULES = {
    "op1_quality": "op1_quality",
    "op2_toxicity": "op2_toxicity",
    "op3_warc": "op3_warc",
    "op4_language": "op4_language",
    "op5_mixing": "op5_mixing",
    "op6_packing": "op6_packing",
    "op7_embeddings": "op7_embeddings",
    "op8_lm": "op8_lm",
    "op9_pii": "op9_pii",
    "op10_jaccard": "op10_jaccard",
    "op11_codes": "op11_codes",
    "op12_chat": "op12_chat",
    "op13_middle": "op13_middle",
}


def _lazy(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
