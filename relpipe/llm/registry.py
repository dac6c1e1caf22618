"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_embedding_near_dedup": "vectordedup",
    "op2_toxicity": "toxicity",
    "op3_order_minhash": "orderminhash",
    "op4_pii": "pii",
    "op5_url_filters": "urlfilter",
    "op6_language_id": "langid",
    "op7_mixing": "mixing",
    "op8_simhash_near_dedup": "simhash",
    "op9_bpe": "bpe",
    "op10_quality": "quality",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"{__package__}.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
