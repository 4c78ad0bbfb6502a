"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "op1_toxicity": "toxicity",
    "op2_quotation_linking": "quotation",
    "op3_byte_bpe": "byte_bpe",
    "op4_passages": "passages",
    "op5_near_dup": "near_dup",
    "op6_source_mix": "mixing",
    "op7_ivf_pq": "ivf_pq",
    "op8_nn_descent": "nn_descent",
    "op9_language_id": "language_id",
    "op10_jump_shards": "jump_shards",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"dustline.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in NAMES.items():
        sql = getattr(import_module(f"dustline.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
