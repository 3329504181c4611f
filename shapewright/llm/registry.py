"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query, module.
QUERIES = {
    "op1_mixing": "mixing",
    "op2_language_filters": "langid",
    "op3_debruijn_substrings": "substring",
    "op4_hilbert_sharding": "sharding",
    "op5_byte_bpe": "bpe",
    "op6_norm_sorted_topk": "topk",
    "op7_block_rules": "htmltext",
    "op8_reply_trees": "chat",
    "op9_consistent_parsing": "fingerprint",
    "op10_minhash_coordinates": "neardup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"shapewright.llm.{module}"), name.split("_")[0]) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """For what SQL can express. Schedules, learned models, merges, curves, parsers and fingerprints are tested by brute force."""
    from shapewright.llm.oracles import SQL

    return {name: SQL[name.split("_")[0]] for name in QUERIES if name.split("_")[0] in SQL}
