"""Queries of the training-data operators, one per operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op2_suffix_dedup": "suffix_dedup",
    "op6_jaccard_join": "jaccard_join",
    "op3_chat_format": "chat_format",
    "op5_url_filter": "url_filter",
    "op4_quality_rules": "quality_rules",
    "op7_language_id": "language_id",
    "op8_sharding": "sharding",
    "op9_decontamination": "decontamination",
    "op1_token_counts": "token_counts",
    "op10_bpe_codec": "bpe_codec",
    "op11_centroid_clustering": "centroid_clustering",
    "op12_media_columns": "media_columns",
    "op13_hard_negatives": "hard_negatives",
}


def queries() -> dict:
    return {name: getattr(import_module(f"rasterloom.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        made = getattr(import_module(f"rasterloom.llm.{module}"), "oracle_sql", None)
        sql = made() if made else getattr(import_module(f"rasterloom.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
