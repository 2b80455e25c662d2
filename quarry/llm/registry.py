"""Queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> (module, function of the documents or other table it reads).
_OPERATORS = {
    "op1_minhash_dedup": ("minhash_dedup", "deduplicate", "documents"),
    "op2_bootstrapped_pii": ("pii", "report", "documents"),
    "op3_chat_collapse": ("chat_format", "collapse", "conversations"),
    "op4_secret_scan": ("secret_scan", "report", "documents"),
    "op5_embedding_dedup": ("embed_dedup", "deduplicate", "embeddings"),
    "op6_mixing_lm": ("lm", "score", "documents"),
    "op7_bm25_topk": ("bm25_search", "search_hundredth", "documents"),
    "op8_mixture_packing": ("packing", "pack", "documents"),
    "op9_byte_bpe": ("bpe", "round_trip", "documents"),
    "op10_language_id": ("langid", "identify", "documents"),
    "op11_token_alignment": ("token_align", "report", "documents"),
    "op12_line_quality": ("quality", "judge", "documents"),
    "op13_periodic_runs": ("runs", "report", "documents"),
}


def _query(module: str, function: str, table: str):
    def run(spark, sf_dir):
        op = getattr(importlib.import_module(f"{__package__}.{module}"), function)
        return op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    run.__name__ = function
    return run


def queries():
    return {name: _query(*where) for name, where in _OPERATORS.items()}


def oracle_sql():
    out = {}
    for name, (module, _, _) in _OPERATORS.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
