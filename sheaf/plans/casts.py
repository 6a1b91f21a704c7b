"""Types of twins' columns where the dialect's own (decimals, wide sums) differ from the query's."""

from __future__ import annotations

CASTS: dict[str, dict[str, str]] = {
    "entropy_proxy": {"entropy": "DOUBLE"},
    "classify_rules": {"confidence": "DOUBLE"},
    "satellite_stage": {"confidence": "DOUBLE"},
    "clean_stats": {"chars_after": "BIGINT", "chars_before": "BIGINT", "chars_removed": "BIGINT"},
    "bm25_tokens": {"n_tokens": "INTEGER"},
    "sentence_split": {"idx": "INTEGER"},
    "hard_boundary": {"idx": "INTEGER"},
    "chunk_ids": {"char_count": "INTEGER"},
    "full_text_build": {"n": "INTEGER"},
    "postings": {"doc_len": "INTEGER"},
    "sparse_topk": {"sparse_rank": "INTEGER"},
    "sparse_after_changes": {"sparse_rank": "INTEGER"},
    "vector_lists_all": {"dense_rank": "INTEGER"},
    "dense_topk": {"dense_rank": "INTEGER"},
    "hybrid_topk": {"rank": "INTEGER"},
    "gate_hybrid_topk": {"rank": "INTEGER"},
    "rrf_topk": {"dense_rank": "INTEGER", "rank": "INTEGER", "sparse_rank": "INTEGER"},
    "method_compare": {"rank": "INTEGER"},
    "authority_rerank": {"ra_rank": "INTEGER"},
    "final_trust": {"mscp_score": "DOUBLE"},
    "temporal_decay": {"temporal_rank": "INTEGER"},
    "provenance_split": {"idx": "INTEGER"},
    "provenance_overlap": {"idx": "INTEGER"},
    "document_stats": {"cells": "BIGINT", "chars": "BIGINT"},
    "vector_export": {"authority_score": "DOUBLE"},
    "link_scrape": {"idx": "INTEGER"},
    "index_status": {"n_postings": "INTEGER", "n_terms": "INTEGER"},
    "service_replies": {"avg_temp": "DOUBLE", "et0": "DOUBLE"},
    "json_to_parquet": {"char_count": "INTEGER"},
    "auto_metadata": {"authority_score": "DOUBLE"},
    "reply_match": {"combined_score": "DOUBLE", "confidence": "DOUBLE"},
}


def typed(name: str, sql: str) -> str:
    casts = CASTS.get(name)
    if not casts:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in casts.items()) + f") FROM ({sql})"
