"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

PAGE = "struct<page_number:int,text:string,tables_text:array<string>>"
EXTRACTED = f"filename string, pages array<{PAGE}>, total_pages int"
METADATA = "source_file string, title string, source_org string, publisher string, year int, authority_score double, bias_penalty double, domain string, region string"
CHUNK = (
    "chunk_id string, text string, char_count int, source_file string, title string, source_org string, region string, domain string, "
    "year int, authority_score double, bias_penalty double, trust_weight double, crop_tags array<string>"
)
TRIPLET = "subject string, relationship string, object string, confidence double, source_file string, chunk_text string, chunk_id string"
REGISTRY = "filename string, status string, chunks_created int, processed_at timestamp, chunk_ids array<string>, error string"
FEEDBACK = "query string, entropy double, path string, was_accurate boolean, ts timestamp"
GATE_LOG = "ts timestamp, query string, crop string, stage string, blocked_source string, blocked_reason string, matched_blocked_keyword string"
WEATHER = (
    "struct<current:struct<temperature:double,humidity:double,rain:double,wind:double,code:int>,"
    "daily:struct<date:array<string>,tmax:array<double>,tmin:array<double>,rain:array<double>,rain_prob:array<double>,et0:array<double>,uv:array<double>>>"
)
