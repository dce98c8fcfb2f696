"""Columns of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Table definitions. Times are wall-clock UTC.
DDL = {
    "symbols": "id long, name string, kind string, file string, start_line int, end_line int, code string, fqn string, "
               "project_path string, skeleton string, embed_hash string, source string, version timestamp_ntz",
    "edges": "source_file string, source_symbol string, target string, kind string, project_path string, version timestamp_ntz",
    "summaries": "file string, name string, summary_text string, content_hash string, project_path string, created_at timestamp_ntz",
    "vectors": "symbol_id long, content_hash string, embedding array<float>, doc_type string, source_file string, name string, "
               "kind string, project_path string",
    "indexed_files": "file string, project_path string, indexed_at timestamp_ntz",
    "doc_sources": "id string, name string, type string, url string, version string, last_updated timestamp_ntz, created_at timestamp_ntz",
    "doc_content": "chunk_id string, source_id string, title string, content string, path string, content_hash string, "
                   "updated_at timestamp_ntz",
    "context_notes": "ref string, session_id string, project_path string, label string, content string, content_hash string, "
                     "tags string, kind string, metadata_json string, token_est int, created_at timestamp_ntz",
    "note_tombstones": "ref string, token_est int",
    "kv_repair_events": "session_id string, project_path string, ref string, repair_reason string, outcome string, model_id string, "
                        "kv_quant string, token_est int, detail string, created_at timestamp_ntz",
    "structured_memory": "ref string, kind string, scope string, session_id string, project_path string, subject string, "
                         "predicate string, object string, rule string, source_ref string, token_est int, "
                         "invalidate_previous boolean, valid_from timestamp_ntz",
    "memory_tombstones": "ref string, forgotten_at timestamp_ntz, token_est int",
    "queries": "id long, timestamp timestamp_ntz, tool_name string, arguments string, result_chars int, duration_ms double, "
               "cpu_ms double, session_id string, error string, project_path string, tokens_saved int, dedup_tokens_saved int, "
               "savings_vs_files int, symbol_baseline_tokens int, output_tokens int, tokens_used int, file_baseline_tokens int, "
               "cache_hit int",
    "sessions": "session_id string, file string, name string, start_line int, mode string, token_count int, returned_at timestamp_ntz",
    "settings": "key string, value string, updated_at timestamp_ntz",
    "context_note_access": "ref string, session_id string, project_path string, tool_name string, virtual_tokens int, "
                           "repair_reason string, accessed_at timestamp_ntz",
    "memory_access": "ref string, session_id string, project_path string, tool_name string, tokens_returned int, accessed_at timestamp_ntz",
    "embed_requests": "kind string, unit string, project_path string, lane int, requested_at timestamp_ntz",
    "embed_passes": "pass_id string, kind string, unit string, project_path string",
    "embed_attempts": "kind string, unit string, project_path string, ok boolean, error string, attempted_at timestamp_ntz",
    "project_links": "parent_path string, child_path string, auto_linked boolean, created_at timestamp_ntz",
}

# Tables whose scans are pruned by project.
PARTITIONS = {"symbols": ["project_path"], "edges": ["project_path"], "vectors": ["project_path"]}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])
