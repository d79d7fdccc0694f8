"""Schemas of the code-corpus tables. Every read names its schema; none is inferred."""

from __future__ import annotations

FILES = "path string, content_hash string, size_bytes long, language string, role string, is_generated boolean, is_binary boolean, has_secrets boolean"
SYMBOLS = "fq_name string, name string, symbol_type string, file_path string, start_line int, end_line int, parent_fq_name string, signature string, docstring string"
RELATIONS = "src_type string, src_ref string, dst_type string, dst_ref string, relation_type string, confidence double, provenance string, origin_file string"
GIT_STATS = "file_path string, commit_count long, churn_30d long, last_modified_ts double, age_days long, authors array<string>, primary_author string, last_author string"
TIMELINE_EVENTS = "id long, project_root string, symbol_id string, event_type string, commit_sha string, timestamp double, author string, content_hash string, file_path string, qualified_name string, extra_json string, orphaned boolean"
RENAME_EDGES = "project_root string, old_symbol_id string, new_symbol_id string, commit_sha string, timestamp double, confidence double, is_candidate boolean"
SNAPSHOTS = "snapshot_id string, project_root string, tag string, head_sha string, timestamp double, symbol_count long, checksum string, tag_invalidated boolean, ref_kind string"
TRACES = "trace_id string, project string, query string, mode string, timestamp double, coverage string, stages array<struct<name:string,elapsed_ms:double,candidates:array<struct<path:string,score:double>>>>"
USAGE = "type string, timestamp string, sessionId string, message struct<usage:struct<input_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long,output_tokens:long>>"

# The domains of the enumerations.
SYMBOL_TYPES = ("module", "class", "function", "method", "variable", "constant", "import")
EVENT_TYPES = ("added", "modified", "removed", "renamed", "moved")
