"""Canonical tables of an archive, and how older or partial tables are brought to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CALL = "struct<id: string, tool: string, input: string, output: string, status: string, truncated: boolean, is_error: boolean, duration_ms: double, extra: map<string, string>>"
_EVENT = "struct<name: string, status: string, duration_ms: double, is_error: boolean, dropped: int>"

SESSIONS = (
    "id string, tool string, project string, thread_id string, title string, created timestamp_ntz, updated timestamp_ntz, source_path string, source_mtime_ns bigint, "
    "git_branch string, git_commit string, cli_version string, metadata map<string, string>, messages_count int, prompt_count int, prompt_outline string, export_path string, "
    "total_tokens bigint, messages_synced boolean, origin string, parent_session_id string, relation string, source_version string, parser_version int, source_revision_id bigint, "
    "source_namespace string, source_record_id string, content_sha256 string, copy_of_session_id string"
)
MESSAGES = (
    "session_id string, seq int, role string, content string, timestamp timestamp_ntz, model string, tokens map<string, bigint>, kind string, parent_id string, active boolean, "
    f"tool_events array<{_EVENT}>, reasoning string, native_id string, content_blocks string, tool_calls array<{_CALL}>, status string, extensions string, envelope_version int"
)
MEMORY = (
    "id bigint, kind string, title string, body string, scope_project string, scope_tool string, author string, created timestamp, updated timestamp, superseded_by bigint, metadata string, status string"
)
VECTORS = ("entity_type string, entity_key string, model string, content_hash string, embedding array<float>")

#: What a missing column holds.
DEFAULTS = {"origin": "unknown", "kind": "text", "active": True, "envelope_version": 0, "status": "unknown", "messages_count": 0, "prompt_count": 0, "parser_version": 0, "relation": "none"}


def with_defaults(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of schema: missing ones get their default or null, others are cast."""
    have, schema = set(df.columns), StructType.fromDDL(schema)
    return df.select(*((F.coalesce(F.col(f"`{f.name}`"), F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def one_of(col: Column, values: tuple[str, ...], default: str) -> Column:
    """col where it is one of values, else the default."""
    return F.when(col.isin(*values), col).otherwise(F.lit(default))
