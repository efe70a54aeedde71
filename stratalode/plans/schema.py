"""Explicit schemas of all tables of the engine; readers never infer."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string


def _table(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


_DDL = {
    "app_state": "id string not null, active_profile_id string, active_layout_id string, theme_color string, theme_mode string, embedding_provider string, embedding_model string, embedding_device string, vulkan_device int, setup_completed_at timestamp",
    "workspace_layouts": "id string not null, name string, sort_order int, snapshot string, created_at timestamp, updated_at timestamp",
    "prompt_templates": "id string not null, name string, description string, system_prompt string, created_at timestamp, updated_at timestamp",
    "skills": "id string not null, name string, description string, instructions string, model_invocable boolean, created_at timestamp, updated_at timestamp",
    "sessions": "id string not null, title string, local_only boolean, created_at timestamp, updated_at timestamp",
    "session_messages": "id bigint not null, session_id string, role string, content string, metadata string, created_at timestamp",
    "notebook_state": "id string not null, active_notebook_id string, updated_at string",
    "notebooks": "id string not null, title string, active_page_id string, sort_order int, created_at string, updated_at string",
    "notebook_pages": "id string not null, notebook_id string, title string, content string, sort_order int, created_at string, updated_at string",
    "notebook_sources": "id string not null, notebook_id string, chunk_id string, created_at string",
    "custom_providers": "id string not null, type string, name string, base_url string, api_key string, created_at timestamp, updated_at timestamp",
    "profiles": "id string not null, name string, provider string, model string, max_tokens int, temperature double, top_k int, reasoning_budget int, retrieval_mode string, rag_top_k int, agent_max_turns int, gpu_mode string, enabled_tools array<string>, prompt_template_id string, persona string, created_at timestamp, updated_at timestamp",
    "documents": "id string not null, title string, source_path string, source_type string, origin string, active boolean, local_only boolean, created_at string, updated_at string",
    "tags": "name string not null, created_at string",
    "document_tags": "document_id string not null, tag string not null",
    "document_chunks": "id string not null, document_id string, chunk_type string, page_index int, chunk_index int, content string, start_ms bigint, end_ms bigint, speaker int, embedding array<float>, embedding_model string, created_at string",
    "synced_folders": "id string not null, name string, created_at string, last_error string",
    "synced_files": "folder_id string not null, relative_path string not null, managed_path string, document_id string, last_modified bigint, size bigint, state string, message string",
    "log_entries": "time string, level string, subsystem string, message string, fields map<string,string>, error struct<name:string,message:string>",
    "pages": "source string, chunk_type string, page_index int, content string",
}

ALLOWED = {
    "source_type": ("PDF", "AUDIO", "DOCX", "PPTX", "XLSX", "CSV", "TEXT", "YOUTUBE"),
    "origin": ("FILE", "MANUAL"),
    "chunk_type": ("TEXT", "IMAGE", "TABLE"),
    "role": ("system", "user", "assistant", "tool"),
    "state": ("synced", "ignored", "duplicate", "malformed"),
    "level": ("debug", "info", "warn", "error"),
    "retrieval_mode": ("bm25", "semantic", "hybrid"),
}


def schema(name: str) -> StructType:
    """The StructType of a table; needs an active session, as DDL is parsed by Spark."""
    return _table(_DDL[name])


TABLES = tuple(_DDL)
