"""Tables of the tutoring service as explicit schemas, and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "user_account": ("id string not null, clerk_id string not null, first_name string not null, last_name string not null, clerk_profile_updated_at timestamp, role string not null, created_at timestamp not null, updated_at timestamp not null, deleted_at timestamp"),
    "conversation": ("id string not null, user_id string not null, title string, status string not null, model_profile_key string not null, model_profile_version string, guardrails_config_id string, rag_index_version string, created_at timestamp not null, updated_at timestamp not null, deleted_at timestamp"),
    "message": (
        "id string not null, conversation_id string not null, user_id string not null, sequence int not null, role string not null, status string not null, content string, "
        "history_context array<struct<heading:string,content:string>>, citations array<struct<citationId:string,heading:string,sourcePath:string,content:string>>, blocked_reason string, latency_ms int, error map<string,string>, created_at timestamp not null"
    ),
    "llm_cost_component": (
        "id string not null, user_id string not null, conversation_id string not null, user_message_id string not null, assistant_message_id string not null, component_order int not null, component_type string not null, attempt_index int not null, provider string, configured_model string, response_model string, "
        "finish_reason string, status string not null, prompt_tokens int, completion_tokens int, total_tokens int, estimated_cost_usd decimal(18,12), latency_ms int, error_type string, metadata map<string,string>, created_at timestamp not null"
    ),
    "student_daily_activity": ("id string not null, user_id string not null, activity_date date not null, first_seen_at timestamp not null, last_seen_at timestamp not null, login_count int not null"),
    "rag_documents": ("id string not null, source_type string not null, source_path string not null, title string, course_name string, content_hash string not null, is_active boolean not null, deleted_at timestamp, metadata map<string,string>, created_at timestamp not null, updated_at timestamp not null"),
    "rag_chunks": ("id string not null, document_id string not null, chunk_index int not null, content string not null, token_count int, content_hash string, char_start int, char_end int, heading_path array<string>, section_heading string, chunk_type string, chunker_version string, metadata map<string,string>, created_at timestamp not null"),
    "rag_embeddings": ("id string not null, chunk_id string not null, embedding array<float> not null, embedding_provider string not null, embedding_model string not null, embedding_dimensions int not null, created_at timestamp not null"),
    "rag_retrieval_logs": ("id string not null, conversation_id string, message_id string, query_text string not null, retrieved_chunk_ids array<string>, scores array<struct<chunk_id:string,distance:double,similarity:double>>, rag_index_version string, created_at timestamp not null"),
}
KEYS = {
    "user_account": [["clerk_id"]],
    "message": [["conversation_id", "sequence"]],
    "student_daily_activity": [["user_id", "activity_date"]],
    "rag_documents": [["source_type", "source_path"]],
    "rag_chunks": [["document_id", "chunk_index"]],
    "rag_embeddings": [["chunk_id", "embedding_provider", "embedding_model", "embedding_dimensions"]],
}
# Fixed values.
ROLES = ("student", "instructor", "admin")
MESSAGE_ROLES = ("user", "assistant", "system", "context")
MESSAGE_STATUSES = ("pending", "completed", "blocked", "failed")
CONVERSATION_STATUSES = ("active", "deleted")
CHUNK_TYPES = ("prose", "code", "list", "table", "mixed")
COMPONENT_TYPES = ("main_generation", "repair_generation", "input_guardrail", "output_guardrail", "output_repair_guardrail")
COMPONENT_STATUSES = ("completed", "failed", "cost_unavailable")


def schema(table: str) -> StructType:
    """The schema of a table; a session must be there, for Spark reads the DDL."""
    return StructType.fromDDL(TABLES[table])


def missing_columns(present: StructType, required: StructType) -> list[tuple[str, str]]:
    """SET5, SNK5: (column, type) pairs that are required and not present."""
    have = {(f.name, f.dataType.simpleString()) for f in present.fields}
    return [(f.name, f.dataType.simpleString()) for f in required.fields if (f.name, f.dataType.simpleString()) not in have]
