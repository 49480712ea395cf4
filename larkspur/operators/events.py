"""Structured events with the fields that each kind has (EV1, EV3, PRJ3, PRJ6, PRJ7, SNK3), and the payloads of prompts (JS3).

An event is a row (event, fields): fields is JSON with sorted keys at every depth, a key for each field of the kind, null where the table has no such column
or value. Ids are texts. Lists of chunks are cut to the first five, as they are in a log.

Defined results: a null struct gives null fields; an empty table no events; repeated rows an event each; columns that the kind does not have are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of each event.
REQUEST = ("user_id", "conversation_id", "user_message_id", "assistant_message_id")
GUARDRAIL = ("blocked", "rail", "reason", "guardrail_provider", "category", "confidence", "fail_open", "judge_error")
PROVIDER = ("model", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens")
CHAT = ("request_id", *REQUEST, "model_profile_key", "model_profile_version", "guardrails_config_id", "rag_index_version")
EVENTS: dict[str, tuple[str, ...]] = {
    "guardrail.check.completed": (*REQUEST, *GUARDRAIL, "guardrail_stage", "latency_ms"),
    "guardrail.check.failed": (*REQUEST, "guardrail_stage", "latency_ms", "error_type"),
    "rag.retrieve.completed": (*REQUEST, "latency_ms", "chunk_count", "chunks"),
    "rag.retrieve.failed": (*REQUEST, "latency_ms", "error_type", "retriever_class"),
    "rag.provider.retrieve.completed": ("user_id", "conversation_id", "user_message_id", "backend", "latency_ms", "chunk_count", "candidate_count", "retained_count", "suppression_reasons", "chunks"),
    "llm.generation.completed": (*REQUEST, *PROVIDER, "generation_stage", "latency_ms"),
    "llm.generation.failed": (*REQUEST, "generation_stage", "latency_ms", "error_type"),
    "chat.repair.completed": (*REQUEST, "latency_ms", "repair_passed", "initial_blocked", "initial_rail", "final_rail"),
    "chat.turn.completed": (*CHAT, *PROVIDER, "provider_latency_ms"),
}
#: What of a chunk is logged, under either spelling.
CHUNK_KEYS = ("source_id", "chunk_id", "document_id", "title", "source_path", "heading_path", "section_heading", "chunk_type", "content_hash", "char_start", "char_end", "page", "score", "distance", "similarity")
LOGGED_CHUNKS = 5


def _sorted(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct, and the keys of every map, in order of their names."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))))
    return c


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(r.title() for r in rest)


def chunk_fields(kind: T.StructType) -> list[str]:
    """FLT10: the fields of a chunk that may be logged."""
    allowed = {k for name in CHUNK_KEYS for k in (name, _camel(name))}
    return [f.name for f in kind.fields if f.name in allowed]


def events(rows: DataFrame, kind: str, request_id: str | None = None) -> DataFrame:
    """(event, fields) of each row; request_id names a column that goes into each event besides."""
    if kind not in EVENTS:
        raise ValueError(f"unknown event {kind}")
    names = sorted({*EVENTS[kind], *(["request_id"] if request_id else [])})

    def field(name: str) -> Column:
        source = request_id if name == "request_id" and request_id else name
        if source not in rows.columns:
            return F.lit(None).cast("string").alias(name)
        c, type_ = F.col(source), rows.schema[source].dataType
        if name == "chunks":
            kept = chunk_fields(type_.elementType)
            c = F.transform(F.slice(c, 1, LOGGED_CHUNKS), lambda x: F.struct(*[_sorted(x[k], type_.elementType[k].dataType).alias(k) for k in sorted(kept)]))
        elif name.endswith("_id"):
            c = c.cast("string")
        else:
            c = _sorted(c, type_)
        return c.alias(name)

    return rows.select(F.lit(kind).alias("event"), F.to_json(F.struct(*map(field, names)), {"ignoreNullFields": "false"}).alias("fields"))


def reason_code(c: Column) -> Column:
    """A reason as a code: lower case, words joined by underscores, 80 characters at most."""
    return F.left(F.array_join(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""), "_"), F.lit(80))


def guardrail_fields(rows: DataFrame, result: str = "result") -> DataFrame:
    """PRJ6: the fields of a guardrail's result (blocked, rail, reason, metadata: map) as columns."""
    meta = {"guardrail_provider": "provider", "category": "category", "confidence": "confidence", "fail_open": "failOpen", "judge_error": "judgeError"}
    r = F.col(result)
    made = {"blocked": r["blocked"], "rail": r["rail"], "reason": reason_code(r["reason"])} | {k: F.try_element_at(r["metadata"], F.lit(v)) for k, v in meta.items()}
    return rows.withColumns(made).drop(result)


def retrieved_chunk(found: DataFrame, metadata: str = "metadata") -> DataFrame:
    """PRJ3: (query_id, rank, content, metadata, distance, similarity): the stored metadata with the chunk's own fields, as texts, which win."""
    own = ("chunk_id", "document_id", "source_type", "source_path", "title", "course_name")
    kept = F.map_filter(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*own))
    mine = F.create_map(*[x for n in own for x in (F.lit(n), F.col(n).cast("string") if n in found.columns else F.lit(None).cast("string"))])
    return found.select("query_id", "rank", "content", F.map_concat(kept, mine).alias("metadata"), "distance", "similarity")


def retrieval_fields(retrieved: DataFrame) -> DataFrame:
    """EV3: adds chunk_count, candidate_count, retained_count, suppression_reasons (a count for each, in order of names) and chunks to rows with ``retained``, ``suppressed`` and ``candidates`` (how many there were)."""
    reasons = F.transform("suppressed", lambda s: s["reason"])
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(reasons)), lambda r: F.struct(r.alias("key"), F.size(F.filter(reasons, lambda x: x == r)).alias("value"))))
    n = F.size("retained")
    return retrieved.withColumns({"chunk_count": n, "candidate_count": F.col("candidates"), "retained_count": n, "suppression_reasons": counted, "chunks": F.col("retained")})


def prompt_payload(message: Column, chunks: Column | None = None, previous: Column | None = None, draft: Column | None = None) -> Column:
    """JS3: the message with its citable chunks (array of structs citationId, heading, content), with the contexts of an earlier turn, or with a draft to be repaired; nulls are kept."""
    fields = [message.alias("studentMessage")]
    if chunks is not None:
        fields.append(F.transform(chunks, lambda c: F.struct(c["citationId"].alias("citationId"), c["heading"].alias("heading"), c["content"].alias("content"))).alias("retrievedContext"))
    if previous is not None:
        fields.append(previous.alias("previousRetrievedContext"))
    if draft is not None:
        fields.append(draft.alias("draftAssistantResponse"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
