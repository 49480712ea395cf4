"""Reads and rows of conversations (FLT6-7, SO4-6, RP8, PRJ2-3, PRJ5, PRJ8, JS4-5, JS9, AG24, RAG6, RAG13, DML17).

Defined results: nulls in a compared column never match; empty tables give empty results; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible(conversations: DataFrame, owner: Column | None = None) -> DataFrame:
    """FLT6: neither deleted nor marked as deleted; of one owner, if given."""
    kept = conversations.where(F.col("deleted_at").isNull() & (F.col("status") != "deleted"))
    return kept if owner is None else kept.where(F.col("user_id") == owner)


def listed(conversations: DataFrame, owner: Column) -> DataFrame:
    """RP8, SO4: an owner's conversations, the last updated first."""
    return visible(conversations, owner).orderBy(F.desc("updated_at"), "id")


def messages_of(messages: DataFrame, conversations: DataFrame, owner: Column) -> DataFrame:
    """FLT7, SO5: the messages of an owner's visible conversations, by sequence."""
    mine = visible(conversations, owner).select(F.col("id").alias("conv_id"))
    return messages.join(mine, "conv_id", "left_semi").orderBy("conv_id", "sequence")


def response(messages: DataFrame) -> DataFrame:
    """PRJ8: adds ``error`` (null if the row may be shown); content is empty for assistant rows that are pending or failed."""
    open_ = (F.col("role") == "assistant") & F.col("status").isin("pending", "failed")
    error = F.when(F.col("citations").isNull(), "citations are missing").when(F.col("content").isNull() & ~open_, "content is missing")
    return messages.withColumns({"content": F.when(open_, F.coalesce("content", F.lit(""))).otherwise(F.col("content")), "error": error})


def merged_metadata(stored: Column, **columns: Column) -> Column:
    """PRJ2, PRJ5, RAG6: stored entries, over which columns of the same name win."""
    own = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[c.cast("string") for c in columns.values()]))
    return F.map_concat(F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*columns)), own)


def retrieval_error(text: Column, dimensions: Column, expected: int, top_k: Column, most_chars: int = 4000) -> Column:
    """RAG13: why a request can't be served; null if it can."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "query is empty")
        .when(F.length(text) > most_chars, "query is too long")
        .when(F.coalesce(dimensions, F.lit(-1)) != expected, "vector has another length")
        .when(F.coalesce(top_k, F.lit(0)) < 1, "top_k is below 1")
    )


CONTEXT = "array<struct<heading:string,content:string>>"


def stored_context(text: Column) -> Column:
    """JS4: struct(contexts, valid): valid means an array of objects with a content and no keys but heading and content."""
    v = F.try_parse_json(text)
    entries = F.try_variant_get(v, "$", "array<map<string,variant>>")
    ok = lambda m: F.map_contains_key(m, "content") & F.coalesce(F.schema_of_variant(F.try_element_at(m, F.lit("content"))) == "STRING", F.lit(False)) & (F.size(F.array_except(F.map_keys(m), F.array(F.lit("heading"), F.lit("content")))) == 0)
    valid = F.coalesce(F.forall(entries, ok), F.lit(False))
    return F.struct(F.when(valid, F.try_variant_get(v, "$", CONTEXT)).alias("contexts"), valid.alias("valid"))


def context_of(chunks: Column) -> Column:
    """JS5: {heading, content} of each chunk."""
    return F.transform(chunks, lambda c: F.struct(c["heading"].alias("heading"), c["content"].alias("content")))


def created(requests: DataFrame, profile_key: str, profile_version: str, guardrails: str | None, index_version: str | None, now: Column) -> DataFrame:
    """DML17: new active conversations with the settings in force."""
    snapshot = {"model_profile_key": profile_key, "model_profile_version": profile_version, "guardrails_config_id": guardrails, "rag_index_version": index_version}
    return requests.select("id", "user_id", "title", F.lit("active").alias("status"), *[F.lit(v).cast("string").alias(k) for k, v in snapshot.items()], now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def latest_log(logs: DataFrame, by: str = "conversation_id") -> DataFrame:
    """AG24, JS9: the last log row of each conversation, with how many chunks it retrieved."""
    last = F.row_number().over(W.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id")))
    return logs.withColumn("__r", last).where("__r = 1").select(by, "id", F.coalesce(F.size("retrieved_chunk_ids"), F.lit(0)).alias("n_chunks"))


def activity_days(daily: DataFrame) -> DataFrame:
    """SO6: each user's active days, from the first on and from the last on; a user has a row for each day only."""
    days = daily.groupBy("user_id").agg(F.collect_set("activity_date").alias("d"))
    return days.select("user_id", F.sort_array("d").alias("ascending"), F.sort_array("d", asc=False).alias("descending"))
