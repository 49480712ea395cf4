"""Retrieval: exact filtered cosine search, order-preserving dedup, retrieval log, citations, history (RAG, FLT2-3, NM3, PRJ, SNK1).

Defined results: a query without candidates has no row in what is folded or logged; null hashes, offsets and ids never make two candidates equal; repeated candidates are told apart by
their rank and suppressed like others; null contents are empty where they are compared. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T


@dataclass(frozen=True)
class Settings:
    """RAG20, SO7."""

    top_k: int = 5
    multiplier: int = 3
    max_candidates: int = 50

    def __post_init__(self):
        if self.top_k < 1 or self.multiplier < 1 or not 1 <= self.max_candidates <= 500 or self.top_k > self.max_candidates:
            raise ValueError("1 <= top_k <= max_candidates <= 500, multiplier >= 1")

    @property
    def pool(self) -> int:
        return min(self.top_k * self.multiplier, self.max_candidates)


def contract(provider: str, model: str, dimensions: int) -> Column:
    """FLT2, NM5."""
    return (F.col("embedding_provider") == provider) & (F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """NM3: null where a vector is zero. Norms that are known already can be given."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(both > 0, _dot(a, b) / F.nullif(both, F.lit(0.0)))


CANDIDATE = "struct<rank:int,chunk_id:string,document_id:string,content_hash:string,content:string,char_start:int,char_end:int>"


def dedup_fold(candidates: Column) -> Column:
    """RAG12 over an array of CANDIDATE in rank order: (retained, suppressed with reasons). An entry is compared with retained ones only."""

    def why(c: Column, r: Column) -> Column:
        hashes = c["content_hash"].isNotNull() & r["content_hash"].isNotNull()
        far = T.overlap_ratio(c["char_start"], c["char_end"], r["char_start"], r["char_end"])
        return (
            F.when(c["chunk_id"] == r["chunk_id"], "chunk_id")
            .when(hashes & (c["content_hash"] == r["content_hash"]), "content_hash")
            .when(~hashes & (T.collapse(c["content"]) == T.collapse(r["content"])), "normalized_content")
            .when((c["document_id"] == r["document_id"]) & (far >= 0.8), "overlapping_offsets")
        )

    start = F.struct(F.array().cast(f"array<{CANDIDATE}>").alias("retained"), F.array().cast("array<struct<rank:int,chunk_id:string,reason:string>>").alias("suppressed"))

    def step(acc: Column, c: Column) -> Column:
        reason = F.get(F.filter(F.transform(acc["retained"], lambda r: why(c, r)), lambda x: x.isNotNull()), 0)
        return F.struct(
            F.when(reason.isNull(), F.array_append(acc["retained"], c)).otherwise(acc["retained"]).alias("retained"),
            F.when(reason.isNull(), acc["suppressed"]).otherwise(F.array_append(acc["suppressed"], F.struct(c["rank"].alias("rank"), c["chunk_id"].alias("chunk_id"), reason.alias("reason")))).alias("suppressed"),
        )

    return F.aggregate(candidates, start, step)


def retrieve(found: DataFrame, settings: Settings) -> DataFrame:
    """RAG11, SO8: (query_id, retained, suppressed, candidates: their number) from ranked candidates; at most ``settings.pool`` of each query."""
    pool = found.where(F.col("rank") <= settings.pool)
    fields = ("rank int", "chunk_id string", "document_id string", "content_hash string", "content string", "char_start int", "char_end int")
    entry = F.struct(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in fields])
    folded = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("c")).select("query_id", F.size("c").alias("candidates"), dedup_fold(F.col("c")).alias("f"))
    return folded.select("query_id", F.slice("f.retained", 1, settings.top_k).alias("retained"), F.col("f.suppressed").alias("suppressed"), "candidates")


def suppression_counts(retrieved: DataFrame) -> DataFrame:
    """AG13."""
    return retrieved.select(F.explode("suppressed.reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def retrieval_log(found: DataFrame) -> DataFrame:
    """SNK1, PRJ4: ids and scores in rank order; ranks keep their gaps where an id is missing."""
    entry = F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), "distance", "similarity")
    rows = found.where(F.col("chunk_id").isNotNull()).groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("query_id", F.col("e.chunk_id").alias("retrieved_chunk_ids"), F.transform("e", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["distance"].alias("distance"), x["similarity"].alias("similarity"))).alias("scores"))


def citation_records(chunks: Column) -> Column:
    """RAG14, JN9: (citationId, heading, sourcePath, content) by rank from 1."""
    return F.transform(chunks, lambda c, i: F.struct((i + 1).cast("string").alias("citationId"), c["heading"].alias("heading"), c["source_path"].alias("sourcePath"), T.capped(c["content"]).alias("content")))


def renderable(citations: Column) -> Column:
    """FLT13, JS6."""
    return F.filter(citations, lambda c: F.coalesce(c["citationId"], F.lit("")).rlike(r"^[1-9]\d*$"))


def history(turns: DataFrame, with_context: int = 3) -> DataFrame:
    """RAG18, WN2: completed user and assistant turns in order; the last user turns are wrapped with their context."""
    done = turns.where(F.col("role").isin("user", "assistant") & (F.col("status") == "completed"))
    back = F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.desc("sequence")))
    wrapped = done.withColumn("wrapped", (F.col("role") == "user") & (back <= with_context))
    payload = F.when(F.col("wrapped"), F.to_json(F.struct(F.col("content").alias("studentMessage")), {"ignoreNullFields": "false"})).otherwise(F.col("content"))
    return wrapped.select("conv_id", "sequence", "role", "wrapped", payload.alias("content"))


def assembled(histories: DataFrame, system: str) -> DataFrame:
    """RAG19: system message, then the history, as one array for each conversation."""
    entry = F.struct("sequence", "role", "content")
    rows = histories.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("h"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return rows.select("conv_id", F.concat(first, F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("messages"))
