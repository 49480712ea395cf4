"""Embeddings by content (RAG8, JN8, SET4): each different content is embedded once, and what is stored already is not embedded again.

Chunks are reduced to their content hashes (counted before the shuffle, so a text that a third of all chunks share is a row a task), hashes with a
stored vector of the same contract are left out, the rest goes to the embedder in whole batches, and every chunk then gets the vector of its hash.

Defined results: a null content is an empty text; chunks of equal content share a vector; repeated chunk ids each get theirs; an empty table calls no embedder. Stored
vectors of another contract or length are as if they were not there; of several of one hash the smallest counts. An embedder that gives another number of vectors, another length or a number that is not finite is an
error, and nothing is stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.index import Contract
from larkspur.sources.versions import Store, Transaction, batched

Embedder = Callable[[list[str]], list[list[float]]]


def embedded(rows: DataFrame, embedder: Embedder, dimensions: int, batch: int = 64, text: str = "content") -> DataFrame:
    """Adds ``embedding``, in order. The embedder gets ``batch`` texts at once, the last ones of a task excepted, wherever Arrow's batches end."""

    def vectors(texts: list[str]) -> list[list[float]]:
        got = embedder(texts)
        if len(got) != len(texts) or any(len(v) != dimensions for v in got):
            raise ValueError("the embedder gave vectors of another number or length")
        if not all(math.isfinite(x) for v in got for x in v):
            raise ValueError("the embedder gave a number that is not finite")
        return got

    def filled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.num_rows, batch):
            some = table.slice(at, batch).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(vectors([t or "" for t in some.column(text).to_pylist()]), pa.list_(pa.float32()))], names=[*some.schema.names, "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            whole = held.num_rows - held.num_rows % batch
            yield from filled(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield from filled(held)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def _fits(contract: Contract) -> Column:
    return (F.col("provider") == contract.provider) & (F.col("model") == contract.model) & (F.col("dimensions") == contract.dimensions) & (F.size("embedding") == contract.dimensions)


def missing(chunks: DataFrame, stored: DataFrame, contract: Contract) -> DataFrame:
    """(content_hash, content): each different content of which no vector of the contract is stored. chunks: content_hash, content."""
    different = chunks.groupBy("content_hash").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    return different.join(stored.where(_fits(contract)).select("content_hash"), "content_hash", "left_anti")


def fresh_vectors(chunks: DataFrame, stored: DataFrame, embedder: Embedder, contract: Contract, batch: int = 64) -> DataFrame:
    """(content_hash, embedding, provider, model, dimensions) of the contents without a vector."""
    made = embedded(missing(chunks, stored, contract), embedder, contract.dimensions, batch)
    return made.select("content_hash", "embedding", F.lit(contract.provider).alias("provider"), F.lit(contract.model).alias("model"), F.lit(contract.dimensions).alias("dimensions"))


def attached(chunks: DataFrame, stored: DataFrame, contract: Contract) -> DataFrame:
    """The chunks with ``embedding`` (null if there is none), one row each."""
    one = stored.where(_fits(contract)).groupBy("content_hash").agg(F.min("embedding").alias("embedding"))
    return chunks.join(one, "content_hash", "left")


def unequal(chunks: DataFrame, with_vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """SET4: (chunk_id, chunks, vectors) where a chunk has not exactly as many vectors as rows; no rows if all is well."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    every = chunks.select(key, one.alias("chunks"), none.alias("vectors")).unionAll(with_vectors.select(key, none, F.when(F.col("embedding").isNull(), none).otherwise(one)))
    return every.groupBy(key).agg(F.sum("chunks").alias("chunks"), F.sum("vectors").alias("vectors")).where("chunks <> vectors")


VECTORS = "content_hash string, embedding array<float>, provider string, model string, dimensions int"


def embed_into(store: Store, chunks: DataFrame, embedder: Embedder, contract: Contract, writer: str, run: int, batch: int = 64, buckets: int = 64, table: str = "vectors") -> DataFrame:
    """Embed what the store lacks, in one commit, and give the chunks with their vectors, checked. A run that comes again embeds nothing; nor does a next one over the same contents."""

    def work(t: Transaction) -> None:
        if table not in t.tables:
            t.put(table, chunks.sparkSession.createDataFrame([], VECTORS), ("content_hash",), buckets)

        # Only buckets with a new content are written; the look-up for it reads hashes, not vectors.
        lacking = missing(chunks, t.read(table), contract)

        def add(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(fresh_vectors(new, old, embedder, contract, batch))

        t.merge(table, lacking, add)

    batched(store, writer, run, work)
    made = attached(chunks, store.read(table), contract)
    wrong = unequal(chunks, made).limit(3).collect()
    if wrong:
        raise ValueError("chunks without exactly one vector: " + ", ".join(str(r["chunk_id"]) for r in wrong))
    return made
