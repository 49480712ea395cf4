"""Replacing a document index as a whole or not at all (DML2, NM5), and turns that are written against a sequence seen before (DML13).

Both work on a store of versioned tables (sources/versions.py): what they write is in one commit.

Defined results: an index of no chunks removes those of its documents; a document that the new index does not name stays as it is.
Turns whose conversation has no rows yet have base 0; a null base is a conflict, for it cannot be compared; repeated turns compete like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import dml
from larkspur.sources.versions import Store, Transaction, batched


@dataclass(frozen=True)
class Contract:
    provider: str
    model: str
    dimensions: int


class InvalidIndex(ValueError):
    """Chunks and embeddings that may not replace an index."""


def violations(chunks: DataFrame, embeddings: DataFrame, contract: Contract) -> DataFrame:
    """(document_id, error, n): what forbids the replacement, by document; no rows if nothing does.

    chunks: document_id, chunk_id, chunk_index. embeddings: chunk_id, embedding, provider, model, dimensions.
    """
    own = chunks.groupBy("document_id", "chunk_id").agg(F.count("*").alias("n"))
    no_id = own.where("chunk_id is null").select("document_id", F.lit("chunk without id").alias("error"), "n")
    # An id is one chunk's, over all documents.
    twice = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id")).where("n > 1").select("document_id", F.lit("chunk id repeated").alias("error"), F.col("n") - 1)
    index = chunks.groupBy("document_id", "chunk_index").agg(F.count("*").alias("n")).where("n > 1").select("document_id", F.lit("chunk index repeated").alias("error"), (F.col("n") - 1).alias("n"))
    fits = (F.col("provider") == contract.provider) & (F.col("model") == contract.model) & (F.col("dimensions") == contract.dimensions) & (F.size("embedding") == contract.dimensions)
    vectors = embeddings.groupBy("chunk_id").agg(F.count("*").alias("vectors"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("unfit"))
    ids = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("document_id").alias("document_id"), F.lit(True).alias("has"))
    both = ids.join(vectors, "chunk_id", "full")
    found = F.coalesce("vectors", F.lit(0))
    errors = F.array(
        F.struct(F.lit("chunk without embedding").alias("error"), F.when(F.col("has") & (found == 0), F.lit(1)).alias("n")),
        F.struct(F.lit("more than one embedding").alias("error"), F.when(F.col("has") & (found > 1), found - 1).alias("n")),
        F.struct(F.lit("embedding without chunk").alias("error"), F.when(F.col("has").isNull(), found).alias("n")),
        F.struct(F.lit("embedding breaks the contract").alias("error"), F.when(F.col("unfit") > 0, F.col("unfit")).alias("n")),
    )
    paired = both.select("document_id", F.inline(errors)).where("n is not null")
    every = [d.select("document_id", "error", F.col(d.columns[2]).cast("long").alias("n")) for d in (no_id, twice, index, paired)]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).groupBy("document_id", "error").agg(F.sum("n").alias("n"))


def replace_index(store: Store, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, now: Column, contract: Contract, buckets: int = 64, version: int | None = None) -> int:
    """DML2: the documents are upserted, all their old chunks and embeddings go, the new ones come, in one commit. Gives its version.

    documents: as for dml.upsert_documents, ``id`` being the document_id. Nothing is written if the index is invalid; if a later
    part fails, or another writer has committed since ``version``, readers still see the old index.
    """
    wrong = violations(chunks, embeddings, contract).orderBy("error", "document_id").limit(5).collect()
    strange = chunks.join(documents, chunks["document_id"] == documents["id"], "left_anti").select("document_id").limit(1).collect()
    if wrong or strange:
        raise InvalidIndex("; ".join([f"{r['error']} (document {r['document_id']}, {r['n']})" for r in wrong] + [f"chunks of document {r[0]}, which is not replaced" for r in strange]))
    t = store.begin(version)
    placed = embeddings.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    if "documents" not in t.tables:
        fresh = documents.withColumns({"is_active": F.lit(True), "deleted_at": F.lit(None).cast("timestamp_ntz"), "created_at": now, "updated_at": now})
        t.put("documents", fresh, ("source_type", "source_path"), buckets)
        t.put("chunks", chunks, ("document_id",), buckets)
        t.put("embeddings", placed, ("document_id",), buckets)
        return t.commit()
    # A stored document keeps its id; chunks follow it.
    stored = t.read("documents").select("source_type", "source_path", F.col("id").alias("stored_id"))
    ids = documents.join(stored, ["source_type", "source_path"], "left").select(F.col("id").alias("document_id"), F.coalesce("stored_id", "id").alias("__id"))
    t.merge("documents", documents, lambda old, new: dml.upsert_documents(old, new, now))
    for name, rows in (("chunks", chunks), ("embeddings", placed)):
        renamed = ids.select(F.col("__id").alias("document_id"))
        fresh = rows.join(ids, "document_id").drop("document_id").withColumnRenamed("__id", "document_id")

        def swap(old: DataFrame, gone: DataFrame, fresh: DataFrame = fresh) -> DataFrame:
            return old.join(gone, "document_id", "left_anti").unionByName(fresh)

        t.merge(name, renamed, swap)
    return t.commit()


CONFLICT = "MessageSequenceConflict"


def claim_turns(new: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML13: (rows of the turns that win, conflicts).

    new: conv_id, arrival, content, base_sequence (the last sequence that the writer saw). A turn wins if that still is the
    conversation's last one; of several on one base the first to arrive does, ties by content. Conflicts: the turn's columns with ``error`` and ``current_sequence``.
    """
    last = messages.groupBy("conv_id").agg(F.max("sequence").alias("__last"))
    seen = new.join(last, "conv_id", "left").withColumn("__last", F.coalesce("__last", F.lit(0)).cast("long"))
    current = F.coalesce(F.col("base_sequence") == F.col("__last"), F.lit(False))
    first = F.row_number().over(W.partitionBy("conv_id", "__current").orderBy(F.asc_nulls_last("arrival"), "content"))
    judged = seen.withColumn("__current", current).withColumn("__wins", F.col("__current") & (first == 1))
    winners = judged.where("__wins")
    pair = F.array(
        F.struct((F.col("__last") + 1).alias("sequence"), F.lit("user").alias("role"), F.lit("completed").alias("status"), F.col("content")),
        F.struct((F.col("__last") + 2).alias("sequence"), F.lit("assistant").alias("role"), F.lit("pending").alias("status"), F.lit("").alias("content")),
    )
    taken = winners.select("conv_id", (F.col("__last") + 2).alias("__now"))
    lost = judged.where("not __wins").join(taken, "conv_id", "left").withColumn("current_sequence", F.coalesce("__now", "__last"))
    return winners.select("conv_id", F.inline(pair)), lost.select("conv_id", "arrival", "content", "base_sequence", F.lit(CONFLICT).alias("error"), "current_sequence")


def write_turns(store: Store, new: DataFrame, writer: str, batch: int) -> int:
    """Claim turns against the messages of the store; winners and conflicts are in one commit, once for each (writer, batch). Needs the tables ``messages`` (keyed by conv_id) and ``conflicts``."""
    def work(t: Transaction) -> None:
        _, conflicts = claim_turns(new, t.around("messages", new))
        t.append("conflicts", conflicts)
        t.merge("messages", new, lambda old, turns: old.unionByName(claim_turns(turns, old)[0]))

    return batched(store, writer, batch, work)
