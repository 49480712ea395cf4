"""Corpus ingest as one job (RAG9): a scan of files becomes document and chunk rows, what is gone is deactivated.

Defined results: a file whose path is not English or whose text is blank deactivates the stored document and leaves
its chunks; a null text is a file that could not be read (``failed``): its stored rows stay as they are, and nothing is
reconciled in that run; an empty scan changes nothing. A path that the scan holds
twice is an error, for no row of it could be told to win.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import chunking, dml, embedding


@dataclass(frozen=True)
class Settings:
    source_type: str = "repo"
    course_name: str | None = None
    dry_run: bool = False
    fail_fast: bool = False
    reconcile: bool = False
    dimensions: int = 384


@dataclass(frozen=True)
class Ingested:
    """documents: the new snapshot. chunks: old and new chunks by source_path. counts: files by outcome."""

    documents: DataFrame
    chunks: DataFrame | None
    counts: dict[str, int]


def outcomes(scan: DataFrame) -> DataFrame:
    """The scan with ``status``: prepared, skipped_non_english, skipped_empty or failed."""
    made = chunking.prepared(scan, "source_path", "text")
    return made.withColumn("status", F.when((F.col("status") == "skipped_empty") & F.col("text").isNull(), "failed").otherwise(F.col("status")))


def ingest(scan: DataFrame, documents: DataFrame, chunks: DataFrame | None, now: Column, settings: Settings, embedder: Callable[[list[str]], list[list[float]]] | None = None) -> Ingested:
    """scan: id, source_path, title and text. Without an embedder, chunks have no vector yet.

    The driver sees the counts only; every table stays lazy, so a caller writes each of them once.
    """
    found = outcomes(scan)
    row = found.agg(F.count("*").alias("discovered"), F.countDistinct("source_path").alias("paths"), *[F.count_if(F.col("status") == s).alias(s) for s in ("prepared", "skipped_non_english", "skipped_empty", "failed")]).first()
    counts = row.asDict()
    if counts["failed"] and settings.fail_fast:
        raise ValueError(f"{counts['failed']} files could not be read")
    if counts["discovered"] != counts["paths"]:
        raise ValueError("a path occurs more than once in the scan")
    if settings.dry_run or counts["discovered"] == counts["failed"]:
        return Ingested(documents, chunks, counts)

    ready = found.where("status = 'prepared'")
    fresh = ready.select("id", F.lit(settings.source_type).alias("source_type"), "source_path", "title", F.lit(settings.course_name).cast("string").alias("course_name"), T.content_hash(F.col("text")).alias("content_hash"))
    documents = dml.upsert_documents(documents, fresh, now)
    made = chunking.chunk(ready, "source_path").withColumnRenamed("document_id", "source_path")
    if embedder is not None:
        made = embedding.embedded(made, embedder, settings.dimensions)
    chunks = made if chunks is None else dml.replace_rows(chunks, made, "source_path")

    if counts["skipped_empty"] + counts["skipped_non_english"]:
        documents = dml.deactivate(documents, found.where(F.col("status").startswith("skipped")), now, settings.source_type, missing=False).drop("changed")
    if dml.may_reconcile(settings.reconcile, settings.dry_run, counts["discovered"], counts["failed"], 0):
        documents = dml.deactivate(documents, found, now, settings.source_type, settings.course_name).drop("changed")
    return Ingested(documents, chunks, counts)
