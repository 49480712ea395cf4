"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage works on all that the one before has kept and is written as Parquet before the next begins.

Defined results: rows with a null or empty text fail the quality rules; of repeated rows one stays;
null ids are ids like any other; a document of which no word is left goes; an empty table gives an empty
result; columns other than doc_id and text (and n_chars, which follows the text) pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, decontaminate, quality, simhash, substrings
from larkspur.llm.common import few, made_paths, materialize, remove_path, table, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the base rule, the learned decision list or the learned toxic list rejects goes."""
    labels = table(spark, sf_dir, "labels")
    return quality.decide(docs, quality.learn(*quality.labelled_sample(docs, labels)), toxic=quality.learn_toxic(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; of repeated rows one."""
    # Near-duplicates share 0.8 of their five-word shingles; four lanes of 64 bits only choose what is compared.
    made = materialize(simhash.near_copies(docs, shingle_words=5, least=0.8, radius=64, lanes=4, screen=22), "near-copies")
    own, own_hash, text_hash = (unused(docs, n) for n in ("id", "th", "h"))
    rows = made.select(F.col("doc_id").alias(own), F.col("th").alias(own_hash), "stays")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(own_hash))
    # What goes is told by (id, hash of the text); the texts themselves meet it once.
    counted = materialize(rows.groupBy(own, own_hash).agg(F.count("*").alias("n"), F.every("stays").alias("stays")).where("n > 1 or not stays"), "near-copies-out")
    kept = docs.join(few(counted.drop("n", "stays")), same, "left_anti")
    repeated = counted.where("stays").drop("n", "stays")
    if repeated.isEmpty():
        return kept
    # Whole texts are only shuffled for rows that are there more than once.
    once = docs.join(few(repeated), same, "left_semi").withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
    return kept.unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay where they first stand; texts without a repeat stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    made = substrings.dedup(docs.where("text is not null"), with_text=True, others=others)
    changed = F.col("n_removed") > 0
    columns = {
        "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType),
        "text": F.col("kept_text"),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("others.n_chars")) if "n_chars" in others else None,
    }
    kept = made.where(~changed | (F.col("kept_text") != "")).select(*[columns.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("text is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, its values changed or not, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document that is left."""
    made = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: Not all stages can be said in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage wrote for itself, and its input, go when its output is there."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with made_paths() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        output = made.pop()  # the last path is that of the stage itself
        for path in [*made, *read]:
            remove_path(spark, path)
        read = [output]
    return docs
