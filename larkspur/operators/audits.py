"""Audits in place of constraints (AU, AG16-20, JN10-11, SET4): counts of what should not be.

Defined results: empty tables have no violations and counts of 0; null keys are no orphans; repeated rows count each; nulls are a value of their own in groups and fingerprints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """JN10, JN11: children with a key that no parent has."""
    keys = parents.select(F.col(parent_key).alias("__p")).distinct()
    return children.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__p"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """AG18."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG17: one pass over the table."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def version_counts(df: DataFrame, version: str, columns: list[str]) -> DataFrame:
    """AG17: rows and nulls of each version."""
    return df.groupBy(version).agg(F.count("*").alias("chunks"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def state_counts(documents: DataFrame, active: Column) -> DataFrame:
    """AG16, AG19."""
    return documents.agg(F.count("*").alias("documents"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"))


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """AU1."""
    return df.where(~F.col(column).isin(*allowed) | F.col(column).isNull())


def must_be_empty(df: DataFrame, what: str) -> None:
    """AU2: a precondition of a migration; reads one row at most."""
    if not df.isEmpty():
        raise ValueError(f"{what} is not empty")


def chunk_audit(chunks: DataFrame, documents: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """AU3: (rule, violations), one row for each rule; with documents (document_id, is_active) and embeddings (chunk_id) also orphans and chunks of documents that are not active.

    A null in a rule's columns does not break it; repeated indexes and ids count what is too many; empty tables break no rule.
    """
    rules = {
        "heading_missing": F.col("section_heading").isNull() & (F.size("heading_path") > 0),
        "bad_offsets": (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")),
        "bad_hash": F.length("content_hash") != 64,
        "blank_content": F.trim("content") == "",
    }
    n = F.sum("n")
    seen = chunks.groupBy("document_id", "chunk_index").agg(F.count("*").alias("n")).agg((F.coalesce(n, F.lit(0)) - F.count("*")).alias("repeated_index"))
    ids = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).agg((F.coalesce(n, F.lit(0)) - F.count("*")).alias("repeated_id"))
    parts = [chunks.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]), seen, ids]
    if documents is not None:
        known = documents.groupBy("document_id").agg(F.max("is_active").alias("__active"))
        # A document's chunks are counted before they meet it.
        per = chunks.groupBy("document_id").agg(F.count("*").alias("n")).join(known, "document_id", "left")
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
        parts.append(per.agg(total(F.col("__active").isNull()).alias("chunk_without_document"), total(~F.col("__active")).alias("inactive_document")))
    if embeddings is not None:
        parts.append(orphans(embeddings, chunks, "chunk_id", "chunk_id").agg(F.count("*").alias("embedding_without_chunk")))
        parts.append(chunks.join(embeddings.select("chunk_id").distinct(), "chunk_id", "left_anti").agg(F.count("*").alias("chunk_without_embedding")))
    row = reduce(DataFrame.crossJoin, parts)  # single rows
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in row.columns])))


def fingerprints(df: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """AU4: (bucket, n, rows, places) in one pass with partial sums: ``rows`` is a sum over hashes of the columns besides the keys, whatever the order; ``places`` one over hashes of columns and keys.

    ``keys`` tell the place of a row (a document and the number of a chunk, say); the first one chooses the bucket. Sums of two 64-bit hashes, as decimals, are
    one text, so that they neither overflow nor cancel; repeated rows count each, nulls are values.
    """
    others = sorted(c for c in df.columns if c not in keys)
    # Hashes skip nulls; the marks keep (null, 1) and (1, null) apart.
    marked = lambda columns: [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    total = lambda columns: F.concat_ws(":", *[F.sum(F.xxhash64(F.lit(seed), *marked(columns)).cast("decimal(20,0)")).cast("string") for seed in (1, 2)])
    bucket = F.pmod(F.xxhash64(*marked(keys[:1])), F.lit(buckets)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), total(others).alias("rows"), total([*keys, *others]).alias("places"))


def _side_by_side(a: DataFrame, b: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    x, y = (fingerprints(d, keys, buckets).select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "rows", "places")]) for d, s in ((a, "a"), (b, "b")))
    n = lambda s: F.coalesce(f"n_{s}", F.lit(0).cast("long")).alias(f"n_{s}")
    return x.join(y, "bucket", "full").select("bucket", n("a"), n("b"), "rows_a", "rows_b", F.col("rows_a").eqNullSafe(F.col("rows_b")).alias("same_rows"), F.col("places_a").eqNullSafe(F.col("places_b")).alias("same_order"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """AU4, SET4: (bucket, rows_a, rows_b, same_rows, same_order) of each bucket; each table is read once."""
    return _side_by_side(a, b, keys, buckets).select("bucket", F.col("n_a").alias("rows_a"), F.col("n_b").alias("rows_b"), "same_rows", "same_order")


def verdict(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """AU4: one row (rows_a, rows_b, same_rows, same_order, buckets_that_differ); each table is read once. Two empty tables are the same.

    The tables hold the same rows if the sums of all buckets together are equal: rows may have changed places between buckets.
    """
    half = lambda c, i: F.coalesce(F.get(F.split(c, ":"), i).cast("decimal(36,0)"), F.lit(0).cast("decimal(36,0)"))
    zero, none = F.lit(0).cast("decimal(38,0)"), F.lit(0).cast("long")
    equal = [F.coalesce(F.sum(half("rows_a", i) - half("rows_b", i)), zero) == 0 for i in (0, 1)]
    n = lambda s: F.coalesce(F.sum(f"n_{s}"), none)
    differ = F.count_if(~F.col("same_order"))
    return _side_by_side(a, b, keys, buckets).agg(n("a").alias("rows_a"), n("b").alias("rows_b"), (equal[0] & equal[1] & (n("a") == n("b"))).alias("same_rows"), (differ == 0).alias("same_order"), differ.alias("buckets_that_differ"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """AU4: the rows that only one table has (``side`` a or b), as often as they are too many. Only buckets that differ are compared row by row."""
    differ = [r["bucket"] for r in compared(a, b, keys, buckets).where("not same_order").select("bucket").collect()]  # no more than buckets
    marked = [x for c in keys[:1] for x in (F.col(c), F.col(c).isNull())]
    inside = F.pmod(F.xxhash64(*marked), F.lit(buckets)).cast("int").isin(differ)
    columns = sorted(a.columns)
    x, y = (d.select(*columns).where(inside) for d in (a, b))
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """AG20."""
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.avg(F.length("content")).alias("average_length"), F.max(F.length("content")).alias("longest"), F.count_if(F.length("content") > 1000).alias("over_1000"), F.count_if((F.col("chunk_type") == "prose") & (F.length("content") < 120)).alias("tiny_prose"))


def all_audits(frames: dict[str, DataFrame]) -> DataFrame:
    """(audit, n) of any number of violation tables."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("audit"), "n") for k, df in frames.items()])
