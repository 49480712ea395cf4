"""Sharding by rendezvous hashing: every record goes to the shard that scores highest for its key.

Score of a key on shard i with weight w: ``w / -ln(u)``, u in (0, 1) from xxhash64(key, i). The
largest score wins, the smaller shard number on a tie. Adding a shard leaves all old scores as they
were, so a record either stays or moves to the new shard; removing one moves only its records.

Only DataFrame functions run; no text is shuffled.

Defined results: a null key is a key like any other; repeated keys share a shard; a null text has
no bytes (size 1, crc32 0); an empty table gives an empty result. Columns of the input other than
key and text are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Sub-groups of each shard that are numbered independently; the table of their offsets has this many rows for each shard.
SLOT_GROUPS = 512


def scores(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<score, turned>>: one entry for each shard; ``turned`` is minus the shard's number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, and at least one")
    unit = lambda i: (F.shiftrightunsigned(F.xxhash64(key, i), 12).cast("double") + 0.5) * F.lit(2.0**-52)
    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct((w / -F.log(unit(i))).alias("score"), (-i).alias("turned")))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return (-F.array_max(scores(key, weights))["turned"]).cast("int")


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, slot_groups: int = SLOT_GROUPS) -> DataFrame:
    """key, size, text_crc32, shard, slot (0.. without gaps in each shard), grown_shard (with one more shard of ``grown_weight``).

    Slots: rows are numbered inside (shard, hash group), then shifted by the sizes of the groups
    before; the table of group sizes has len(weights) * slot_groups rows at most, so it is broadcast.
    """
    n = len(weights)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("__key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        scores(F.col(key), [*weights, grown_weight]).alias("__s"),
        F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(slot_groups)).cast("int").alias("__g"),
    ).select(
        "__key",
        "size",
        "text_crc32",
        "__g",
        (-F.array_max(F.slice("__s", 1, n))["turned"]).cast("int").alias("shard"),
        (-F.array_max("__s")["turned"]).cast("int").alias("grown_shard"),
    )
    before = W.partitionBy("shard").orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "__g").agg(F.count("*").alias("__n")).select("shard", "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("shard", "__g").orderBy("__key", "text_crc32", "size"))
    return (
        rows.withColumn("__r", within)
        .join(F.broadcast(offsets), ["shard", "__g"])
        .select(F.col("__key").alias(key), "size", "text_crc32", "shard", (F.col("__before") + F.col("__r") - 1).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, files_per_shard: int = 8) -> None:
    """Write whole rows as Parquet, a folder for each shard; each shard is spread over ``files_per_shard`` tasks by key."""
    part = F.pmod(F.xxhash64(F.lit("file"), F.col(key)), F.lit(files_per_shard)).cast("int")
    out = df.withColumn("shard", shard_of(F.col(key), weights))
    out.repartition(len(weights) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
